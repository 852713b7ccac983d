"""T1-T19."""

from pyspark.sql import functions as F

from ..operators import telemetry as T
from . import query


@query("t1_turn_usage", "calls", """
SELECT attempt_id, step, prompt_tokens, completion_tokens, ROW_NUMBER() OVER (PARTITION BY attempt_id ORDER BY step) AS turn FROM calls WHERE type = 'assistant'""")
def _(v):
    return T.turn_usage(v.calls).select("attempt_id", "step", "prompt_tokens", "completion_tokens", "turn")


SNAP = "sn AS (SELECT attempt_id, step, CAST(FLOOR(prompt_tokens / 2500) AS BIGINT) AS input_tokens, CAST(FLOOR(completion_tokens / 400) AS BIGINT) AS output_tokens FROM calls)"
KEPT = SNAP + """, kp AS (SELECT * FROM (SELECT *, LAG(input_tokens) OVER w AS pi, LAG(output_tokens) OVER w AS po, ROW_NUMBER() OVER w AS k FROM sn WINDOW w AS (PARTITION BY attempt_id ORDER BY step)) q
 WHERE k = 1 OR pi <> input_tokens OR po <> output_tokens)"""


def snapshots(v):
    return v.calls.select("attempt_id", "step", F.floor(F.col("prompt_tokens") / 2500).alias("input_tokens"), F.floor(F.col("completion_tokens") / 400).alias("output_tokens"))


@query("t2_dedupe_cumulative", "calls", f"WITH {KEPT} SELECT attempt_id, step, input_tokens, output_tokens FROM kp")
def _(v):
    return T.dedupe_cumulative(snapshots(v), ["input_tokens", "output_tokens"])


@query("t2_cumulative_totals", "calls", f"""WITH {KEPT}, l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY attempt_id ORDER BY step DESC) AS d, COUNT(*) OVER (PARTITION BY attempt_id) AS n_turns FROM kp)
SELECT attempt_id, n_turns, input_tokens, output_tokens FROM l WHERE d = 1""")
def _(v):
    return T.cumulative_totals(snapshots(v), ["input_tokens", "output_tokens"])


# models of the relay, of vendors, and unlisted ones; three price lists
@query("t3_resolve_price", "calls prices", """
WITH m AS (SELECT DISTINCT CASE model WHEN '0' THEN 'relay/alpha-m-4-8' WHEN '1' THEN 'beta-m1' WHEN '2' THEN 'Gamma-M2' WHEN '3' THEN 'own-m3' ELSE 'unlisted' END AS model FROM calls)
SELECT model, CASE model WHEN 'relay/alpha-m-4-8' THEN 1 WHEN 'beta-m1' THEN 0 WHEN 'Gamma-M2' THEN 2 END AS source,
 CASE model WHEN 'relay/alpha-m-4-8' THEN 'north/alpha-m-4.8' WHEN 'beta-m1' THEN 'beta-m1' WHEN 'Gamma-M2' THEN 'south/gamma-m2' END AS listed_as,
 CASE model WHEN 'relay/alpha-m-4-8' THEN 5.0 WHEN 'beta-m1' THEN 3.0 WHEN 'Gamma-M2' THEN 1.0 END AS input_price,
 CASE model WHEN 'relay/alpha-m-4-8' THEN 30.0 WHEN 'beta-m1' THEN 15.0 WHEN 'Gamma-M2' THEN 5.0 END AS output_price FROM m""")
def _(v):
    name = F.col("model")
    calls = v.calls.select(F.when(name == "0", "relay/alpha-m-4-8").when(name == "1", "beta-m1").when(name == "2", "Gamma-M2").when(name == "3", "own-m3").otherwise("unlisted").alias("model"))
    listed = lambda key, slug: v.prices.filter(F.col("model") == key).select(F.lit(slug).alias("model"), "input_price", "output_price")
    direct = listed("1", "beta-m1")
    live = listed("0", "north/alpha-m-4.8").unionByName(listed("2", "east/beta-m1"))
    static = listed("2", "south/gamma-m2").unionByName(listed("2", "north/alpha-m-4.8"))
    return T.resolve_price(calls, [direct, live, static], ["relay/"], [("^alpha", "north"), ("^beta", "east"), ("(?i)^gamma", "south")])


@query("t4_call_cost", "calls prices", """
WITH c AS (SELECT attempt_id, step, calls.model, prompt_tokens, completion_tokens, CAST(FLOOR(prompt_tokens / 3) AS BIGINT) AS cached, CAST(FLOOR(prompt_tokens / 5) AS BIGINT) AS written, p.* EXCLUDE (model) FROM calls LEFT JOIN prices p ON p.model = calls.model),
k AS (SELECT *, COALESCE((GREATEST(prompt_tokens - cached - written, 0) + cached * cache_read + written * cache_write) * input_price / 1e6, 0) AS pc FROM c)
SELECT attempt_id, step, model, ROUND(pc, 9) AS prompt_cost, ROUND(COALESCE(completion_tokens / 1e6 * output_price, 0), 9) AS completion_cost, ROUND(COALESCE(prompt_tokens * input_price / 1e6, 0) - pc, 9) AS cache_savings FROM k""")
def _(v):
    calls = v.calls.withColumn("cached_tokens", F.floor(F.col("prompt_tokens") / 3)).withColumn("cache_write_tokens", F.floor(F.col("prompt_tokens") / 5))
    d = T.call_cost(calls, v.prices)
    return d.select("attempt_id", "step", "model", *[F.round(c, 9).alias(c) for c in ("prompt_cost", "completion_cost", "cache_savings")])


@query("t5_usage_breakdown", "calls", """
SELECT attempt_id, step, CASE WHEN type = 'tool' THEN 0 ELSE prompt_tokens END AS prompt_tokens, CASE WHEN type = 'tool' THEN 0 ELSE completion_tokens END AS completion_tokens,
 CASE WHEN type = 'tool' THEN 0 ELSE prompt_tokens + completion_tokens END AS total_tokens, CASE WHEN type = 'assistant' THEN 7 WHEN type = 'result' THEN 9 ELSE 0 END AS cached_tokens,
 CASE WHEN type = 'result' THEN 5 ELSE 0 END AS cache_write_tokens FROM calls""")
def _(v):
    text = (F.when(F.col("type") == "assistant", F.format_string('{"prompt_tokens": %d, "completion_tokens": %d, "total_tokens": %d, "prompt_tokens_details": {"cached_tokens": 7}}',
                                                               "prompt_tokens", "completion_tokens", F.col("prompt_tokens") + F.col("completion_tokens")))
            .when(F.col("type") == "result", F.format_string('{"input_tokens": %d, "output_tokens": %d, "cache_read_input_tokens": 9, "cache_creation_input_tokens": 5}', "prompt_tokens", "completion_tokens"))
            .when(F.col("type") == "tool", F.lit("not json")).otherwise(F.format_string('{"input_tokens": %d, "output_tokens": %d}', "prompt_tokens", "completion_tokens")))
    return T.usage_breakdown(v.calls.select("attempt_id", "step", text.alias("usage")), "usage").drop("usage")


@query("t6_batch_metrics", "attempts", """
SELECT agent_model_name, COUNT(*) AS total, SUM(CASE WHEN agent_failed THEN 0 ELSE 1 END) AS successful, SUM(CASE WHEN agent_failed THEN 1 ELSE 0 END) AS failed,
 ROUND(SUM(cost), 4) AS cost, ROUND(SUM(time_taken_min), 4) AS minutes, COUNT(DISTINCT task_id) AS n_tasks FROM attempts GROUP BY agent_model_name""")
def _(v):
    return T.batch_metrics(v.attempts)


@query("t7_attempt_triage", "attempts", """
WITH a AS (SELECT a.id, time_taken_min, lower(COALESCE(d.text, '')) AS lg, id % 50 = 7 AS ie, id % 6 = 0 AS timed_out, id % 5 <> 1 AS has_solution, id % 3 AS others, id % 7 <> 2 AS ok, id % 11 = 3 AS same FROM attempts a LEFT JOIN documents d ON d.doc_id = a.id)
SELECT id, CASE WHEN ie OR lg LIKE '%thandthan%' OR lg LIKE '%whouwhou%' THEN 'infra_failure' WHEN (lg LIKE '%therble%' OR lg LIKE '%erst%') AND NOT has_solution THEN 'infra_failure' WHEN timed_out THEN 'timeout'
 WHEN NOT has_solution THEN CASE WHEN others > 0 THEN 'needs_review' ELSE 'agent_failure' END WHEN NOT ok OR same THEN 'agent_failure' WHEN time_taken_min < 0.5 THEN 'needs_review' ELSE 'success' END AS status FROM a""")
def _(v):
    i = F.col("id")
    logs = v.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("log_text"))
    a = (v.attempts.join(logs, "id", "left").withColumn("infra_error", i % 50 == 7).withColumn("timed_out", i % 6 == 0).withColumn("has_solution", i % 5 != 1)
         .withColumn("other_workbooks", i % 3).withColumn("solution_ok", i % 7 != 2).withColumn("identical", i % 11 == 3))
    return T.attempt_triage(a, ["thandthan", "whouwhou"], ["therble", "erst"], 0.5).select("id", "status")


@query("t8_identical_to_input", "", """
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND text IN (SELECT text FROM documents x WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id))""")
def _(v):
    docs = v.documents.select("doc_id", F.col("text").alias("content"))
    known = v.labels.select("doc_id")
    return T.identical_to_input(docs.join(known, "doc_id", "left_anti"), docs.join(known, "doc_id", "left_semi")).select("doc_id")


FILES = """fl AS (SELECT page_id AS file_id, page_id % 40 AS attempt_id, length(html) AS size, (length(html) - length(replace(html, '<li>', ''))) // 4 AS n_sheets, html LIKE '%track(0)%' AS has_formulas FROM pages)"""


def page_files(v):
    h = F.col("html")
    return v.pages.select(F.col("page_id").alias("file_id"), (F.col("page_id") % 40).alias("attempt_id"), F.length(h).alias("size"),
                          F.floor((F.length(h) - F.length(F.replace(h, F.lit("<li>"), F.lit("")))) / 4).alias("n_sheets"), F.contains(h, F.lit("track(0)")).alias("has_formulas"))


@query("t9_quality_floor", "", f"""WITH {FILES} SELECT file_id, size, n_sheets, CASE WHEN size < 5000 THEN 'too small' WHEN n_sheets < 6 THEN 'too few sheets' WHEN NOT has_formulas THEN 'no formulas' END AS why,
 NOT (size < 5000 OR n_sheets < 6 OR NOT has_formulas) AS ok FROM fl""")
def _(v):
    return T.quality_floor(page_files(v), 5000, 6).select("file_id", "size", "n_sheets", "why", "ok")


@query("t10_best_artifact", "", f"""WITH {FILES} SELECT attempt_id, file_id, CASE WHEN ROW_NUMBER() OVER (PARTITION BY attempt_id ORDER BY CASE WHEN size >= 5000 AND n_sheets >= 6 THEN 1 ELSE 0 END DESC, size DESC, n_sheets DESC, file_id DESC) = 1 THEN 'best' ELSE 'extra' END AS role FROM fl""")
def _(v):
    return T.best_artifact(page_files(v), "attempt_id", 5000, 6).select("attempt_id", "file_id", "role")


@query("t11_cap_hit", "text_cells", "SELECT wb_id, MAX(CASE WHEN v_text LIKE '%heonheon%' OR v_text LIKE '%thanthan%' THEN 1 ELSE 0 END) = 1 AS cap_hit FROM text_cells GROUP BY wb_id")
def _(v):
    return T.cap_hit(v.text_cells.withColumnRenamed("v_text", "log_text"), "wb_id", ["heonheon", "thanthan"])


@query("t12_resolve_blobs", "", "SELECT conv_id, turn, text AS content FROM conversations")
def _(v):
    c = v.conversations
    ident = F.when(F.length("text") >= 100, F.substring(F.sha2("text", 256), 1, 16))
    blobs = c.select(ident.alias("blob_id"), F.col("text").alias("content")).filter("blob_id is not null")
    records = c.select("conv_id", "turn", ident.alias("blob_id"), F.when(F.length("text") < 100, F.col("text")).alias("content"))
    return T.resolve_blobs(records, blobs).select("conv_id", "turn", "content")


@query("t13_context_pressure", "calls", """
WITH p AS (SELECT attempt_id, prompt_tokens / 10000.0::DOUBLE * 100 AS pct FROM calls), t AS (SELECT *, CASE WHEN pct < 65 THEN 'low' WHEN pct < 80 THEN 'advisory' WHEN pct < 90 THEN 'strong' ELSE 'forced' END AS tier FROM p)
SELECT attempt_id, ROUND(MAX(pct), 4) AS peak_pct, COUNT(CASE WHEN tier = 'low' THEN 1 END) AS n_low, COUNT(CASE WHEN tier = 'advisory' THEN 1 END) AS n_advisory, COUNT(CASE WHEN tier = 'strong' THEN 1 END) AS n_strong,
 COUNT(CASE WHEN tier = 'forced' THEN 1 END) AS n_forced, CASE WHEN MAX(pct) < 65 THEN 'low' WHEN MAX(pct) < 80 THEN 'advisory' WHEN MAX(pct) < 90 THEN 'strong' ELSE 'forced' END AS peak_tier FROM t GROUP BY attempt_id""")
def _(v):
    return T.context_pressure(v.calls, 10000)


@query("t14_evict_rounds", "", """
SELECT conv_id, COUNT(*) AS dropped_messages, SUM(length(text)) AS dropped_chars, MIN(turn) AS first_round, MAX(turn) AS last_round FROM conversations WHERE turn < 3 AND role <> 'system' GROUP BY conv_id""")
def _(v):
    tag = F.when(F.col("role") == "user", "tool_result").when(F.col("role") == "assistant", "model_tool_call").when(F.col("role") != "system", "tool_result").otherwise("system")
    return T.evict_rounds(v.conversations.select("conv_id", F.col("turn").alias("round"), tag.alias("tag"), "text"), "conv_id", 3)


@query("t15_evict_oldest", "", """
WITH e AS (SELECT page_id AS entry, (page_id * 7919) % 100003 AS mtime, length(html) AS size FROM pages),
r AS (SELECT *, SUM(size) OVER (ORDER BY mtime, entry) AS freed FROM e WHERE mtime <= 90000)
SELECT entry, mtime, size, freed FROM r WHERE (SELECT SUM(size) FROM e) - (freed - size) > 500000""")
def _(v):
    e = v.pages.select(F.col("page_id").alias("entry"), ((F.col("page_id") * 7919) % 100003).alias("mtime"), F.length("html").alias("size"))
    return T.evict_oldest(e, 500_000, F.lit(90000), F.floor(F.col("mtime") / 3600)).select("entry", "mtime", "size", "freed")


@query("t16_estimate_tokens", "", """
SELECT page_id % 40 AS attempt_id, SUM(CASE WHEN page_id % 3 = 0 THEN length(html) // 6 ELSE length(html) // 4 END) AS tokens, COUNT(*) AS n_files FROM pages GROUP BY 1""")
def _(v):
    files = v.pages.select((F.col("page_id") % 40).alias("attempt_id"), F.length("html").alias("size"), F.when(F.col("page_id") % 3 == 0, "XLSX").otherwise("pdf").alias("extension"))
    return T.estimate_tokens(files, "attempt_id")


SESSIONS = """se AS (SELECT attempt_id, CAST(ts AS DATE) AS d, COUNT(*) AS n_events, COUNT(CASE WHEN type = 'assistant' THEN 1 END) AS n_prompts, COUNT(CASE WHEN type = 'result' THEN 1 END) AS n_results,
 epoch_us(MAX(ts)) - epoch_us(MIN(ts)) AS micros FROM calls GROUP BY 1, 2)"""


@query("t17_session_durations", "calls", f"WITH {SESSIONS} SELECT attempt_id, CAST(d AS VARCHAR) AS day, n_events, n_prompts, n_results, micros FROM se")
def _(v):
    return T.session_durations(v.calls).withColumn("day", F.col("day").cast("string"))


@query("t17_session_summary", "calls", f"WITH {SESSIONS} SELECT COUNT(*) AS n_sessions, CAST(SUM(n_prompts) AS BIGINT) AS n_prompts, CAST(SUM(n_results) AS BIGINT) AS n_results, MAX(micros) AS longest_micros FROM se")
def _(v):
    return T.session_summary(T.session_durations(v.calls))


@query("t18_cohort_axes_unique", "attempts", """
WITH s AS (SELECT DISTINCT agent_model_name, prompt_version, CAST(length(agent_model_name) % 3 AS VARCHAR) AS effort FROM attempts)
SELECT 'label with several settings' AS problem, agent_model_name AS subject, COUNT(*) AS n FROM s GROUP BY agent_model_name HAVING COUNT(*) > 1
UNION ALL SELECT 'settings with several labels', prompt_version || '|' || effort, COUNT(*) FROM s GROUP BY prompt_version, effort HAVING COUNT(*) > 1""")
def _(v):
    a = v.attempts.withColumn("effort", (F.length("agent_model_name") % 3).cast("string"))
    return T.cohort_conflicts(a, ["prompt_version", "effort"])


@query("t19_message_size", "", "SELECT source, SUM(length(text)) AS chars, COUNT(*) AS n_files, SUM(length(text)) > 100000 AS over_budget FROM documents GROUP BY source")
def _(v):
    return T.message_size(v.documents, "source", 100_000)
