"""R1-R15."""

from pyspark.sql import functions as F

from ..operators import scoring as S
from . import query

COUNTS = """counts AS (SELECT attempt_id, category, name, MAX(m) AS mistakes, COUNT(*) AS n_items, COUNT(*) > 1 AS duplicate,
  SUM(bare) AS fail_without_mistakes, SUM(CASE WHEN claimed <> m THEN 1 ELSE 0 END) AS count_mismatches
 FROM (SELECT *, CASE WHEN decision = 'fail' AND n_mistakes = 0 THEN 1 ELSE n_mistakes END AS m,
         CASE WHEN decision = 'fail' AND n_mistakes = 0 THEN 1 ELSE 0 END AS bare FROM judgements) j
 GROUP BY attempt_id, category, name)"""

ONE = """one AS (SELECT attempt_id, category, name, engine, decision, n_mistakes FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY attempt_id, category, name, engine ORDER BY n_mistakes DESC, decision DESC) AS k FROM judgements) q WHERE k = 1),
 j AS (SELECT * FROM one WHERE engine = 'llm'), c AS (SELECT * FROM one WHERE engine = 'code')"""

OVERLAY = """o AS (SELECT attempt_id, category, name, CASE WHEN wins THEN 'code' ELSE 'llm' END AS decided_by,
  CASE WHEN wins THEN cd ELSE llm_decision END AS decision, CASE WHEN wins THEN cm ELSE llm_mistakes END AS n_mistakes, llm_decision, llm_mistakes
 FROM (SELECT COALESCE(j.attempt_id, c.attempt_id) AS attempt_id, COALESCE(j.category, c.category) AS category, COALESCE(j.name, c.name) AS name,
     j.decision AS llm_decision, j.n_mistakes AS llm_mistakes, c.decision AS cd, c.n_mistakes AS cm,
     c.decision IS NOT NULL AND EXISTS (SELECT 1 FROM weights w WHERE w.category = COALESCE(j.category, c.category) AND w.name = COALESCE(j.name, c.name)) AS wins
   FROM j FULL OUTER JOIN c ON j.attempt_id = c.attempt_id AND j.category = c.category AND j.name = c.name) b
 WHERE wins OR llm_decision IS NOT NULL)"""


def total_sql(source: str, out: str) -> str:
    """The total score of ``source`` (attempt_id, category, name, mistakes) by the long way: every check of every attempt."""
    return f"""(SELECT attempt_id, ROUND(SUM(cat), 6) AS {out} FROM (
  SELECT a.attempt_id, w.category, SUM(CASE WHEN s.mistakes IS NULL OR s.mistakes >= 1 THEN 0.0 ELSE 1.0 END * w.weight) / SUM(w.weight) * 100 * MAX(w.category_weight) AS cat
  FROM (SELECT DISTINCT attempt_id FROM {source}) a CROSS JOIN weights w
  LEFT JOIN {source} s ON s.attempt_id = a.attempt_id AND s.category = w.category AND s.name = w.name
  GROUP BY a.attempt_id, w.category) z GROUP BY attempt_id)"""


def counts(v):
    return S.mistake_counts(v.judgements)


def engines(v):
    one = S.one_per_check(v.judgements)
    return (one.filter(F.col("engine") == "llm").drop("engine"), one.filter(F.col("engine") == "code").drop("engine"))


@query("r1_weights_consistency", "judgements weights", """
SELECT COALESCE(r.category, w.category) AS category, COALESCE(r.name, w.name) AS name,
  CASE WHEN r.name IS NULL THEN 'missing in rubric' ELSE 'missing in weights' END AS problem
FROM (SELECT DISTINCT category, CASE WHEN n_mistakes = 6 THEN 'renamed ' || name ELSE name END AS name FROM judgements) r
FULL OUTER JOIN (SELECT category, CASE WHEN weight = 1 THEN 'old ' || name ELSE name END AS name FROM weights) w ON r.category = w.category AND r.name = w.name
WHERE r.name IS NULL OR w.name IS NULL""")
def _(v):
    rubric = v.judgements.withColumn("name", F.when(F.col("n_mistakes") == 6, F.concat(F.lit("renamed "), "name")).otherwise(F.col("name")))
    return S.weights_consistency(rubric, v.weights.withColumn("name", F.when(F.col("weight") == 1, F.concat(F.lit("old "), "name")).otherwise(F.col("name"))))


ANNOTATED = """ann AS (SELECT c_custkey AS task_id, w.check_no, w.category,
  CASE WHEN (c_custkey * 7 + w.check_no) % 101 = 0 THEN w.name || '?' ELSE w.name END AS name,
  CASE WHEN (c_custkey + w.check_no) % 3 = 0 OR (c_custkey % 4 = 0 AND w.category = 'ASIA') THEN 'not_applicable' ELSE 'applicable' END AS verdict
 FROM customer JOIN nation ON TRUE JOIN weights w ON w.check_no = n_nationkey + 1)"""


def annotations(v):
    rubric = v.weights.agg(F.collect_list(F.struct("check_no", "category", "name"))).scalar()
    task = F.col("task_id")
    return (v.customer.select(F.col("c_custkey").alias("task_id"), rubric.alias("r"))
            .select("task_id", F.inline("r"))
            .select("task_id", "check_no", "category",
                    F.when((task * 7 + F.col("check_no")) % 101 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"),
                    F.when(((task + F.col("check_no")) % 3 == 0) | ((task % 4 == 0) & (F.col("category") == "ASIA")), "not_applicable")
                    .otherwise("applicable").alias("verdict")))


APPLICABLE = ANNOTATED + """, app AS (SELECT task_id, ann.check_no, ann.category, ann.name FROM ann JOIN weights w
  ON w.check_no = ann.check_no AND w.category = ann.category AND w.name = ann.name WHERE verdict = 'applicable' AND ann.check_no NOT IN (3, 11))"""


@query("r2_applicable_checks", "weights", f"WITH {APPLICABLE} SELECT * FROM app")
def _(v):
    return S.applicable_checks(annotations(v), v.weights, [3, 11])


@query("r2_annotation_mismatches", "weights", f"""WITH {ANNOTATED}
SELECT task_id, ann.check_no, ann.category, ann.name, w.category AS rubric_category, w.name AS rubric_name
FROM ann LEFT JOIN weights w ON w.check_no = ann.check_no WHERE w.name IS NULL OR w.name <> ann.name OR w.category <> ann.category""")
def _(v):
    return S.annotation_mismatches(annotations(v), v.weights)


@query("r3_effective_weights", "weights", f"""WITH {APPLICABLE},
cats AS (SELECT task_id, category, MAX(category_weight) AS cw FROM app JOIN weights USING (check_no, category) GROUP BY task_id, category),
tot AS (SELECT task_id, SUM(cw) AS t FROM cats GROUP BY task_id)
SELECT app.task_id, app.check_no, app.category, app.name, w.weight, ROUND(w.category_weight / t, 6) AS category_weight
FROM app JOIN weights w USING (check_no) JOIN tot ON tot.task_id = app.task_id""")
def _(v):
    out = S.effective_weights(S.applicable_checks(annotations(v), v.weights, [3, 11]), v.weights)
    return out.withColumn("category_weight", F.round("category_weight", 6))


@query("r4_mistake_counts", "judgements", f"WITH {COUNTS} SELECT * FROM counts")
def _(v):
    return counts(v)


@query("r5_check_scores", "judgements weights", f"""WITH {COUNTS}
SELECT a.attempt_id, w.category, w.name, w.weight, w.category_weight, COALESCE(c.mistakes, 1) AS mistakes,
  CASE WHEN COALESCE(c.mistakes, 1) = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score, c.mistakes IS NULL AS unscored
FROM (SELECT DISTINCT attempt_id FROM counts) a CROSS JOIN weights w
LEFT JOIN counts c ON c.attempt_id = a.attempt_id AND c.category = w.category AND c.name = w.name""")
def _(v):
    return S.check_scores(counts(v), v.weights)


@query("r6_category_and_total", "judgements weights", f"""WITH {COUNTS}
SELECT t.attempt_id, t.total_score, COALESCE(n.n_scored, 0) AS n_scored FROM {total_sql('counts', 'total_score')} t
LEFT JOIN (SELECT attempt_id, COUNT(*) AS n_scored FROM counts JOIN weights USING (category, name) GROUP BY attempt_id) n ON n.attempt_id = t.attempt_id""")
def _(v):
    return S.total_scores(counts(v), v.weights)


@query("r6_category_scores", "judgements weights", f"""WITH {COUNTS}
SELECT attempt_id, category, n_scored, ROUND(ws / tw * 100, 6) AS category_score, category_weight FROM (
 SELECT attempt_id, category, COUNT(*) AS n_scored, SUM(CASE WHEN mistakes >= 1 THEN 0.0 ELSE weight END) AS ws, MAX(category_weight) AS category_weight
 FROM counts JOIN weights USING (category, name) GROUP BY attempt_id, category) x
JOIN (SELECT category, SUM(weight) AS tw FROM weights GROUP BY category) y USING (category)""")
def _(v):
    return S.category_scores(counts(v), v.weights).withColumn("category_score", F.round("category_score", 6))


@query("r7_overlay_verdicts", "judgements weights", f"WITH {ONE}, {OVERLAY} SELECT * FROM o")
def _(v):
    judge, code = engines(v)
    return S.overlay_verdicts(judge, code, v.weights)


@query("r8_agreement", "judgements", f"""WITH {ONE}
SELECT category, name, COUNT(*) AS n_code, COUNT(jd) AS n_both, SUM(CASE WHEN jd = cd THEN 1 ELSE 0 END) AS n_agreed,
  ROUND(AVG(CASE WHEN jd IS NULL THEN NULL WHEN jd = cd THEN 1.0 ELSE 0.0 END), 6) AS agreement_rate
FROM (SELECT c.category, c.name, c.decision AS cd, j.decision AS jd FROM c LEFT JOIN j
      ON j.attempt_id = c.attempt_id AND j.category = c.category AND j.name = c.name) b GROUP BY category, name""")
def _(v):
    return S.agreement(*engines(v))


FAMILIES = """WITH a AS (SELECT DISTINCT attempt_id, category, name FROM judgements WHERE engine = 'code'),
b AS (SELECT DISTINCT attempt_id, category, name FROM judgements WHERE engine = 'llm')"""


def families(v):
    keys = v.judgements.select("engine", "attempt_id", "category", "name").distinct()
    return keys.filter("engine = 'code'").drop("engine"), keys.filter("engine = 'llm'").drop("engine")


@query("r9_family_overlap", "judgements", FAMILIES + " SELECT * FROM a INTERSECT SELECT * FROM b")
def _(v):
    return S.family_overlap(*families(v))


@query("r9_merge_verdict_families", "judgements", FAMILIES + """
SELECT u.*, (SELECT COUNT(*) FROM a WHERE a.attempt_id = u.attempt_id AND a.category = u.category AND a.name = u.name)
  + (SELECT COUNT(*) FROM b WHERE b.attempt_id = u.attempt_id AND b.category = u.category AND b.name = u.name) > 1 AS conflict
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u""")
def _(v):
    return S.merge_families(*families(v))


@query("r10_tag_graders", "judgements weights", f"""WITH {ONE}, {OVERLAY}
SELECT attempt_id, SUM(CASE WHEN decided_by = 'code' THEN 1 ELSE 0 END) AS deterministic,
  SUM(CASE WHEN decided_by = 'code' THEN 0 ELSE 1 END) AS llm FROM o GROUP BY attempt_id""")
def _(v):
    judge, code = engines(v)
    return S.tag_graders(S.overlay_verdicts(judge, code, v.weights))


WARNINGS = """warn AS (SELECT *, concat_ws(', ', CASE WHEN unscored_checks > 0 THEN 'unscored_checks' END,
   CASE WHEN empty_category_judgements > 0 THEN 'empty_category_judgements' END, CASE WHEN duplicate_judgements > 0 THEN 'duplicate_judgements' END,
   CASE WHEN mistake_count_mismatches > 0 THEN 'mistake_count_mismatches' END, CASE WHEN fail_without_mistakes > 0 THEN 'fail_without_mistakes' END) AS fired
 FROM (SELECT attempt_id, (SELECT COUNT(*) FROM weights) - COUNT(weight) AS unscored_checks,
   (SELECT COUNT(DISTINCT category) FROM weights) - COUNT(DISTINCT CASE WHEN weight IS NOT NULL THEN category END) AS empty_category_judgements,
   SUM(CASE WHEN duplicate THEN 1 ELSE 0 END) AS duplicate_judgements, SUM(count_mismatches) AS mistake_count_mismatches,
   SUM(fail_without_mistakes) AS fail_without_mistakes
  FROM counts LEFT JOIN weights USING (category, name) GROUP BY attempt_id) p)"""
REASON = "fired <> '' AS failed, CASE WHEN fired <> '' THEN 'Scoring warnings: ' || fired END AS failed_reason"


@query("r11_scoring_warnings", "judgements weights", f"""WITH {COUNTS}, {WARNINGS}
SELECT attempt_id, unscored_checks, empty_category_judgements, duplicate_judgements, CAST(mistake_count_mismatches AS BIGINT) AS mistake_count_mismatches,
  CAST(fail_without_mistakes AS BIGINT) AS fail_without_mistakes, {REASON} FROM warn""")
def _(v):
    return S.scoring_warnings(counts(v), v.weights)


@query("r12_grading_rows", "judgements weights attempts", f"""WITH {COUNTS}, {WARNINGS}
SELECT t.attempt_id, a.task_id, 'g1' AS grader_model, a.prompt_version, t.total_score, CAST(ROUND(CAST(a.time_taken_min AS DECIMAL(18,10)), 4) AS DOUBLE) AS time_elapsed_min,
  CAST(ROUND(CAST(a.cost AS DECIMAL(18,10)), 6) AS DOUBLE) AS cost, {REASON}, FALSE AS deprecated
FROM {total_sql('counts', 'total_score')} t JOIN warn ON warn.attempt_id = t.attempt_id JOIN attempts a ON a.id = t.attempt_id""")
def _(v):
    c = counts(v)
    return S.grading_rows(v.attempts, S.total_scores(c, v.weights), S.scoring_warnings(c, v.weights), "g1")


@query("r13_dual_engine_totals", "judgements weights", f"""WITH {ONE}, {OVERLAY},
om AS (SELECT attempt_id, category, name, n_mistakes AS mistakes FROM o), jm AS (SELECT attempt_id, category, name, n_mistakes AS mistakes FROM j)
SELECT COALESCE(x.attempt_id, y.attempt_id) AS attempt_id, COALESCE(code_wins, 0) AS code_wins, COALESCE(judge_wins, 0) AS judge_wins,
  ROUND(COALESCE(code_wins, 0) - COALESCE(judge_wins, 0), 6) AS delta
FROM {total_sql('om', 'code_wins')} x FULL OUTER JOIN {total_sql('jm', 'judge_wins')} y ON x.attempt_id = y.attempt_id""")
def _(v):
    judge, code = engines(v)
    return S.dual_engine_totals(judge, code, v.weights)


@query("r14_retry_later", "attempts", """
SELECT DISTINCT l_orderkey AS attempt_id, l_linestatus AS grader_model FROM lineitem
WHERE l_returnflag = 'R' AND l_linenumber IN (1, 2)""")
def _(v):
    reason = F.when(F.col("l_linenumber") == 1, "LibreOffice timed out").when(F.col("l_linenumber") == 2, "lock stayed busy").otherwise("parse failure")
    g = v.lineitem.select(F.col("l_orderkey").alias("attempt_id"), F.col("l_linestatus").alias("grader_model"),
                          (F.col("l_returnflag") == "R").alias("failed"), reason.alias("failed_reason"))
    return S.retry_later(g, ["timed out", "stayed busy"])


@query("r15_pinned_checks", "weights", """
SELECT check_no, listed, problem FROM (SELECT COALESCE(c.check_no, p.check_no) AS check_no, listed,
  CASE WHEN listed IS NULL THEN 'pin not configured' WHEN p.name IS NULL THEN 'no pin' WHEN c.name <> p.name THEN 'pin differs' WHEN listed > 1 THEN 'listed twice' END AS problem
FROM (SELECT s_suppkey % 40 AS check_no, COUNT(*) AS listed, MAX('NATION_' || CAST(s_nationkey AS VARCHAR(5))) AS name FROM supplier GROUP BY 1) c
FULL OUTER JOIN weights p ON p.check_no = c.check_no) q WHERE problem IS NOT NULL""")
def _(v):
    pins = v.weights.withColumn("category", F.lit("all"))
    conf = v.supplier.select((F.col("s_suppkey") % 40).alias("check_no"), F.lit("all").alias("category"),
                             F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("name"))
    return S.pinned_checks(conf, pins)
