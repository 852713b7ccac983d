"""Run logs: usage, cost, triage, artifacts, context and cache accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import number_rows, once, previous, running_sum


def _block(column: str, width: int = 4096) -> Column:
    return F.floor(F.col(column) / width)


def turn_usage(transcript: DataFrame) -> DataFrame:
    """Assistant lines with usage, numbered within the attempt. A long transcript is numbered in blocks."""
    turns = transcript.filter((F.col("type") == "assistant") & F.col("prompt_tokens").isNotNull())
    return number_rows(turns, ["attempt_id"], ["step"], _block("step"), "turn")


def dedupe_cumulative(transcript: DataFrame, usage: list[str]) -> DataFrame:
    """Cumulative snapshots without those equal to the one before; the last one is the total."""
    d = previous(transcript, ["attempt_id"], ["step"], F.struct(*usage), _block("step"), "before")
    return d.filter(~F.struct(*usage).eqNullSafe(F.col("before"))).drop("before")


def cumulative_totals(transcript: DataFrame, usage: list[str]) -> DataFrame:
    kept = dedupe_cumulative(transcript, usage)
    last = kept.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max_by(F.struct(*usage), "step").alias("t"))
    return last.select("attempt_id", "n_turns", *[F.col(f"t.{u}").alias(u) for u in usage])


def candidate_slugs(model: Column, prefixes: list[str], vendors: list[tuple[str, str]]) -> Column:
    """The names a model may be listed under, best first: as written, without a relay's prefix, dotted version, with vendor.

    ``vendors`` are (pattern of a bare name, vendor) pairs, the first that fits names the vendor.
    """
    bare = F.regexp_replace(model, "^(?:" + "|".join(prefixes) + ")", "") if prefixes else model
    dotted = F.regexp_replace(bare, r"-([0-9]+)-([0-9]+)$", "-$1.$2")

    def vendor(name: Column) -> Column:
        out = F.when(F.contains(name, F.lit("/")), F.lit(None).cast("string"))
        for pattern, owner in vendors:
            out = out.when(name.rlike(pattern), F.concat(F.lit(f"{owner}/"), F.lower(name)))
        return out

    return F.array_distinct(F.array_compact(F.array(model, bare, dotted, vendor(bare), vendor(dotted))))


def resolve_price(calls: DataFrame, sources: list[DataFrame], prefixes: list[str] | None = None, vendors: list[tuple[str, str]] | None = None) -> DataFrame:
    """Each distinct model with the price of the first source, and there the first name, that lists it.

    Work is done on distinct models; sources hold (model, input_price, output_price).
    """
    names = calls.select("model").distinct().select("model", F.posexplode(candidate_slugs(F.col("model"), prefixes or [], vendors or [])).alias("pos", "slug"))
    found = None
    for rank, source in enumerate(sources):
        hit = names.join(source.withColumnRenamed("model", "slug"), "slug").select(
            "model", F.struct(F.lit(rank).alias("rank"), F.col("pos"), F.col("slug"), F.col("input_price"), F.col("output_price")).alias("p"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("model").agg(F.min("p").alias("p"))
    return calls.select("model").distinct().join(best, "model", "left").select(
        "model", F.col("p.rank").alias("source"), F.col("p.slug").alias("listed_as"), F.col("p.input_price").alias("input_price"), F.col("p.output_price").alias("output_price"))


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call with cache reads and writes at their own rate, and what caching saved.

    ``calls`` carries prompt_tokens (all input), cached_tokens, cache_write_tokens and
    completion_tokens; an unknown price costs nothing and is visible as null input_price.
    """
    per = F.col("input_price") / 1e6
    cached, written = F.greatest("cached_tokens", F.lit(0)), F.greatest("cache_write_tokens", F.lit(0))
    uncached = F.greatest(F.col("prompt_tokens") - cached - written, F.lit(0))
    prompt = uncached * per + cached * per * F.col("cache_read") + written * per * F.col("cache_write")
    d = calls.join(prices, "model", "left").withColumn("prompt_cost", F.coalesce(prompt, F.lit(0.0)))
    return d.withColumn("completion_cost", F.coalesce(F.col("completion_tokens") / 1e6 * F.col("output_price"), F.lit(0.0))) \
        .withColumn("total_cost", F.col("prompt_cost") + F.col("completion_cost")) \
        .withColumn("cache_savings", F.coalesce(F.col("prompt_tokens") * per, F.lit(0.0)) - F.col("prompt_cost"))


_USAGE = ("STRUCT<prompt_tokens: BIGINT, input_tokens: BIGINT, completion_tokens: BIGINT, output_tokens: BIGINT, total_tokens: BIGINT, "
          "prompt_tokens_details: STRUCT<cached_tokens: BIGINT>, cache_read_input_tokens: BIGINT, cached_input_tokens: BIGINT, "
          "cache_write_tokens: BIGINT, cache_creation_input_tokens: BIGINT>")


def usage_breakdown(df: DataFrame, usage: str) -> DataFrame:
    """The usage text of any provider as five numbers; what is missing reads as 0."""
    u = once(df, u=F.from_json(F.col(usage), _USAGE))
    first = lambda *c: F.coalesce(*[F.col(f"u.{x}") for x in c], F.lit(0))
    d = u.select(*df.columns, first("prompt_tokens", "input_tokens").alias("prompt_tokens"), first("completion_tokens", "output_tokens").alias("completion_tokens"),
                 F.col("u.total_tokens").alias("_t"), first("prompt_tokens_details.cached_tokens", "cache_read_input_tokens", "cached_input_tokens").alias("cached_tokens"),
                 first("cache_write_tokens", "cache_creation_input_tokens").alias("cache_write_tokens"))
    return d.withColumn("total_tokens", F.coalesce("_t", F.col("prompt_tokens") + F.col("completion_tokens"))).drop("_t")


def batch_metrics(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("agent_model_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("agent_failed")).alias("successful"), F.count_if("agent_failed").alias("failed"),
        F.round(F.sum("cost"), 4).alias("cost"), F.round(F.sum("time_taken_min"), 4).alias("minutes"),
        F.count_distinct("task_id").alias("n_tasks"))


def attempt_triage(attempts: DataFrame, exhausted: list[str], infra: list[str], junk_minutes: float) -> DataFrame:
    """Why an attempt ended as it did, first reason wins.

    Reads infra_error, log_text, timed_out, has_solution, other_workbooks, solution_ok, identical
    and time_taken_min.
    """
    log = F.lower(F.coalesce("log_text", F.lit("")))
    any_of = lambda words: log.rlike("|".join(words))
    status = (F.when(F.col("infra_error") | any_of(exhausted), "infra_failure")
              .when(any_of(infra) & ~F.col("has_solution"), "infra_failure").when(F.col("timed_out"), "timeout")
              .when(~F.col("has_solution"), F.when(F.col("other_workbooks") > 0, "needs_review").otherwise("agent_failure"))
              .when(~F.col("solution_ok") | F.col("identical"), "agent_failure")
              .when(F.col("time_taken_min") < junk_minutes, "needs_review").otherwise("success"))
    return attempts.withColumn("status", status)


def identical_to_input(delivered: DataFrame, inputs: DataFrame, content: str = "content") -> DataFrame:
    """Delivered files whose bytes equal a starting file."""
    digest = F.sha2(F.col(content), 256)
    return delivered.withColumn("digest", digest).join(inputs.select(digest.alias("digest")).distinct(), "digest", "left_semi")


def clears_floor(size: Column, sheets: Column, formulas: Column, min_bytes: int, min_sheets: int) -> Column:
    return (size >= min_bytes) & (sheets >= min_sheets) & formulas


def quality_floor(files: DataFrame, min_bytes: int = 10_000, min_sheets: int = 2) -> DataFrame:
    why = (F.when(F.col("size") < min_bytes, "too small").when(F.col("n_sheets") < min_sheets, "too few sheets").when(~F.col("has_formulas"), "no formulas"))
    return files.withColumn("why", why).withColumn("ok", F.col("why").isNull())


def best_artifact(files: DataFrame, key: str, min_bytes: int = 10_000, min_sheets: int = 2) -> DataFrame:
    """The artifact of each attempt that clears the floor, then is largest, then has most sheets; the rest are extras.

    The best is a maximum per attempt, merged before the shuffle; every file then looks it up.
    """
    rank = F.struct(clears_floor(F.col("size"), F.col("n_sheets"), F.lit(True), min_bytes, min_sheets).alias("ok"), F.col("size"), F.col("n_sheets"), F.col("file_id"))
    best = files.groupBy(key).agg(F.max(rank).alias("b")).select(key, F.col("b.file_id").alias("best_id"))
    return files.join(best, key).withColumn("role", F.when(F.col("file_id") == F.col("best_id"), "best").otherwise("extra")).drop("best_id")


def cap_hit(logs: DataFrame, key: str, signatures: list[str]) -> DataFrame:
    """Whether any log of the attempt carries a usage-cap or sign-in signature."""
    return logs.groupBy(key).agg(F.max(F.coalesce(F.col("log_text").rlike("|".join(signatures)), F.lit(False))).alias("cap_hit"))


def resolve_blobs(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """Records with blob references put back: content where blob_id is null, else the blob's content."""
    b = blobs.groupBy("blob_id").agg(F.first("content").alias("blob_content"))
    return records.join(b, "blob_id", "left").withColumn("content", F.coalesce("content", "blob_content")).drop("blob_content")


def pressure_tier(pct: Column) -> Column:
    return F.when(pct < 65, "low").when(pct < 80, "advisory").when(pct < 90, "strong").otherwise("forced")


def context_pressure(calls: DataFrame, limit: int) -> DataFrame:
    """Per run the peak share of the context and how often each tier was reached."""
    pct = F.col("prompt_tokens") / F.lit(float(limit)) * 100
    d = calls.withColumn("pct", pct).withColumn("tier", pressure_tier(pct))
    tiers = [F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("low", "advisory", "strong", "forced")]
    return d.groupBy("attempt_id").agg(F.round(F.max("pct"), 4).alias("peak_pct"), *tiers).withColumn("peak_tier", pressure_tier(F.col("peak_pct")))


def evict_rounds(messages: DataFrame, key: str, before_round: int) -> DataFrame:
    """What dropping tool pairs of the older rounds frees: messages, characters, span of rounds."""
    old = messages.filter((F.col("round") < before_round) & F.col("tag").isin("model_tool_call", "tool_result"))
    return old.groupBy(key).agg(F.count(F.lit(1)).alias("dropped_messages"), F.sum(F.length("text")).alias("dropped_chars"),
                                F.min("round").alias("first_round"), F.max("round").alias("last_round"))


def evict_oldest(entries: DataFrame, cap: int, newest: Column, block: Column) -> DataFrame:
    """Oldest entries to delete until the cache is under its cap; entries younger than ``newest`` stay.

    The running sum over time is taken in blocks, so the cache is never sorted in one task.
    """
    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    old = entries.filter(F.col("mtime") <= newest)
    d = running_sum(old, [], ["mtime", "entry"], F.col("size"), block, "upto")
    return d.filter(total - (F.col("upto") - F.col("size")) > cap).withColumnRenamed("upto", "freed")


def estimate_tokens(files: DataFrame, key: str) -> DataFrame:
    """Rough prompt size: a quarter of document bytes, a sixth of workbook bytes."""
    part = F.when(F.lower("extension").isin("xlsx", "xlsm", "xls", "csv"), F.floor(F.col("size") / 6)).otherwise(F.floor(F.col("size") / 4))
    return files.groupBy(key).agg(F.sum(part).alias("tokens"), F.count(F.lit(1)).alias("n_files"))


def session_durations(events: DataFrame) -> DataFrame:
    """Per attempt and day the session's span in seconds with its prompts and successes."""
    start, end = F.min("ts"), F.max("ts")
    return events.groupBy("attempt_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("type") == "assistant").alias("n_prompts"),
        F.count_if(F.col("type") == "result").alias("n_results"),
        (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))).alias("micros"))


def session_summary(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_prompts").alias("n_prompts"), F.sum("n_results").alias("n_results"),
                        F.max("micros").alias("longest_micros"))


def message_size(files: DataFrame, key: str, budget: int) -> DataFrame:
    """Characters per file set against a budget."""
    return files.groupBy(key).agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n_files")).withColumn("over_budget", F.col("chars") > budget)


def cohort_conflicts(labels: DataFrame, axes: list[str]) -> DataFrame:
    """Labels used twice, and settings two labels share. Empty means every cohort is its own."""
    seen = labels.select("agent_model_name", *axes).distinct()
    per_label = seen.groupBy("agent_model_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("label with several settings").alias("problem"), F.col("agent_model_name").alias("subject"), "n")
    per_axes = seen.groupBy(*axes).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("settings with several labels").alias("problem"), F.concat_ws("|", *axes).alias("subject"), "n")
    return per_label.unionByName(per_axes)
