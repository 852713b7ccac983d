"""Weighted scoring of judgements: counts, overlays, rollups, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK = ["category", "name"]


def weights_consistency(rubric: DataFrame, weights: DataFrame) -> DataFrame:
    """Checks present on one side only, and category weights that do not sum to one."""
    left = rubric.select(*CHECK).distinct().withColumn("in_rubric", F.lit(True))
    right = weights.select(*CHECK).distinct().withColumn("in_weights", F.lit(True))
    sides = (left.join(right, CHECK, "full_outer")
             .filter(F.col("in_rubric").isNull() | F.col("in_weights").isNull())
             .select("category", "name",
                     F.when(F.col("in_rubric").isNull(), "missing in rubric").otherwise("missing in weights").alias("problem")))
    total = (weights.select("category", "category_weight").distinct()
             .agg(F.round(F.sum("category_weight"), 4).alias("s"))
             .filter(~F.col("s").between(0.99, 1.01))
             .select(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("name"),
                     F.concat(F.lit("category weights sum to "), F.col("s").cast("string")).alias("problem")))
    return sides.unionByName(total)


def applicable_checks(annotations: DataFrame, weights: DataFrame, retired: list[int]) -> DataFrame:
    """Annotated checks that still count: applicable, not retired, same number and name as the weights."""
    return (annotations.filter((F.col("verdict") == "applicable") & ~F.col("check_no").isin(*retired))
            .join(weights.select("check_no", *CHECK), ["check_no", *CHECK], "left_semi")
            .select("task_id", "check_no", *CHECK))


def annotation_mismatches(annotations: DataFrame, weights: DataFrame) -> DataFrame:
    """Annotation rows whose (number, category, name) is not the rubric's."""
    w = weights.select("check_no", F.col("category").alias("rubric_category"), F.col("name").alias("rubric_name"))
    return (annotations.join(w, "check_no", "left")
            .filter(F.col("rubric_name").isNull() | (F.col("category") != F.col("rubric_category"))
                    | (F.col("name") != F.col("rubric_name")))
            .select("task_id", "check_no", "category", "name", "rubric_category", "rubric_name"))


def effective_weights(applicable: DataFrame, weights: DataFrame) -> DataFrame:
    """Per task, the weights of the applicable checks; categories left empty give their weight to the rest."""
    kept = applicable.join(weights.select("check_no", "weight", "category_weight"), "check_no")
    cats = kept.groupBy("task_id", "category").agg(F.max("category_weight").alias("cw"))
    share = cats.groupBy("task_id").agg(F.sum("cw").alias("cw_total"))
    return (kept.join(share, "task_id")
            .select("task_id", "check_no", *CHECK, "weight",
                    (F.col("category_weight") / F.col("cw_total")).alias("category_weight")))


def mistake_counts(judgements: DataFrame, max_mistakes: int = 1) -> DataFrame:
    """One row per attempt and check: worst count, with the incidents that were repaired on the way."""
    bare_fail = (F.lower(F.trim("decision")) == "fail") & (F.col("n_mistakes") == 0)
    counted = judgements.withColumn("m", F.when(bare_fail, max_mistakes).otherwise(F.col("n_mistakes")))
    return counted.groupBy("attempt_id", *CHECK).agg(
        F.max("m").alias("mistakes"),
        F.count(F.lit(1)).alias("n_items"),
        (F.count(F.lit(1)) > 1).alias("duplicate"),
        F.count_if(bare_fail).alias("fail_without_mistakes"),
        F.count_if(F.col("claimed").isNotNull() & (F.col("claimed") != F.col("m"))).alias("count_mismatches"))


def check_scores(counts: DataFrame, weights: DataFrame, max_mistakes: int = 1) -> DataFrame:
    """A row for every attempt and weighted check; a check without judgement counts as ``max_mistakes``.

    The rubric travels as one array in a scalar subquery, so each attempt emits its own
    checks in place and nothing is joined pairwise.
    """
    rubric = weights.agg(F.collect_list(F.struct("category", "name", "weight", "category_weight"))).scalar()
    every = (counts.select("attempt_id").distinct()
             .select("attempt_id", rubric.alias("rubric"))
             .select("attempt_id", F.inline("rubric")))
    scored = every.join(counts.select("attempt_id", *CHECK, "mistakes"), ["attempt_id", *CHECK], "left")
    mistakes = F.coalesce("mistakes", F.lit(max_mistakes))
    return scored.select(
        "attempt_id", *CHECK, "weight", "category_weight", mistakes.alias("mistakes"),
        (F.greatest(F.lit(0), F.lit(max_mistakes) - mistakes) / F.lit(float(max_mistakes))).alias("score"),
        F.col("mistakes").isNull().alias("unscored"))


def category_scores(counts: DataFrame, weights: DataFrame, max_mistakes: int = 1) -> DataFrame:
    """Per attempt and category the weighted mean times 100.

    Unjudged checks score zero, so the sum needs the judged rows only; the divisor is the
    category's whole weight. Two equi-joins with the small rubric, one shuffle on the attempt.
    """
    score = F.greatest(F.lit(0), F.lit(max_mistakes) - F.col("mistakes")) / F.lit(float(max_mistakes))
    won = (counts.join(weights.select(*CHECK, "weight"), CHECK)
           .groupBy("attempt_id", "category")
           .agg(F.sum(score * F.col("weight")).alias("weighted_sum"), F.count(F.lit(1)).alias("n_scored")))
    cats = weights.groupBy("category").agg(F.sum("weight").alias("total_weight"),
                                           F.max("category_weight").alias("category_weight"))
    return won.join(cats, "category").select(
        "attempt_id", "category", "n_scored",
        F.when(F.col("total_weight") > 0, F.col("weighted_sum") / F.col("total_weight") * 100).otherwise(0.0).alias("category_score"),
        "category_weight")


def total_scores(counts: DataFrame, weights: DataFrame, max_mistakes: int = 1) -> DataFrame:
    """The attempt's total: category scores weighted by category; categories without judgement add zero."""
    score = F.greatest(F.lit(0), F.lit(max_mistakes) - F.col("mistakes")) / F.lit(float(max_mistakes))
    cats = weights.groupBy("category").agg(F.sum("weight").alias("total_weight"), F.max("category_weight").alias("category_weight"))
    rubric = weights.select(*CHECK, "weight").join(cats, "category")
    # unweighted judgements stay as rows that add nothing, so an attempt with nothing else still gets its zero
    per = (counts.join(rubric, CHECK, "left").groupBy("attempt_id", "category")
           .agg(F.sum(score * F.col("weight")).alias("s"), F.count("weight").alias("n"), F.max("total_weight").alias("w"), F.max("category_weight").alias("cw")))
    part = F.when(F.col("w") > 0, F.col("s") / F.col("w") * 100).otherwise(0.0) * F.col("cw")
    return (per.groupBy("attempt_id").agg(F.sum(part).alias("t"), F.sum("n").alias("n"))
            .select("attempt_id", F.round(F.coalesce("t", F.lit(0.0)), 6).alias("total_score"), F.col("n").alias("n_scored")))


def one_per_check(judgements: DataFrame) -> DataFrame:
    """The worst judgement of each attempt, check and engine."""
    worst = F.max(F.struct("n_mistakes", "decision")).alias("w")
    return judgements.groupBy("attempt_id", *CHECK, "engine").agg(worst).select(
        "attempt_id", *CHECK, "engine", F.col("w.decision").alias("decision"), F.col("w.n_mistakes").alias("n_mistakes"))


def overlay_verdicts(judge: DataFrame, code: DataFrame, weights: DataFrame) -> DataFrame:
    """Code verdicts replace the judge's where decided and weighted; the judge's stays beside it.

    ``judge`` and ``code`` hold one row per attempt and check. An undecided or unweighted
    code verdict never replaces; a check the judge left out is inserted.
    """
    j = judge.select("attempt_id", *CHECK, F.col("decision").alias("llm_decision"), F.col("n_mistakes").alias("llm_mistakes"))
    c = code.select("attempt_id", *CHECK, F.col("decision").alias("code_decision"), F.col("n_mistakes").alias("code_mistakes"))
    w = weights.select(*CHECK, F.lit(True).alias("weighted"))
    both = j.join(c, ["attempt_id", *CHECK], "full_outer").join(w, CHECK, "left")
    wins = F.col("code_decision").isin("pass", "fail") & F.coalesce("weighted", F.lit(False))
    wins = F.coalesce(wins, F.lit(False))
    return (both.withColumn("wins", wins)
            .filter(F.col("wins") | F.col("llm_decision").isNotNull())
            .select("attempt_id", *CHECK,
                    F.when(F.col("wins"), "code").otherwise("llm").alias("decided_by"),
                    F.when(F.col("wins"), F.col("code_decision")).otherwise(F.col("llm_decision")).alias("decision"),
                    F.when(F.col("wins"), F.col("code_mistakes")).otherwise(F.col("llm_mistakes")).alias("n_mistakes"),
                    "llm_decision", "llm_mistakes"))


def agreement(judge: DataFrame, code: DataFrame) -> DataFrame:
    """Per check: how often both decided, and how often they agreed. Undecided agrees with nothing."""
    j = judge.select("attempt_id", *CHECK, F.col("decision").alias("llm_decision"))
    c = code.select("attempt_id", *CHECK, F.col("decision").alias("code_decision"))
    agreed = F.when(F.col("llm_decision").isNotNull() & (F.col("code_decision") != "undecided"),
                    F.col("llm_decision") == F.col("code_decision"))
    return (c.join(j, ["attempt_id", *CHECK], "left").withColumn("agreed", agreed)
            .groupBy(*CHECK)
            .agg(F.count(F.lit(1)).alias("n_code"), F.count("agreed").alias("n_both"), F.count_if("agreed").alias("n_agreed"),
                 F.round(F.avg(F.col("agreed").cast("double")), 6).alias("agreement_rate")))


def family_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Check keys two verdict families both claim; must be empty before they are united."""
    return a.select("attempt_id", *CHECK).intersect(b.select("attempt_id", *CHECK))


def merge_families(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two families, each row saying whether its key is claimed twice (a bug upstream)."""
    both = a.unionByName(b, allowMissingColumns=True)
    claims = both.groupBy("attempt_id", *CHECK).agg(F.count(F.lit(1)).alias("claims"))
    return both.join(claims, ["attempt_id", *CHECK]).withColumn("conflict", F.col("claims") > 1).drop("claims")


def tag_graders(overlaid: DataFrame) -> DataFrame:
    """Per attempt, how many checks code decided and how many the judge did."""
    return overlaid.groupBy("attempt_id").agg(
        F.count_if(F.col("decided_by") == "code").alias("deterministic"),
        F.count_if(F.col("decided_by") != "code").alias("llm"))


def scoring_warnings(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Per attempt the counts of each scoring hazard, and the failed flag with its reason."""
    known = counts.join(weights.select(*CHECK, F.lit(1).alias("w")), CHECK, "left")
    per = known.groupBy("attempt_id").agg(
        F.count("w").alias("n_weighted"),
        F.count_if("duplicate").alias("duplicate_judgements"),
        F.sum("count_mismatches").alias("mistake_count_mismatches"),
        F.sum("fail_without_mistakes").alias("fail_without_mistakes"),
        F.count_distinct(F.when(F.col("w").isNotNull(), F.col("category"))).alias("n_categories"))
    size = weights.agg(F.count(F.lit(1))).scalar()
    cats = weights.agg(F.count_distinct("category")).scalar()
    per = per.select(
        "attempt_id", (size - F.col("n_weighted")).alias("unscored_checks"),
        (cats - F.col("n_categories")).alias("empty_category_judgements"),
        "duplicate_judgements", "mistake_count_mismatches", "fail_without_mistakes")
    kinds = ["unscored_checks", "empty_category_judgements", "duplicate_judgements",
             "mistake_count_mismatches", "fail_without_mistakes"]
    fired = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in kinds]))
    return per.withColumn("failed", F.size(fired) > 0).withColumn(
        "failed_reason", F.when(F.size(fired) > 0, F.concat(F.lit("Scoring warnings: "), F.array_join(fired, ", "))))


def _money(column: str, digits: int) -> Column:
    """Half away from zero on the decimal text, so that float noise below ten places cannot tip it."""
    return F.round(F.col(column).cast("decimal(20,10)"), digits).cast("double")


def grading_rows(attempts: DataFrame, totals: DataFrame, warnings: DataFrame, grader: str) -> DataFrame:
    """The grading record of each scored attempt."""
    return (totals.join(warnings.select("attempt_id", "failed", "failed_reason"), "attempt_id")
            .join(attempts.select(F.col("id").alias("attempt_id"), "task_id", "prompt_version",
                                  _money("time_taken_min", 4).alias("time_elapsed_min"), _money("cost", 6).alias("cost")),
                  "attempt_id")
            .select("attempt_id", "task_id", F.lit(grader).alias("grader_model"), "prompt_version", "total_score",
                    "time_elapsed_min", "cost", "failed", "failed_reason", F.lit(False).alias("deprecated")))


def dual_engine_totals(judge: DataFrame, code: DataFrame, weights: DataFrame, max_mistakes: int = 1) -> DataFrame:
    """Each attempt's total with code verdicts applied, with the judge's alone, and the difference."""
    overlaid = overlay_verdicts(judge, code, weights).withColumnRenamed("n_mistakes", "mistakes")
    alone = judge.withColumnRenamed("n_mistakes", "mistakes")
    a = total_scores(overlaid, weights, max_mistakes).select("attempt_id", F.col("total_score").alias("code_wins"))
    b = total_scores(alone, weights, max_mistakes).select("attempt_id", F.col("total_score").alias("judge_wins"))
    return (a.join(b, "attempt_id", "full_outer")
            .select("attempt_id", F.coalesce("code_wins", F.lit(0.0)).alias("code_wins"),
                    F.coalesce("judge_wins", F.lit(0.0)).alias("judge_wins"))
            .withColumn("delta", F.round(F.col("code_wins") - F.col("judge_wins"), 6)))


def pinned_checks(configured: DataFrame, pins: DataFrame) -> DataFrame:
    """Configured checks refused: unpinned, pinned to another name, or listed twice."""
    c = configured.groupBy("check_no").agg(F.count(F.lit(1)).alias("listed"), F.max("category").alias("category"),
                                           F.max("name").alias("name"))
    p = pins.select("check_no", F.col("category").alias("pin_category"), F.col("name").alias("pin_name"))
    problem = (F.when(F.col("listed").isNull(), "pin not configured")
               .when(F.col("pin_name").isNull(), "no pin")
               .when((F.col("category") != F.col("pin_category")) | (F.col("name") != F.col("pin_name")), "pin differs")
               .when(F.col("listed") > 1, "listed twice"))
    return (c.join(p, "check_no", "full_outer").withColumn("problem", problem).filter(F.col("problem").isNotNull())
            .select("check_no", "listed", "problem"))


def retry_later(gradings: DataFrame, machine_reasons: list[str]) -> DataFrame:
    """Attempts with a grading that failed for a reason of the machine."""
    failed = gradings.filter(F.col("failed") & F.col("failed_reason").rlike("|".join(machine_reasons)))
    return failed.select("attempt_id", "grader_model").distinct()
