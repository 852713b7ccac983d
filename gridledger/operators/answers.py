"""Answer checking: locate answers, compare them under the tolerance rules, sum them up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import norm_text
from ..session import checkpointed
from .grid import SHEET, stab_join
from .skew import number_rows, once

UNIT_SCALES = (1e3, 1e6, 1e9)


# ---------------------------------------------------------------- where the answers stand


def answer_header(cells: DataFrame, rows: int = 10, cols: int = 8) -> DataFrame:
    """Per sheet the first row with an 'Answers' cell near its corner, and its question and unit columns."""
    t = norm_text(F.col("v_text"))
    near = once(cells.filter(F.col("v_text").isNotNull() & (F.col("row_no") <= rows) & (F.col("col_no") <= cols)), t=t)
    role = (F.when(F.col("t").isin("answers", "answer"), "a").when(F.startswith("t", F.lit("question")), "q").when(F.startswith("t", F.lit("unit")), "u"))
    first = lambda k: F.min(F.when(F.col("role") == k, F.col("col_no")))
    per_row = near.withColumn("role", role).filter("role is not null").groupBy(*SHEET, "row_no").agg(
        first("a").alias("answer_col"), F.coalesce(first("q"), F.lit(1)).alias("question_col"), first("u").alias("unit_col"))
    best = per_row.filter("answer_col is not null").groupBy(*SHEET).agg(
        F.min_by(F.struct("row_no", "answer_col", "question_col", "unit_col"), "row_no").alias("h"))
    return best.select(*SHEET, F.col("h.row_no").alias("header_row"), "h.answer_col", "h.question_col", "h.unit_col")


def golden_answers(cells: DataFrame) -> DataFrame:
    """Questions below the header, numbered per workbook in sheet and row order; rows without a question are skipped."""
    head = answer_header(cells)
    below = cells.join(head, SHEET).filter(F.col("row_no") > F.col("header_row"))
    pick = lambda c, v: F.max(F.when(F.col("col_no") == F.col(c), F.col(v)))
    rows = below.groupBy(*SHEET, "row_no").agg(pick("question_col", "v_text").alias("label"), pick("answer_col", "v_num").alias("value"))
    rows = rows.filter(F.length(F.trim(F.coalesce("label", F.lit("")))) > 0)
    block = F.col("sheet_idx") * 300 + F.floor(F.col("row_no") / 4096)
    return number_rows(rows, ["wb_id"], ["sheet_idx", "row_no"], block, "qid").withColumn("norm_label", norm_text(F.col("label")))


def sheet_priority(sheet: Column) -> Column:
    t = F.lower(F.trim(sheet))
    return (F.when(F.startswith(t, F.lit("questions")), 0).when(F.startswith(t, F.lit("question")), 1)
            .when(F.startswith(t, F.lit("answers")), 2).when(F.startswith(t, F.lit("answer")), 3).otherwise(9))


def locate_exact(golden: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th golden occurrence of a label meets the k-th occurrence in the best sheet that has it.

    ``keys`` (may be empty) name what golden and cells share besides the label, such as the
    attempt. Occurrences are numbered in blocks, so a label repeated everywhere stays spread.
    """
    on = [*keys, "norm_label"]
    g = number_rows(golden.select(*keys, "qid", "row_no", norm_text(F.col("label")).alias("norm_label")),
                    on, ["row_no", "qid"], F.floor(F.col("row_no") / 4096), "k")
    c = cells.select(*keys, "sheet", F.col("row_no").alias("at_row"), F.col("col_no").alias("at_col"), norm_text(F.col("label")).alias("norm_label"))
    best = c.groupBy(*on).agg(F.min(F.struct(sheet_priority(F.col("sheet")).alias("p"), F.col("sheet").alias("s"))).alias("b"))
    c = c.join(best.select(*on, F.col("b.s").alias("sheet")), [*on, "sheet"], "left_semi")
    c = number_rows(c, on, ["at_row", "at_col"], F.floor(F.col("at_row") / 4096), "k")
    return g.join(c, [*on, "k"]).select(*keys, "qid", "norm_label", "sheet", "at_row", "at_col")


def similar_labels(left: DataFrame, right: DataFrame, keys: list[str], ratio: float = 0.90, least: int = 15) -> DataFrame:
    """The most similar right label of each left label, at ``1 - edits / longer length`` of at least ``ratio``.

    Both sides hold distinct labels. With ratio 0.9 a label of length L differs in at most
    L/9 edits, so one of its L/9 + 1 pieces survives whole; each piece has six letters or
    more. The left side offers the first six letters of each piece, the right side all its
    six-letter windows, and only labels that share one are measured. Nothing is missed.
    """
    if ratio < 0.9 or least < 15:
        raise ValueError("the piece filter is exact for ratio >= 0.9 and labels of 15 letters or more")
    n = F.length("a")
    edits = F.floor(n / 9).cast("int")
    starts = F.transform(F.sequence(F.lit(0), edits), lambda i: F.floor(i * n / (edits + 1)).cast("int") + 1)
    a = (left.select(*keys, F.col("norm_label").alias("a")).filter(F.length("a") >= least)
         .withColumn("gram", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("a", i, F.lit(6)))))))
    windows = F.transform(F.sequence(F.lit(1), F.length("b") - 5), lambda i: F.substr("b", i, F.lit(6)))
    b = (right.select(*keys, F.col("norm_label").alias("b")).filter(F.length("b") >= least)
         .withColumn("gram", F.explode(F.array_distinct(windows))))
    longer = F.greatest(F.length("a"), F.length("b"))
    close = F.abs(F.length("a") - F.length("b")) <= F.floor(longer * (1 - ratio) + 1e-9)
    pairs = a.join(b, [*keys, "gram"]).filter(close).select(*keys, "a", "b").distinct()
    scored = once(pairs, ratio=1 - F.levenshtein("a", "b") / longer).filter(F.col("ratio") >= ratio - 1e-12)
    best = scored.groupBy(*keys, "a").agg(F.max(F.struct("ratio", "b")).alias("m"))
    return best.select(*keys, F.col("a").alias("norm_label"), F.col("m.b").alias("matched_label"), F.round("m.ratio", 6).alias("ratio"))


def locate_fuzzy(golden: DataFrame, cells: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """Questions the exact pass left over, each at its most similar label; the first question to claim a row keeps it.

    Labels are sought on the sheets where the exact pass found something, or, where it found nothing, on those
    named for questions or answers.
    """
    g = golden.select(*keys, "qid", norm_text(F.col("label")).alias("norm_label")).join(exact.select(*keys, "qid"), [*keys, "qid"], "left_anti")
    c = cells.select(*keys, "sheet", "row_no", "col_no", norm_text(F.col("label")).alias("norm_label")).withColumn("_all", F.lit(1))
    met = exact.select(*keys, "sheet", F.lit(1).alias("_all")).distinct()
    own = c.join(met, [*keys, "_all", "sheet"], "left_semi")
    named = c.join(met.select(*keys, "_all").distinct(), [*keys, "_all"], "left_anti").filter(sheet_priority(F.col("sheet")) < 9)
    c = own.select(*c.columns).unionByName(named.select(*c.columns)).drop("_all")
    match = similar_labels(g.select(*keys, "norm_label").distinct(), c.select(*keys, "norm_label").distinct(), keys)
    first = c.groupBy(*keys, F.col("norm_label").alias("matched_label")).agg(
        F.min(F.struct(sheet_priority(F.col("sheet")).alias("p"), F.col("sheet"), F.col("row_no"), F.col("col_no"))).alias("at"))
    placed = (g.join(match, [*keys, "norm_label"]).join(first, [*keys, "matched_label"])
              .select(*keys, "qid", "norm_label", "matched_label", "ratio", F.col("at.sheet").alias("sheet"),
                      F.col("at.row_no").alias("at_row"), F.col("at.col_no").alias("at_col")))
    spot = [*keys, "sheet", "at_row"]
    free = placed.join(exact.select(*spot).distinct(), spot, "left_anti")
    winner = free.groupBy(*spot).agg(F.min("qid").alias("qid"))
    return free.join(winner, [*spot, "qid"], "left_semi")


def answer_column(questions: DataFrame, headers: DataFrame, reach: int = 60) -> DataFrame:
    """The answer column of the nearest question header at or above each question, within ``reach`` rows."""
    h = headers.select(*SHEET, F.col("row_no").alias("header_row"), (F.col("row_no") + reach).alias("reach_row"), "answer_col")
    near = stab_join(questions, h, SHEET, "row_no", "header_row", "reach_row")
    return near.groupBy(*questions.columns).agg(F.max(F.struct("header_row", "answer_col")).alias("h")).select(
        *questions.columns, "h.header_row", "h.answer_col")


# ---------------------------------------------------------------- comparison


def _tolerance(a: Column, b: Column) -> Column:
    noise = F.greatest(F.lit(1e-9), F.greatest(F.abs(a), F.abs(b)) * 1e-6)
    scaled = b * F.pow(F.lit(10.0), "dec")
    rounded = F.abs(scaled - F.round(scaled)) <= F.greatest(F.lit(1e-9), F.abs(scaled) * 1e-12)
    rounded = rounded | F.coalesce(F.col("got_dp") <= F.col("dec"), F.lit(False))
    unit = F.pow(F.lit(10.0), -F.col("dec"))
    band = F.when(rounded & F.col("golden_dp").isNotNull(), unit).otherwise(unit / 2) * (1 + 1e-6)
    return F.when(F.col("dec").isNull(), noise).otherwise(F.greatest(noise, band))


INPUTS = ["golden", "got", "label", "unit", "dp", "golden_dp", "got_dp", "pct_format", "percent_directive"]
JUDGED = ["verdict", "rule", "flags", "tolerance", "abs_delta", "requested_decimals", "attempt_rounded", "expected_kind", "got_kind"]


def _read_once(df: DataFrame, column: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds what the texts of a column say; ``read`` adds it to the table of distinct texts (column _text)."""
    said = read(df.select(F.col(column).alias("_text")).distinct())
    return df.join(said, F.col(column).eqNullSafe(F.col("_text")), "left").drop("_text")


def _meet(df: DataFrame, judged: DataFrame, keys: list[str], results: list[str]) -> DataFrame:
    """Every row of ``df`` with the results of its keys, which are one row in ``judged``; null keys are equal."""
    found = judged.select(F.struct(*keys).alias("_asked"), *results)
    # the distinct side divides evenly, so the many rows need no sort
    return df.join(found.hint("shuffle_hash"), F.struct(*keys) == F.col("_asked"), "left").drop("_asked")


def compare_answers(df: DataFrame) -> DataFrame:
    """Adds verdict, rule, flags, tolerance, abs_delta, dec and attempt_rounded to golden / got pairs.

    Input columns: golden, got (texts), label, unit, dp (header decimals), golden_dp and got_dp
    (digits of a ROUND around either side), pct_format, percent_directive. Attempts repeat questions and answers,
    so each combination of inputs is compared once and joined back; the combinations are written, as their texts are
    read from them.
    """
    return _meet(df, _compared(checkpointed(df.select(*INPUTS).distinct())), INPUTS, JUDGED)


def _compared(df: DataFrame) -> DataFrame:
    """``compare_answers`` row by row; ``df`` is a written table without repeats."""
    c = F.col
    text = c("_text")
    worded = _read_once(df, "label", lambda t: once(t, outflow=A.is_outflow(text), pct_words=A.names_percent(text)))
    worded = _read_once(worded, "unit", lambda t: once(t, pct_unit=A.percent_unit(text)))

    def scalar(side: str) -> Callable[[DataFrame], DataFrame]:
        """The fields of a reading as plain columns, e_num and so on."""
        def read(t: DataFrame) -> DataFrame:
            parsed = t.select("_text", F.inline(F.array(A.parse_scalar(text))))
            parsed = parsed.withColumnsRenamed({x: f"{side}_{x}" for x in parsed.columns if x != "_text"})
            return once(parsed, **{f"{side}_sentinel": F.coalesce(A.is_sentinel(text), F.lit(False)), f"{side}_norm": norm_text(text), f"{side}_says": A.text_yes(text)})
        return read

    worded = _read_once(_read_once(worded, "golden", scalar("e")), "got", scalar("g"))
    d = once(worded, dec=F.coalesce(c("golden_dp"), c("dp") + F.when(c("pct_format"), 2).otherwise(0)))
    a, b = c("e_num"), c("g_num")
    scaled = b * F.pow(F.lit(10.0), "dec")
    d = once(d, pct=F.coalesce(c("pct_words"), F.lit(False)) | c("g_pct") | c("pct_format") | c("percent_directive") | c("pct_unit"),
             tol=_tolerance(a, b), tol_up=_tolerance(a, b * 100), tol_down=_tolerance(a, b * 0.01),
             is_round=(F.abs(scaled - F.round(scaled)) <= F.greatest(F.lit(1e-9), F.abs(scaled) * 1e-12)) | F.coalesce(c("got_dp") <= c("dec"), F.lit(False)))

    def near(x: Column, y: Column, tol: str) -> Column:
        return F.abs(x - y) <= c(tol)

    numbers = (F.when(a == b, "exact").when(near(a, b, "tol"), "tolerance")
               .when(c("pct") & near(a, b * 100, "tol_up"), "percent_form")
               .when(c("pct") & F.coalesce(c("outflow"), F.lit(False)) & near(F.abs(a), F.abs(b * 100), "tol_up"), "sign_outflow+percent_form")
               .when(c("pct") & near(a, b * 0.01, "tol_down"), "percent_form")
               .when(c("pct") & F.coalesce(c("outflow"), F.lit(False)) & near(F.abs(a), F.abs(b * 0.01), "tol_down"), "sign_outflow+percent_form")
               .when(F.coalesce(c("outflow"), F.lit(False)) & near(F.abs(a), F.abs(b), "tol"), "sign_outflow"))
    e_day = F.when(c("e_kind") == "date", c("e_day")).when(c("e_kind") == "number", A.serial_to_date(a))
    g_day = F.when(c("g_kind") == "date", c("g_day")).when(c("g_kind") == "number", A.serial_to_date(b))
    e_yes = F.when(c("e_kind") == "bool", c("e_yes")).when(c("e_kind") == "text", c("e_says"))
    g_yes = F.when(c("g_kind") == "bool", c("g_yes")).when(c("g_kind") == "text", c("g_says"))
    texts = F.when(c("e_sentinel") & c("g_sentinel"), "sentinel_synonym").when(c("e_norm") == c("g_norm"), "exact")
    both = lambda k: (c("e_kind") == k) & (c("g_kind") == k)
    some = lambda k: (c("e_kind") == k) | (c("g_kind") == k)
    rule = (F.when(some("empty"), None).when(both("number"), numbers)
            .when(some("date"), F.when(e_day == g_day, "date_form"))
            .when(some("bool"), F.when(e_yes == g_yes, "exact")).when(both("text"), texts))
    d = once(d, rule=rule)
    ratio = F.abs(a / F.nullif(b, F.lit(0.0)))
    scale_off = F.lit(False)
    for f in UNIT_SCALES:
        scale_off = scale_off | (F.abs(ratio - f) <= f * 1e-6) | (F.abs(ratio - 1 / f) <= 1e-6 / f)
    miss = both("number") & c("rule").isNull()
    # the tolerance that made the match, and the value it was measured on
    form = F.when(c("rule") == "tolerance", F.struct(c("tol").alias("tol"), b.alias("b"))).when(
        c("rule") == "percent_form", F.when(near(a, b * 100, "tol_up"), F.struct(c("tol_up").alias("tol"), (b * 100).alias("b")))
        .otherwise(F.struct(c("tol_down").alias("tol"), (b * 0.01).alias("b"))))
    coarse = (c("dec").isNotNull() & (a != 0) & (form["tol"] / F.abs(a) > 0.01)
              & (form["tol"] > F.greatest(F.lit(1e-9), F.greatest(F.abs(a), F.abs(form["b"])) * 1e-6)))
    mixed = (c("e_kind") != c("g_kind")) & ~some("empty") & ~some("date") & ~(some("bool") & e_yes.isNotNull() & g_yes.isNotNull())
    sentinel = mixed & (c("e_kind") == "number") & (c("g_kind") == "text") & c("g_sentinel")
    kinds = [("coarse_rounding", coarse), ("expected_also_blank", both("empty")),
             ("missing_expected", (c("e_kind") == "empty") & (c("g_kind") != "empty")),
             ("possible_unit_scale_difference", miss & (a != 0) & scale_off), ("sentinel_for_numeric", sentinel),
             ("sign_flip_not_outflow", miss & near(F.abs(a), F.abs(b), "tol")), ("type_mismatch", mixed & ~sentinel)]
    flags = F.concat_ws(",", *[F.when(F.coalesce(w, F.lit(False)), F.lit(k)) for k, w in kinds])
    verdict = F.when(some("empty"), "missing").when(c("rule").isNotNull(), "match").otherwise("mismatch")
    return d.select(*df.columns, verdict.alias("verdict"), "rule", flags.alias("flags"),
                    F.when(both("number"), c("tol")).alias("tolerance"), F.when(both("number"), F.abs(a - b)).alias("abs_delta"),
                    F.col("dec").alias("requested_decimals"), F.when(both("number") & c("dec").isNotNull(), c("is_round")).alias("attempt_rounded"),
                    c("e_kind").alias("expected_kind"), c("g_kind").alias("got_kind"))


def with_alternates(compared: DataFrame) -> DataFrame:
    """A mismatch is compared again with the question's second accepted answer, if its label agrees.

    ``compared`` carries alternate and alternate_label (null where there is none).
    """
    dropped = [x for x in (*INPUTS, *JUDGED) if x not in ("golden", "got", "label", "verdict", "rule")]
    return _retried(compared).drop(*dropped)


def compare_with_alternates(df: DataFrame) -> DataFrame:
    """``with_alternates`` of ``compare_answers``, where only distinct questions and answers are compared, both times.

    ``df`` has their columns; the rows meet the verdicts in one join.
    """
    keys = [*INPUTS, "alternate", "alternate_label"]
    return _meet(df, _retried(_compared(checkpointed(df.select(*keys).distinct()))), keys, ["matched_alternate", "verdict", "rule"])


def _retried(compared: DataFrame) -> DataFrame:
    """``compared`` with matched_alternate, and verdict and rule after the second comparison."""
    base = compared.withColumnsRenamed({"verdict": "verdict_1", "rule": "rule_1", "golden": "golden_1"})
    again = compare_answers(base.drop(*JUDGED).withColumn("golden", _retry()))
    matched = F.col("verdict_1").eqNullSafe(F.lit("mismatch")) & F.col("golden").isNotNull() & (F.col("verdict") == "match")
    kept = [x for x in again.columns if x not in ("verdict_1", "rule_1", "golden_1", "golden", "verdict", "rule")]
    return again.select(*kept, F.col("golden_1").alias("golden"), matched.alias("matched_alternate"),
                        F.when(matched, "match").otherwise(F.col("verdict_1")).alias("verdict"),
                        F.when(matched, F.col("rule")).otherwise(F.col("rule_1")).alias("rule"))


def _retry() -> Column:
    """The alternate as golden text where the row is to be compared again, else null."""
    verdict = F.col("verdict_1") == "mismatch"
    label_ok = norm_text(F.col("alternate_label")) == norm_text(F.col("label"))
    return F.when(verdict & F.col("alternate").isNotNull() & label_ok, F.col("alternate"))


def hardcoded(compared: DataFrame) -> DataFrame:
    """Numeric constants where the golden answer is a live formula."""
    return compared.filter(~F.col("got_formula") & F.col("golden_formula") & (F.col("expected_kind") == "number") & (F.col("got_kind") == "number"))


def answer_summary(compared: DataFrame) -> DataFrame:
    """Per attempt the counts of verdicts and facts, and the rules that fired as 'rule=n' text.

    ``compared`` adds located, got_formula, golden_formula. It is read once: all counts are summed per rule
    before they meet, so the list per attempt is as long as the rulebook.
    """
    v = F.col("verdict")
    hard = ~F.col("got_formula") & F.col("golden_formula") & (F.col("expected_kind") == "number") & (F.col("got_kind") == "number") & F.col("located")
    answered = F.col("located") & (v != "missing")
    counts = {"n_questions": F.lit(True), "n_match": v == "match", "n_mismatch": v == "mismatch", "n_missing": v == "missing",
              "n_unlocated": ~F.col("located"), "n_answered": answered, "n_hardcoded": hard,
              "n_unrounded": answered & ~F.coalesce("attempt_rounded", F.lit(True))}
    fired = F.when(F.col("rule").isNotNull(), F.concat("rule", F.lit("="), F.col("n_questions").cast("string")))
    per_rule = compared.groupBy("attempt_id", "rule").agg(*[F.count_if(w).alias(n) for n, w in counts.items()])
    return (per_rule.groupBy("attempt_id").agg(*[F.sum(n).alias(n) for n in counts], F.array_join(F.array_sort(F.collect_list(fired)), ",").alias("rules_fired"))
            .withColumn("fraction_correct", F.round(F.col("n_match") / F.col("n_questions"), 6)))


def answer_verdicts(summary: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Accuracy is decided where at least half the questions were found; completeness only when nothing is answered."""
    located = F.col("n_questions") - F.col("n_unlocated")
    trusted = located / F.col("n_questions") >= least_share
    wrong = F.col("n_mismatch") + F.col("n_missing") + F.col("n_hardcoded")
    return summary.select(
        "attempt_id", F.when(trusted, "harness").otherwise("llm").alias("accuracy_engine"),
        F.when(trusted, F.when(wrong == 0, "pass").otherwise("fail")).alias("accuracy"),
        F.when(trusted, wrong).otherwise(0).alias("n_mistakes"),
        F.when(F.col("n_answered") == 0, "fail").alias("completeness"))
