"""A1-A15."""

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import norm_text
from ..operators import answers as O
from . import query

NORM = "trim(lower(trim(regexp_replace(translate({c}, '’‘“”–—−', '''''\"\"---'), '\\s+', ' ', 'g'))), ' .:;')"


def norm(c):
    return NORM.format(c=c)


def word(words):
    return "'(^|[^a-z])(?:" + "|".join(w.replace(".", "\\.") for w in sorted(words, key=len, reverse=True)) + ")([^a-z]|$)'"


@query("a1_norm_text", "text_cells", f"SELECT wb_id, sheet_idx, row_no, col_no, {norm('v_text')} AS norm FROM text_cells")
def _(v):
    return v.text_cells.select("wb_id", "sheet_idx", "row_no", "col_no", norm_text(F.col("v_text")).alias("norm"))


QCELLS = """qc AS (SELECT wb_id, sheet_idx, row_no, col_no, CASE WHEN row_no = 1 + (wb_id + sheet_idx) % 12 AND col_no = 1 THEN ' Question (round to two decimals):' WHEN row_no = 1 + (wb_id + sheet_idx) % 12 AND col_no = 3 THEN 'Answers.'
   WHEN row_no = 1 + (wb_id + sheet_idx) % 12 AND col_no = 5 THEN 'Unit' WHEN col_no = 1 AND v_err IS NULL THEN 'What is item ' || CAST(ref_key AS VARCHAR(9)) || '?' END AS v_text, v_num FROM grid),
hd AS (SELECT a.wb_id, a.sheet_idx, a.row_no AS header_row, a.col_no AS answer_col, CASE WHEN q.wb_id IS NULL THEN 1 ELSE 1 END AS question_col, u.col_no AS unit_col FROM qc a
  LEFT JOIN qc q ON q.wb_id = a.wb_id AND q.sheet_idx = a.sheet_idx AND q.row_no = a.row_no AND q.v_text LIKE ' Question%'
  LEFT JOIN qc u ON u.wb_id = a.wb_id AND u.sheet_idx = a.sheet_idx AND u.row_no = a.row_no AND u.v_text = 'Unit' WHERE a.v_text = 'Answers.' AND a.row_no <= 10)"""


def question_cells(v):
    head = F.col("row_no") == 1 + (F.col("wb_id") + F.col("sheet_idx")) % 12
    col = F.col("col_no")
    text = (F.when(head & (col == 1), " Question (round to two decimals):").when(head & (col == 3), "Answers.").when(head & (col == 5), "Unit")
            .when((col == 1) & F.col("v_err").isNull(), F.concat(F.lit("What is item "), F.col("ref_key").cast("string"), F.lit("?"))))
    return v.grid.select("wb_id", "sheet_idx", "row_no", "col_no", text.alias("v_text"), "v_num")


@query("a2_answer_header", "grid", f"WITH {QCELLS} SELECT * FROM hd")
def _(v):
    return O.answer_header(question_cells(v))


@query("a3_golden_answers", "grid", f"""WITH {QCELLS}
SELECT wb_id, sheet_idx, row_no, label, value, ROW_NUMBER() OVER (PARTITION BY wb_id ORDER BY sheet_idx, row_no) AS qid, lower(label) AS norm_label FROM (
 SELECT q.wb_id, q.sheet_idx, q.row_no, q.v_text AS label, a.v_num AS value FROM hd JOIN qc q ON q.wb_id = hd.wb_id AND q.sheet_idx = hd.sheet_idx AND q.row_no > header_row AND q.col_no = 1
 LEFT JOIN qc a ON a.wb_id = q.wb_id AND a.sheet_idx = q.sheet_idx AND a.row_no = q.row_no AND a.col_no = 3 WHERE q.v_text IS NOT NULL) z""")
def _(v):
    return O.golden_answers(question_cells(v))


@query("a6_answer_column", "grid", f"""WITH {QCELLS},
h AS (SELECT wb_id, sheet_idx, row_no AS header_row, col_no AS answer_col FROM grid WHERE v_err = '#N/A'),
x AS (SELECT q.wb_id, q.sheet_idx, q.row_no, header_row, answer_col, ROW_NUMBER() OVER (PARTITION BY q.wb_id, q.sheet_idx, q.row_no ORDER BY header_row DESC, answer_col DESC) AS k
 FROM qc q JOIN h ON h.wb_id = q.wb_id AND h.sheet_idx = q.sheet_idx AND q.row_no BETWEEN header_row AND header_row + 60 WHERE q.v_text LIKE 'What%')
SELECT wb_id, sheet_idx, row_no, header_row, answer_col FROM x WHERE k = 1""")
def _(v):
    q = question_cells(v).filter("v_text like 'What%'").select("wb_id", "sheet_idx", "row_no")
    h = v.grid.filter("v_err = '#N/A'").select("wb_id", "sheet_idx", "row_no", F.col("col_no").alias("answer_col"))
    return O.answer_column(q, h)


SIDES = f"""g AS (SELECT qid, row_no, {norm('label')} AS nl FROM qa_text WHERE side = 'golden'),
c AS (SELECT row_no, CASE WHEN row_no % 10 = 0 THEN 'Model' WHEN row_no % 3 = 1 THEN 'Answers' ELSE 'Questions' END AS sheet, {norm('label')} AS nl FROM qa_text WHERE side = 'attempt'),
pr AS (SELECT nl, sheet FROM (SELECT nl, sheet, ROW_NUMBER() OVER (PARTITION BY nl ORDER BY CASE sheet WHEN 'Questions' THEN 0 WHEN 'Answers' THEN 2 ELSE 9 END, sheet) AS k FROM (SELECT DISTINCT nl, sheet FROM c) d) q WHERE k = 1),
ex AS (SELECT a.qid, a.nl, b.sheet, b.row_no AS at_row FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY nl ORDER BY row_no, qid) AS k FROM g) a
  JOIN (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY nl ORDER BY row_no) AS k FROM c JOIN pr USING (nl, sheet)) b ON b.nl = a.nl AND b.k = a.k)"""


def sides(v):
    golden = v.qa_text.filter("side = 'golden'").select("qid", "row_no", "label")
    r = F.col("row_no")
    cells = v.qa_text.filter("side = 'attempt'").select(
        F.when(r % 10 == 0, "Model").when(r % 3 == 1, "Answers").otherwise("Questions").alias("sheet"), "row_no", F.lit(1).alias("col_no"), "label")
    return golden, cells


@query("a4_locate_exact", "qa_text", f"WITH {SIDES} SELECT qid, nl AS norm_label, sheet, at_row, 1 AS at_col FROM ex")
def _(v):
    return O.locate_exact(*sides(v), [])


@query("a5_locate_fuzzy", "qa_text", f"""WITH {SIDES}, lf AS (SELECT * FROM g WHERE qid NOT IN (SELECT qid FROM ex)),
pool AS (SELECT * FROM c WHERE sheet IN (SELECT sheet FROM ex) OR (NOT EXISTS (SELECT 1 FROM ex) AND sheet IN ('Questions', 'Answers'))),
p AS (SELECT a.nl, b.nl AS matched, 1 - CAST(levenshtein(a.nl, b.nl) AS DOUBLE) / GREATEST(length(a.nl), length(b.nl)) AS r
  FROM (SELECT DISTINCT nl FROM lf) a, (SELECT DISTINCT nl FROM pool) b WHERE length(a.nl) >= 15 AND length(b.nl) >= 15),
m AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY nl ORDER BY r DESC, matched DESC) AS k FROM p WHERE r >= 0.9 - 1e-12) q WHERE k = 1),
f AS (SELECT * FROM (SELECT nl, sheet, row_no, ROW_NUMBER() OVER (PARTITION BY nl ORDER BY CASE sheet WHEN 'Questions' THEN 0 WHEN 'Answers' THEN 2 ELSE 9 END, sheet, row_no) AS k FROM pool) q WHERE k = 1),
pl AS (SELECT lf.qid, lf.nl AS norm_label, m.matched AS matched_label, ROUND(r, 6) AS ratio, f.sheet, f.row_no AS at_row, 1 AS at_col FROM lf JOIN m ON m.nl = lf.nl JOIN f ON f.nl = m.matched)
SELECT qid, norm_label, matched_label, ratio, sheet, at_row, at_col FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sheet, at_row ORDER BY qid) AS k FROM pl
 WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.sheet = pl.sheet AND ex.at_row = pl.at_row)) q WHERE k = 1""")
def _(v):
    golden, cells = sides(v)
    return O.locate_fuzzy(golden, cells, O.locate_exact(golden, cells, []), [])


NUM = "TRY_CAST(replace(replace(replace(replace({c}, '(', ''), ')', ''), '$', ''), ',', '') AS DOUBLE)"
PARSED = f"""ps AS (SELECT *, CASE WHEN got IS NULL THEN 'empty' WHEN got = '-' OR {NUM.format(c='got')} IS NOT NULL THEN 'number' ELSE 'text' END AS gk,
  CASE WHEN got = '-' THEN 0 WHEN got LIKE '(%' THEN -{NUM.format(c='got')} ELSE {NUM.format(c='got')} END AS b, TRY_CAST(golden AS DOUBLE) AS a FROM answers)"""


@query("a7_parse_scalar", "answers", f"WITH {PARSED} SELECT attempt_id, qid, seq, got, gk AS kind, b AS num, FALSE AS pct FROM ps")
def _(v):
    p = v.answers.withColumn("p", A.parse_scalar(F.col("got")))
    return p.select("attempt_id", "qid", "seq", "got", "p.kind", "p.num", "p.pct")


@query("a7_parse_dates", "", r"""
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS day, CASE WHEN o_orderkey % 5 = 4 THEN 'text' ELSE 'date' END AS kind FROM orders""")
def _(v):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (F.when(k == 4, F.concat(F.lit("13/45/"), F.date_format(d, "yyyy"))).when(k == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(k == 1, F.date_format(d, "M/d/yyyy")).when(k == 2, F.concat(F.date_format(d, "yyyy-M-d"), F.lit(" 00:00:00"))).otherwise(F.date_format(d, "MM/dd/yyyy")))
    p = v.orders.withColumn("p", A.parse_scalar(text))
    return p.select("o_orderkey", F.col("p.day").cast("string").alias("day"), "p.kind")


@query("a8_precision_directive", "answers", """
SELECT attempt_id, qid, seq, CASE seq % 6 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 0 END AS dp, CASE WHEN seq % 6 IN (3, 4) THEN 'percent' ELSE 'value' END AS scale FROM answers""")
def _(v):
    k = F.col("seq") % 6
    head = (F.when(k == 0, F.concat("label", F.lit(" - round your answers to two decimal places"))).when(k == 1, F.concat(F.lit("Whole numbers only: "), "label"))
            .when(k == 2, F.lit("Question (3  decimal places)")).when(k == 3, F.lit("Format return cells as 0.00%")).when(k == 4, F.lit("shown as 0%")).otherwise(F.col("label")))
    p = v.answers.withColumn("p", A.precision_directive(head))
    return p.select("attempt_id", "qid", "seq", "p.dp", "p.scale")


@query("a8_round_digits", "formulas", """
SELECT wb_id, sheet_idx, row_no, col_no, CASE WHEN text LIKE 'IF(%' THEN 2 WHEN text LIKE 'SUM(A1%' THEN 4 WHEN text LIKE 'OFFSET%' THEN NULL END AS digits FROM formulas""")
def _(v):
    t = F.col("text")
    f = F.when(F.startswith(t, F.lit("SUM(A1")), F.concat(F.lit('LET(x,IF(A1="ROUND(1,9)",1,2),ROUND(MAX(ABS('), t, F.lit("),ROUND(x,1)), 4))"))).when(
        F.startswith(t, F.lit("OFFSET")), F.concat(F.lit("ROUNDUP("), t, F.lit(",3)"))).otherwise(t)
    return v.formulas.select("wb_id", "sheet_idx", "row_no", "col_no", A.round_digits(f).alias("digits"))


CONTEXT = """cx AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 2 END AS golden_dp, CASE WHEN seq % 2 = 0 THEN 1 END AS dp FROM ps)"""
TOL = """CASE WHEN dec IS NULL THEN GREATEST(1e-9, 1e-6 * GREATEST(ABS(a), ABS({b}))) ELSE GREATEST(1e-9, 1e-6 * GREATEST(ABS(a), ABS({b})),
  POW(10.0, -dec) * CASE WHEN golden_dp IS NOT NULL AND ABS({b} * POW(10.0, dec) - ROUND({b} * POW(10.0, dec))) <= GREATEST(1e-9, ABS({b} * POW(10.0, dec)) * 1e-12) THEN 1 ELSE 0.5 END * 1.000001) END"""
COMPARED = f"""{CONTEXT}, dc AS (SELECT *, COALESCE(golden_dp, dp) AS dec, label LIKE 'cost of%' AS outflow, label LIKE 'growth rate%' AS pct FROM cx),
tl AS (SELECT *, {TOL.format(b='b')} AS t0, {TOL.format(b='(b * 100)')} AS t1, {TOL.format(b='(b * 0.01)')} AS t2 FROM dc),
ru AS (SELECT *, CASE WHEN gk <> 'number' THEN NULL WHEN a = b THEN 'exact' WHEN ABS(a - b) <= t0 THEN 'tolerance' WHEN pct AND (ABS(a - b * 100) <= t1 OR ABS(a - b * 0.01) <= t2) THEN 'percent_form'
   WHEN outflow AND ABS(ABS(a) - ABS(b)) <= t0 THEN 'sign_outflow' END AS rule FROM tl),
cp AS (SELECT *, CASE WHEN gk = 'empty' THEN 'missing' WHEN rule IS NOT NULL THEN 'match' ELSE 'mismatch' END AS verdict,
  CASE WHEN gk = 'text' THEN 'sentinel_for_numeric' WHEN gk = 'number' AND rule IS NULL AND ABS(ABS(a) - ABS(b)) <= t0 THEN 'sign_flip_not_outflow' ELSE '' END AS flags,
  CASE WHEN gk = 'number' THEN t0 END AS tolerance, CASE WHEN gk = 'number' THEN ABS(a - b) END AS abs_delta,
  CASE WHEN gk = 'number' AND dec IS NOT NULL THEN ABS(b * POW(10.0, dec) - ROUND(b * POW(10.0, dec))) <= GREATEST(1e-9, ABS(b * POW(10.0, dec)) * 1e-12) END AS attempt_rounded FROM ru)"""


def asked(v):
    s = F.col("seq")
    return (v.answers.withColumn("unit", F.lit(None).cast("string")).withColumn("dp", F.when(s % 2 == 0, 1)).withColumn("golden_dp", F.when(s % 3 == 0, 2))
         .withColumn("got_dp", F.lit(None).cast("int")).withColumn("pct_format", F.lit(False)).withColumn("percent_directive", F.lit(False)))


def compared(v):
    return O.compare_answers(asked(v))


@query("a9_tolerance", "answers", f"WITH {PARSED}, {COMPARED} SELECT attempt_id, qid, seq, golden, got, ROUND(tolerance, 9) AS tolerance, dec AS requested_decimals, attempt_rounded FROM cp WHERE gk = 'number'")
def _(v):
    return compared(v).filter("tolerance is not null").select("attempt_id", "qid", "seq", "golden", "got", F.round("tolerance", 9).alias("tolerance"), "requested_decimals", "attempt_rounded")


@query("a10_outflow_percent", "answers", f"""
WITH t AS (SELECT *, {norm('label')} AS n FROM answers)
SELECT attempt_id, qid, seq, regexp_matches(n, {word(A.OUTFLOW_ALWAYS)}) OR (regexp_matches(n, {word(A.OUTFLOW_UNLESS_INFLOW)}) AND NOT regexp_matches(n, {word(A.INFLOW_WORDS)})) AS outflow,
  regexp_matches(n, {word(A.PERCENT_WORDS)}) AS percent FROM t""")
def _(v):
    no = F.lit(False)
    return v.answers.select("attempt_id", "qid", "seq", A.is_outflow(F.col("label")).alias("outflow"),
                            A.is_percent_context(F.col("label"), F.lit(""), no, no, no).alias("percent"))


@query("a11_compare_answers", "answers", f"WITH {PARSED}, {COMPARED} SELECT attempt_id, qid, seq, golden, got, verdict, rule, flags, ROUND(abs_delta, 6) AS abs_delta FROM cp")
def _(v):
    return compared(v).select("attempt_id", "qid", "seq", "golden", "got", "verdict", "rule", "flags", F.round("abs_delta", 6).alias("abs_delta"))


@query("a12_alternates", "answers", f"""WITH {PARSED}, {COMPARED},
al AS (SELECT *, verdict = 'mismatch' AND seq % 4 <> 0 AS retry, TRY_CAST(alternate AS DOUBLE) AS a2 FROM cp),
t2 AS (SELECT * REPLACE (a2 AS a) FROM (SELECT attempt_id, qid, seq, golden, got, verdict, rule, retry, gk, b, a2, a, golden_dp, dec, pct, outflow FROM al) z),
t3 AS (SELECT *, {TOL.format(b='b')} AS t0, {TOL.format(b='(b * 100)')} AS t1, {TOL.format(b='(b * 0.01)')} AS t2 FROM t2),
t4 AS (SELECT *, CASE WHEN NOT retry OR gk <> 'number' THEN NULL WHEN a = b THEN 'exact' WHEN ABS(a - b) <= t0 THEN 'tolerance' WHEN pct AND (ABS(a - b * 100) <= t1 OR ABS(a - b * 0.01) <= t2) THEN 'percent_form'
  WHEN outflow AND ABS(ABS(a) - ABS(b)) <= t0 THEN 'sign_outflow' END AS r2 FROM t3)
SELECT attempt_id, qid, seq, golden, got, r2 IS NOT NULL AS matched_alternate, CASE WHEN r2 IS NOT NULL THEN 'match' ELSE verdict END AS verdict, COALESCE(r2, rule) AS rule FROM t4""")
def _(v):
    d = asked(v).withColumn("alternate_label", F.when(F.col("seq") % 4 != 0, F.upper("label")).otherwise(F.lit("another question")))
    return O.compare_with_alternates(d).select("attempt_id", "qid", "seq", "golden", "got", "matched_alternate", "verdict", "rule")


@query("a13_hardcoded", "answers", f"WITH {PARSED} SELECT attempt_id, qid, seq, got FROM ps WHERE gk = 'number' AND NOT got_formula AND qid <> 7")
def _(v):
    return O.hardcoded(compared(v).withColumn("golden_formula", F.col("qid") != 7)).select("attempt_id", "qid", "seq", "got")


SUMMARY = f"""{COMPARED}, lo AS (SELECT *, gk <> 'text' OR seq % 2 = 0 AS located FROM cp),
base AS (SELECT attempt_id, COUNT(*) AS n_questions, COUNT(CASE WHEN verdict = 'match' THEN 1 END) AS n_match, COUNT(CASE WHEN verdict = 'mismatch' THEN 1 END) AS n_mismatch, COUNT(CASE WHEN verdict = 'missing' THEN 1 END) AS n_missing,
  COUNT(CASE WHEN NOT located THEN 1 END) AS n_unlocated, COUNT(CASE WHEN located AND verdict <> 'missing' THEN 1 END) AS n_answered,
  COUNT(CASE WHEN located AND gk = 'number' AND NOT got_formula AND qid <> 7 THEN 1 END) AS n_hardcoded, COUNT(CASE WHEN located AND verdict <> 'missing' AND attempt_rounded = FALSE THEN 1 END) AS n_unrounded FROM lo GROUP BY attempt_id),
rl AS (SELECT attempt_id, string_agg(rule || '=' || CAST(n AS VARCHAR), ',' ORDER BY rule || '=' || CAST(n AS VARCHAR)) AS rules_fired FROM (SELECT attempt_id, rule, COUNT(*) AS n FROM lo WHERE rule IS NOT NULL GROUP BY 1, 2) q GROUP BY attempt_id),
sm AS (SELECT base.*, COALESCE(rules_fired, '') AS rules_fired, ROUND(n_match / n_questions, 6) AS fraction_correct FROM base LEFT JOIN rl USING (attempt_id))"""


def summary(v):
    c = compared(v).withColumn("golden_formula", F.col("qid") != 7).withColumn("located", (F.col("got_kind") != "text") | (F.col("seq") % 2 == 0))
    return O.answer_summary(c)


@query("a14_answer_summary", "answers", f"WITH {PARSED}, {SUMMARY} SELECT * FROM sm")
def _(v):
    return summary(v)


@query("a15_answer_verdicts", "answers", f"""WITH {PARSED}, {SUMMARY}, q AS (SELECT *, (n_questions - n_unlocated) / n_questions >= 0.5 AS ok, n_mismatch + n_missing + n_hardcoded AS w FROM sm)
SELECT attempt_id, CASE WHEN ok THEN 'harness' ELSE 'llm' END AS accuracy_engine, CASE WHEN ok THEN CASE WHEN w = 0 THEN 'pass' ELSE 'fail' END END AS accuracy, CASE WHEN ok THEN w ELSE 0 END AS n_mistakes,
 CASE WHEN n_answered = 0 THEN 'fail' END AS completeness FROM q""")
def _(v):
    return O.answer_verdicts(summary(v))
