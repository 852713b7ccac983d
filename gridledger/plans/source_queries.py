"""S1-S16: each round trip writes what the tables hold to a new folder and reads it back."""

import io
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import FIXTURES
from ..operators.grid import shared_texts
from ..session import checkpointed, fresh_folder
from ..sources import logs as L
from ..sources import packages
from ..sources import sinks as K
from ..sources import workbooks as W
from . import query

TIME = "strftime(start_time, '%Y-%m-%d %H:%M:%S')"


def attempt_files(v, duplicate=False):
    """The attempts as JSON lines, one folder per cohort."""
    folder = fresh_folder(v.spark, "attempts")
    a = v.attempts.withColumn("start_time", F.col("start_time").cast("timestamp"))
    if duplicate:
        again = a.filter("cost > 4.5").withColumn("agent_model_name", F.lit("copied"))
        nameless = a.filter("cost < 0.02").withColumn("id", F.lit(None).cast("long"))
        a = a.unionByName(again).unionByName(nameless)
    K.append_rows(a.withColumn("label", F.col("agent_model_name")), a.withColumn("label", F.lit("")), folder, "label")
    return folder


@query("s1_read_attempts", "attempts", f"SELECT id, task_id, agent_model_name, prompt_version, {TIME} AS start_time, cost, agent_failed, deprecated FROM attempts")
def _(v):
    d = L.read_attempts(v.spark, attempt_files(v))
    return d.select("id", "task_id", "agent_model_name", "prompt_version", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"), "cost", "agent_failed", "deprecated")


@query("s1_read_attempts_lenient", "attempts", "SELECT id, task_id FROM attempts WHERE NOT agent_failed")
def _(v):
    folder = fresh_folder(v.spark, "mixed")
    line = F.to_json(F.struct("id", "task_id", "agent_failed"))
    torn = F.when(F.col("agent_failed"), F.substring(line, 1, 12)).otherwise(line)
    v.attempts.select(torn.alias("value")).write.text(folder)
    return L.read_attempts(v.spark, folder, strict=False).select("id", "task_id")


@query("s2_assert_unique_ids", "attempts", """
SELECT id, COUNT(*) AS n, CASE WHEN id IS NULL THEN 'no id' ELSE 'repeated id' END AS problem FROM (
 SELECT id FROM attempts UNION ALL SELECT id FROM attempts WHERE cost > 4.5 UNION ALL SELECT NULL FROM attempts WHERE cost < 0.02) a GROUP BY id HAVING id IS NULL OR COUNT(*) > 1""")
def _(v):
    return L.duplicate_ids(L.read_attempts(v.spark, attempt_files(v, True))).select("id", "n", "problem")


@query("s3_read_tasks", "tasks", "SELECT task_id, task_name, model_type FROM tasks ORDER BY task_id")
def _(v):
    folder = fresh_folder(v.spark, "tasks")
    v.tasks.write.json(folder)
    return L.read_tasks(v.spark, folder).select("task_id", "task_name", "model_type")


def raw_files():
    k, p = F.col("id") % 5, F.concat(F.lit("out/"), F.col("id").cast("string"))
    return (F.when(k == 0, F.concat(p, F.lit("/notes.txt"))).when(k == 1, F.concat(F.lit('["'), p, F.lit('/a.pdf", "'), p, F.lit('/model.xlsx"]')))
            .when(k == 2, F.concat(F.lit('[{"name": "Book.XLSM", "path": "'), p, F.lit('/blob1"}, {"path": "'), p, F.lit('/b.csv"}]')))
            .when(k == 3, F.concat(F.lit('{"m.xls": "'), p, F.lit('/m"}'))))


@query("s4_file_refs", "attempts", """
SELECT id, CASE id % 5 WHEN 0 THEN 'notes.txt' WHEN 1 THEN 'a.pdf' WHEN 2 THEN 'Book.XLSM' ELSE 'm.xls' END AS name,
 'out/' || CAST(id AS VARCHAR) || CASE id % 5 WHEN 0 THEN '/notes.txt' WHEN 1 THEN '/a.pdf' WHEN 2 THEN '/blob1' ELSE '/m' END AS path FROM attempts WHERE id % 5 < 4
UNION ALL SELECT id, CASE id % 5 WHEN 1 THEN 'model.xlsx' ELSE 'b.csv' END, 'out/' || CAST(id AS VARCHAR) || CASE id % 5 WHEN 1 THEN '/model.xlsx' ELSE '/b.csv' END FROM attempts WHERE id % 5 IN (1, 2)""")
def _(v):
    return v.attempts.select("id", F.inline(L.file_refs(raw_files())))


@query("s5_workbook_path", "attempts", """
SELECT id, 'out/' || CAST(id AS VARCHAR) || CASE id % 5 WHEN 1 THEN '/model.xlsx' WHEN 2 THEN '/blob1' WHEN 3 THEN '/m' END AS workbook FROM attempts""")
def _(v):
    return v.attempts.select("id", L.workbook_path(L.file_refs(raw_files())).alias("workbook"))


# a weights document per region: nations are its categories, suppliers its checks
@query("s6_read_weights", "", """
SELECT r_name AS region, n_name AS category, s_name AS name, s_acctbal AS weight, CAST(n_nationkey % 7 AS DOUBLE) / 10 AS category_weight
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(v):
    n = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey"))
    checks = (v.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name", (F.col("n_nationkey") % 7 / 10.0).alias("cw"))
              .agg(F.collect_list(F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("weight"))).alias("items")))
    docs = checks.groupBy("r_name").agg(
        F.concat(F.lit('{"CategoryWeights": ['), F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "cw")))), F.lit("], "),
                 F.substring(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "items")))), 2, 1 << 30)).alias("doc"))
    return L.read_weights(docs.withColumnRenamed("r_name", "region"), "doc", ["region"])


@query("s7_read_alternates", "answers", "SELECT DISTINCT attempt_id AS task_id, qid, label, golden, alternate FROM answers")
def _(v):
    folder = fresh_folder(v.spark, "alternates")
    q = v.answers.select("attempt_id", "qid", "label", "golden", "alternate").distinct()
    (q.groupBy(F.col("attempt_id").alias("task_id")).agg(F.collect_list(F.struct("qid", "label", "golden", "alternate")).alias("questions"))
     .write.json(folder))
    return L.read_alternates(v.spark, folder)


@query("s8_read_trajectory", "calls", "SELECT attempt_id, step, model, prompt_tokens, completion_tokens FROM calls WHERE type IN ('assistant', 'tool')")
def _(v):
    folder = fresh_folder(v.spark, "trajectory")
    kind = F.when(F.col("type").isin("assistant", "tool"), "call").when(F.col("type") == "result", "end").otherwise("event")
    rows = v.calls.select(kind.alias("type"), F.col("ts").cast("timestamp").alias("ts"), "step", "attempt_id", "model",
                          F.when(kind == "call", F.struct("prompt_tokens", "completion_tokens")).alias("usage"), F.when(kind == "event", F.col("props")).alias("payload"))
    rows.write.option("compression", "gzip").json(folder)
    return L.read_trajectory(v.spark, folder, "call").select("attempt_id", "step", "model", "usage.prompt_tokens", "usage.completion_tokens")


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _zip_books(folder):
    def run(batches):
        for batch in batches:
            for wb, names, sheets, strings in zip(batch.wb_id, batch.names, batch.sheets, batch.strings):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}"><sheets>' + "".join(f'<sheet name="S{n}" sheetId="{n + 1}"/>' for n in names) + "</sheets></workbook>")
                    z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{strings}</sst>')
                    for n, body in zip(names, sheets):
                        z.writestr(f"xl/worksheets/sheet{n}.xml", body)
                yield pd.DataFrame({"path": [f"wb{wb}.xlsx"], "content": [buffer.getvalue()]})
    return run


def _zipped_parts(zipped):
    """Packages made and opened in one worker, one at a time: no batch of packages passes between workers."""
    unzip = W._unzip(1 << 14)
    return lambda batches: unzip(zipped(batches))


def workbook_rows(v):
    """The grid as .xlsx files, one row a file before it is zipped: numbers, errors, shared strings, formulas, merges and rules.

    Only the tests' input is made here; its sheets are small by construction.
    """
    x = F.lit
    g = v.grid.join(v.formulas.select("wb_id", "sheet_idx", "row_no", "col_no", "text"), ["wb_id", "sheet_idx", "row_no", "col_no"])
    ref = F.concat(F.char(F.col("col_no") + 64), F.col("row_no").cast("string"))
    f = F.concat(x("<f>"), F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), x("</f>"))
    head = F.concat(x('<c r="'), ref, x('" s="'), F.col("style_id").cast("string"), x('"'))
    cell = (F.when(F.col("v_err").isNotNull(), F.concat(head, x(' t="e">'), f, x("<v>"), F.col("v_err"), x("</v></c>")))
            .when(F.col("v_num") == 0, F.concat(head, x(' t="s"><v>'), (F.col("style_id") % 3).cast("string"), x("</v></c>")))
            .when(F.col("v_num") < 0, F.concat(head, x(">"), f, x("<v>"), F.col("v_num").cast("string"), x("</v></c>")))
            .otherwise(F.concat(head, x("><v>"), F.col("v_num").cast("string"), x("</v></c>"))))
    join = lambda key, item: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, item))), lambda s: s[item]), "")
    rows = g.withColumn("cell", cell).groupBy("wb_id", "sheet_idx", "row_no").agg(join("col_no", "cell").alias("cs"), F.max("ref_key").alias("h"))
    rows = rows.withColumn("row", F.concat(x('<row r="'), F.col("row_no").cast("string"), x('" ht="'), (F.col("h") % 90 + 5).cast("string"), x('" customHeight="1">'), "cs", x("</row>")))
    sheets = rows.groupBy("wb_id", "sheet_idx").agg(join("row_no", "row").alias("rows"), F.max("row_no").alias("last"))
    last = F.col("last").cast("string")
    body = F.concat(x(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"/></sheetViews><sheetData>'), "rows",
                    x('</sheetData><mergeCells count="2"><mergeCell ref="A1:B2"/><mergeCell ref="C'), last, x(':D'), last,
                    x('"/></mergeCells><conditionalFormatting sqref="A1:A9 C3"><cfRule type="cellIs" priority="1" operator="lessThan"><formula>0</formula></cfRule></conditionalFormatting>'
                      '<dataValidations count="1"><dataValidation type="whole" showErrorMessage="1" sqref="B2"><formula1>1</formula1></dataValidation></dataValidations></worksheet>'))
    books = (sheets.withColumn("body", body).groupBy("wb_id").agg(F.array_sort(F.collect_list(F.struct("sheet_idx", "body"))).alias("b"))
             .select("wb_id", F.transform("b", lambda b: b["sheet_idx"]).alias("names"), F.transform("b", lambda b: b["body"]).alias("sheets"),
                     F.lit("<si><t>alpha</t></si><si><r><t>be</t></r><r><t>ta</t></r></si><si><t>a &amp; b</t></si>").alias("strings")))
    return books


def parts(v):
    """Members of the corpus's workbooks, through the same unzip step the file reader uses."""
    # the digest behind the path is not part of the comparison
    return workbook_rows(v).mapInPandas(_zipped_parts(_zip_books(None)), W.PARTS).withColumn("wb_id", F.substring_index("wb_id", "#", 1))


@query("s9_workbook_parts", "sheets", """
SELECT 'wb' || CAST(wb_id AS VARCHAR) || '.xlsx' AS wb_id, COUNT(*) + 2 AS n_parts FROM sheets GROUP BY wb_id""")
def _(v):
    return parts(v).groupBy("wb_id").agg(F.count_distinct("part").alias("n_parts"))


BOOK = "'wb' || CAST(wb_id AS VARCHAR) || '.xlsx' AS wb_id, 'xl/worksheets/sheet' || CAST(sheet_idx AS VARCHAR) || '.xml' AS part"


@query("s10_cells_from_parts", "grid formulas", f"""
SELECT {BOOK.replace('CAST(wb_id', 'CAST(g.wb_id').replace('CAST(sheet_idx', 'CAST(g.sheet_idx')}, g.row_no, g.col_no, CASE WHEN v_err IS NOT NULL THEN 'error' WHEN v_num = 0 THEN 'text' ELSE 'number' END AS kind,
 CASE WHEN v_err IS NULL AND v_num <> 0 THEN v_num END AS v_num, CASE WHEN v_err IS NULL AND v_num = 0 THEN CASE style_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'a & b' END END AS v_text, v_err, style_id,
 CASE WHEN v_err IS NOT NULL OR v_num < 0 THEN f.text END AS formula
FROM grid g JOIN formulas f ON f.wb_id = g.wb_id AND f.sheet_idx = g.sheet_idx AND f.row_no = g.row_no AND f.col_no = g.col_no""")
def _(v):
    return W.cells_from_parts(parts(v)).select("wb_id", "part", "row_no", "col_no", "kind", "v_num", "v_text", "v_err", "style_id", "formula")


@query("s10_rows_meta", "grid", f"SELECT {BOOK}, row_no, CAST(MAX(ref_key) % 90 + 5 AS DOUBLE) AS height, TRUE AS custom FROM grid GROUP BY wb_id, sheet_idx, row_no")
def _(v):
    return W.rows_meta(parts(v)).select("wb_id", "part", "row_no", "height", "custom")


@query("s11_sheet_tail", "sheets", f"""
SELECT {BOOK}, 'merge' AS what, 1 AS r1, 1 AS c1, 2 AS r2, 2 AS c2 FROM sheets UNION ALL SELECT {BOOK}, 'merge', max_row, 3, max_row, 4 FROM sheets
UNION ALL SELECT {BOOK}, 'cellIs', 1, 1, 9, 1 FROM sheets UNION ALL SELECT {BOOK}, 'cellIs', 3, 3, 3, 3 FROM sheets UNION ALL SELECT {BOOK}, 'whole', 2, 2, 2, 2 FROM sheets""")
def _(v):
    t = W.sheet_tail(parts(v))
    cols = ["r1", "c1", "r2", "c2"]
    return (t["merges"].select("wb_id", "part", F.lit("merge").alias("what"), *cols)
            .unionByName(t["cf_rules"].select("wb_id", "part", F.col("rule_type").alias("what"), *cols))
            .unionByName(t["validations"].select("wb_id", "part", F.col("type").alias("what"), *cols)))


@query("s12_file_inventory", "", """
SELECT CAST(page_id % 16 AS VARCHAR) AS folder, 'txt' AS extension, COUNT(DISTINCT page_id % 16) AS n_files, CAST(SUM(octet_length(encode(url)) + length(CAST(page_id AS VARCHAR)) + 2) AS BIGINT) AS size FROM pages GROUP BY 1""")
def _(v):
    """Files written from the pages, a folder and one file for each sixteenth of the keys."""
    folder = fresh_folder(v.spark, "inventory")
    lines = v.pages.select((F.col("page_id") % 16).alias("folder"), F.concat_ws(" ", F.col("page_id").cast("string"), "url").alias("value"))
    lines.repartition("folder").write.partitionBy("folder").text(folder)
    return (W.file_inventory(v.spark, folder, "*.txt").groupBy("folder", "extension")
            .agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("size")))


@query("s13_append_attempts", "attempts", "SELECT id, agent_model_name AS label, cost FROM attempts UNION ALL SELECT id, 'late', NULL FROM attempts WHERE agent_failed")
def _(v):
    folder = fresh_folder(v.spark, "append")
    table = v.attempts.select("id", F.col("agent_model_name").alias("label"), "cost")
    K.append_rows(table, table, folder, "label")
    K.append_rows(v.attempts.filter("agent_failed").select("id", F.lit("late").alias("label")), table, folder, "label")
    return v.spark.read.schema("id BIGINT, cost DOUBLE, label STRING").json(folder)


@query("s14_append_gradings", "gradings", "SELECT attempt_id, grader_model, COUNT(*) AS n_rows, 1 AS n_ids FROM gradings GROUP BY 1, 2")
def _(v):
    folder = fresh_folder(v.spark, "gradings")
    g = K.with_grading_id(v.gradings, "run-1")
    K.append_rows(g, g, folder, "grader_model")
    back = v.spark.read.schema("id BIGINT, attempt_id BIGINT, failed BOOLEAN, deprecated BOOLEAN, grader_model STRING").json(folder)
    return back.groupBy("attempt_id", "grader_model").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))


@query("s13_append_once", "attempts", "SELECT id, agent_model_name AS label, cost FROM attempts UNION ALL SELECT id, 'late', NULL FROM attempts WHERE agent_failed")
def _(v):
    """Each batch is written twice, and one more is torn: its rows lie there without a commit."""
    folder = fresh_folder(v.spark, "once")
    table = v.attempts.select("id", F.col("agent_model_name").alias("label"), "cost")
    late = v.attempts.filter("agent_failed").select("id", F.lit("late").alias("label"))
    for _ in range(2):
        K.append_once(table, table, folder, "label", "first")
        K.append_once(late, table, folder, "label", "late-1")
    table.write.partitionBy("label").json(f"{folder}/rows/batch=torn/try=0")
    return K.read_committed(v.spark, folder, "id BIGINT, cost DOUBLE, label STRING")


@query("s15_export_sheet_grid", "grid", """
WITH c AS (SELECT wb_id, sheet_idx, row_no, k.col, (SELECT MAX(col_no) FROM grid x WHERE x.wb_id = g.wb_id AND x.sheet_idx = g.sheet_idx AND x.row_no = g.row_no) AS n
  FROM (SELECT DISTINCT wb_id, sheet_idx, row_no FROM grid) g, (SELECT UNNEST(range(1, 8)) AS col) k)
SELECT c.wb_id, c.sheet_idx, c.row_no, string_agg(COALESCE(CASE WHEN v_err IS NOT NULL THEN v_err || '|=A1' ELSE printf('%.2f', v_num) END, ''), ',' ORDER BY c.col) AS line
FROM c LEFT JOIN grid g ON g.wb_id = c.wb_id AND g.sheet_idx = c.sheet_idx AND g.row_no = c.row_no AND g.col_no = c.col WHERE c.col <= n GROUP BY 1, 2, 3""")
def _(v):
    shown = F.coalesce("v_err", F.format_string("%.2f", F.col("v_num")))
    cells = v.grid.select("wb_id", "sheet_idx", "row_no", "col_no", shown.alias("shown"), F.when(F.col("v_err").isNotNull(), "A1").alias("formula"))
    return K.sheet_lines(cells, ["wb_id", "sheet_idx"])


@query("s16_verify_manifest", "", """
SELECT url || '#' || CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 7 = 0 THEN 'MISSING' ELSE 'DIFFERS' END AS problem FROM pages WHERE page_id % 7 = 0 OR length(html) % 5 = 0""")
def _(v):
    p = v.pages.select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("content"), "page_id", F.length("html").alias("n"))
    wrong = F.col("n") % 5 == 0
    manifest = p.select("path", F.octet_length("content").alias("size"), F.when(wrong, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"))
    moved = p.withColumn("path", F.when(F.col("page_id") % 7 == 0, F.concat("path", F.lit(".moved"))).otherwise(F.col("path")))
    return W.verify_manifest(manifest, moved)


# ---- from files to verdicts: whole packages with styles, theme, views and shared formulas
def _cell(col, row, rows="d", cols="e"):
    """SQL of a relative reference of the master, moved; #REF! left of the grid."""
    return f"CASE WHEN {col} + {cols} < 1 THEN '#REF!' ELSE chr(CAST(64 + {col} + {cols} AS INT)) || CAST({row} + {rows} AS VARCHAR) END"


# formulas of two neighbouring columns are one shared formula; its first cell by row and column is the master
MOVED = f"""fc AS (SELECT f.wb_id, f.sheet_idx, f.row_no, f.col_no, f.text, f.font_rgb, (f.col_no - 1) // 2 AS si FROM formulas f),
ms AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY wb_id, sheet_idx, si ORDER BY row_no, col_no) AS k FROM fc) q WHERE k = 1),
mv AS (SELECT fc.wb_id, fc.sheet_idx, fc.row_no, fc.col_no, fc.font_rgb, ms.text AS mt, ms.row_no AS mr, ms.col_no AS mc, fc.row_no - ms.row_no AS d, fc.col_no - ms.col_no AS e
 FROM fc JOIN ms ON ms.wb_id = fc.wb_id AND ms.sheet_idx = fc.sheet_idx AND ms.si = fc.si),
moved AS (SELECT wb_id, sheet_idx, row_no, col_no, font_rgb, CASE WHEN mt LIKE 'SUM(A1:A%' THEN 'SUM(' || CASE WHEN e < 0 THEN '#REF!' ELSE {_cell('1', '1')} || ':' || {_cell('1', 'mr')} END || ')'
 WHEN mt LIKE 'S1!B%' THEN 'S1!' || {_cell('2', 'mr')} WHEN mt LIKE 'S2!C3*B%' THEN 'S2!' || {_cell('3', '3')} || '*' || {_cell('2', 'mr')}
 WHEN mt LIKE 'OFFSET(%' THEN 'OFFSET(' || {_cell('1', '1')} || ',1,' || CAST(mc AS VARCHAR) || ')' WHEN mt LIKE 'SUM(B:B)%' THEN 'SUM(' || chr(CAST(66 + e AS INT)) || ':' || chr(CAST(66 + e AS INT)) || ')/2'
 WHEN mt LIKE '[1]%' THEN '[1]Rates!$B$2*' || {_cell('3', 'mr')} WHEN mt LIKE 'IF(%' THEN 'IF(' || {_cell('1', '1')} || '="OFFSET(",ROUND(' || {_cell('2', '2')} || ',2),WACC)' ELSE mt END AS text FROM mv)"""


def shared_groups(v):
    """The formulas with only the master's text written."""
    f = v.formulas.withColumn("si", F.floor((F.col("col_no") - 1) / 2).cast("int"))
    first = f.groupBy("wb_id", "sheet_idx", "si").agg(F.min(F.struct("row_no", "col_no")).alias("m"))
    return f.join(first, ["wb_id", "sheet_idx", "si"]).withColumn("formula", F.when((F.col("row_no") == F.col("m.row_no")) & (F.col("col_no") == F.col("m.col_no")), F.col("text"))).drop("m", "text")


@query("e11_shared_texts", "formulas", f"WITH {MOVED} SELECT wb_id, sheet_idx, row_no, col_no, text FROM moved")
def _(v):
    return shared_texts(shared_groups(v)).select("wb_id", "sheet_idx", "row_no", "col_no", "text")


_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_STYLE_SHEET = (f'<styleSheet xmlns="{_MAIN}"><numFmts count="5"><numFmt numFmtId="164" formatCode="#,##0;(#,##0);&quot;-&quot;"/><numFmt numFmtId="165" formatCode="#,##0;-#,##0"/><numFmt numFmtId="166" formatCode=";;;"/>'
                '<numFmt numFmtId="167" formatCode="#,##0.00_);(#,##0.00)"/><numFmt numFmtId="168" formatCode="yyyy-mm-dd"/></numFmts>'
                '<fonts count="6"><font><sz val="11"/><color theme="1"/><name val="Calibri"/></font><font><sz val="11"/><color rgb="FF008000"/></font><font><color indexed="10"/></font><font><color rgb="FF0000FF"/></font>'
                '<font><sz val="11"/></font><font><color theme="1" tint="0"/></font></fonts>'
                '<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFFF00"/></patternFill></fill>'
                '<fill><patternFill patternType="solid"><fgColor theme="4" tint="0.39997558519241921"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor indexed="51"/></patternFill></fill></fills>'
                '<cellXfs count="8">' + "".join(f'<xf numFmtId="{n}" fontId="{f}" fillId="{p}"/>' for n, f, p in
                                                ((0, 0, 0), (2, 1, 1), (164, 2, 2), (165, 3, 0), (9, 4, 0), (166, 5, 3), (167, 0, 0), (168, 4, 0))) + "</cellXfs></styleSheet>")
_THEME = ('<a:theme xmlns:a="urn:a"><a:themeElements><a:clrScheme name="x"><a:dk1><a:sysClr val="windowText" lastClr="000000"/></a:dk1><a:lt1><a:sysClr val="window" lastClr="FFFFFF"/></a:lt1>'
          '<a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme></a:themeElements></a:theme>')


def _zip_members(batches):
    for batch in batches:
        for wb, names, bodies in zip(batch.wb_id, batch.names, batch.bodies):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for name, body in zip(names, bodies):
                    z.writestr(name, body)
            yield pd.DataFrame({"path": [f"wb{wb}.xlsx"], "content": [buffer.getvalue()]})


def model_rows(v):
    """The grid as whole packages, one row a package before it is zipped. Only the tests' input is made here; its sheets are small by construction."""
    x = F.lit
    written = F.col("v_err").isNotNull() | (F.col("v_num") < 0)
    where = ["wb_id", "sheet_idx", "row_no", "col_no"]
    # a cell beside its formula; dealt out by workbook one time, and all that follows keeps to workbooks
    g = v.derived("grid", FIXTURES["formulas"].replace("SELECT wb_id,", "SELECT v_num, v_err, style_id, wb_id,", 1)).drop("font_rgb")
    g = g.dropna(subset=where).repartition("wb_id").withColumn("si", F.floor((F.col("col_no") - 1) / 2).cast("int"))
    # a group's master is its first formula cell of those that are written
    g = g.withColumn("m", F.min(F.when(written, F.struct("row_no", "col_no"))).over(Window.partitionBy("wb_id", "sheet_idx", "si")))
    escaped = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    master = (F.col("row_no") == F.col("m.row_no")) & (F.col("col_no") == F.col("m.col_no"))
    f = F.when(written, F.when(master, F.concat(x('<f t="shared" ref="A1" si="'), F.col("si").cast("string"), x('">'), escaped, x("</f>"))).otherwise(
        F.concat(x('<f t="shared" si="'), F.col("si").cast("string"), x('"/>')))).otherwise("")
    ref = F.concat(F.char(F.col("col_no") + 64), F.col("row_no").cast("string"))
    kind = F.when(F.col("v_err").isNotNull(), x(' t="e"')).otherwise("")
    cell = F.concat(x('<c r="'), ref, x('" s="'), F.col("style_id").cast("string"), x('"'), kind, x(">"), f, x("<v>"), F.coalesce("v_err", F.col("v_num").cast("string")), x("</v></c>"))
    join = lambda key, item: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, item))), lambda s: s[item]), "")
    rows = g.withColumn("cell", cell).groupBy("wb_id", "sheet_idx", "row_no").agg(join("col_no", "cell").alias("cs"))
    rows = rows.withColumn("row", F.concat(x('<row r="'), F.col("row_no").cast("string"), x('">'), "cs", x("</row>")))
    sheets = rows.groupBy("wb_id", "sheet_idx").agg(join("row_no", "row").alias("rows"))
    known = v.sheets.groupBy("wb_id").agg(F.collect_list(F.struct("sheet_idx", "sheet", "state", "zoom")).alias("known"))
    sheets = sheets.join(known, "wb_id").select("wb_id", "sheet_idx", "rows", F.inline(F.filter("known", lambda k: k["sheet_idx"] == F.col("sheet_idx"))).alias("_", "sheet", "state", "zoom"))
    hidden = F.col("state") == "hidden"
    view = F.concat(x('<sheetViews><sheetView workbookViewId="0"'), F.when(F.col("zoom") != 100, F.concat(x(' zoomScale="'), F.col("zoom").cast("string"), x('"'))).otherwise(""),
                    F.when(hidden, x(' showZeros="0"')).otherwise(""), x('><selection activeCell="A1" sqref="A1"/></sheetView></sheetViews>'))
    body = F.concat(x(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}">'), view, x('<cols><col min="1" max="3" width="12.5" customWidth="1"/></cols><sheetData>'), "rows", x("</sheetData></worksheet>"))
    at = F.col("sheet_idx").cast("string")
    entry = F.concat(x('<sheet name="'), "sheet", x('" sheetId="'), (F.col("sheet_idx") + 1).cast("string"), x('" r:id="r'), at, x('"'), F.when(hidden, x(' state="hidden"')).otherwise(""), x("/>"))
    link = F.concat(x('<Relationship Id="r'), at, x(f'" Type="{_REL}/worksheet" Target="'), F.when(F.col("sheet_idx") % 2 == 0, x("worksheets/sheet")).otherwise(x("/xl/worksheets/sheet")), at, x('.xml"/>'))
    listed = sheets.select("wb_id", "sheet_idx", body.alias("body"), entry.alias("entry"), link.alias("link"))
    books = listed.groupBy("wb_id").agg(join("sheet_idx", "entry").alias("entries"), join("sheet_idx", "link").alias("links"), F.array_sort(F.collect_list(F.struct("sheet_idx", "body"))).alias("b"))
    members = [("xl/workbook.xml", F.concat(x(f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>'), "entries", x('</sheets><definedNames><definedName name="WACC">S0!$A$1</definedName></definedNames><calcPr calcMode="manual"/></workbook>'))),
               ("xl/_rels/workbook.xml.rels", F.concat(x('<?xml version="1.0"?><Relationships xmlns="urn:r">'), "links", x("</Relationships>"))), ("xl/styles.xml", x(_STYLE_SHEET)), ("xl/theme/theme1.xml", x(_THEME)),
               ("docProps/app.xml", x("<Properties><Application>Microsoft Excel</Application><AppVersion>16.0300</AppVersion></Properties>"))]
    names = F.concat(F.array(*[x(n) for n, _ in members]), F.transform("b", lambda s: F.concat(x("xl/worksheets/sheet"), s["sheet_idx"].cast("string"), x(".xml"))))
    bodies = F.concat(F.array(*[m for _, m in members]), F.transform("b", lambda s: s["body"]))
    return books.select("wb_id", names.alias("names"), bodies.alias("bodies"))


def model_views(v):
    """The relations of ``packages.book_views``, read from the files of ``model_rows``."""
    parts = checkpointed(model_rows(v.written("grid")).mapInPandas(_zipped_parts(_zip_members), W.PARTS).withColumn("wb_id", F.substring_index("wb_id", "#", 1)))
    return packages.book_views(parts)


@query("s10_book_styles", "sheets", """
WITH st AS (SELECT * FROM (VALUES (0, 'General', '000000', NULL), (1, '0.00', '008000', 'FFFF00'), (2, '#,##0;(#,##0);"-"', 'FF0000', '8EA9DB'), (3, '#,##0;-#,##0', '0000FF', NULL), (4, '0%', '000000', NULL),
 (5, ';;;', '000000', 'FFCC00'), (6, '#,##0.00_);(#,##0.00)', '000000', NULL), (7, 'yyyy-mm-dd', '000000', NULL)) AS t(style_id, fmt_code, font_rgb, fill_rgb))
SELECT 'wb' || CAST(wb_id AS VARCHAR) || '.xlsx' AS wb_id, st.* FROM (SELECT DISTINCT wb_id FROM sheets) b CROSS JOIN st""")
def _(v):
    return model_views(v)["styles"].select("wb_id", "style_id", "fmt_code", "font_rgb", "fill_rgb")


@query("s10_book_sheets", "sheets", "SELECT 'wb' || CAST(wb_id AS VARCHAR) || '.xlsx' AS wb_id, sheet_idx, sheet, state, zoom, state <> 'hidden' AS show_zeros, 'topLeft' AS active_pane FROM sheets")
def _(v):
    return model_views(v)["sheets"]


@query("s10_formula_texts", "grid formulas", f"WITH {MOVED} SELECT 'wb' || CAST(wb_id AS VARCHAR) || '.xlsx' AS wb_id, sheet_idx, row_no, col_no, text FROM moved".replace(
    "FROM formulas f)", "FROM formulas f JOIN grid g ON g.wb_id = f.wb_id AND g.sheet_idx = f.sheet_idx AND g.row_no = f.row_no AND g.col_no = f.col_no WHERE v_err IS NOT NULL OR v_num < 0)"))
def _(v):
    return model_views(v)["cells"].filter("has_formula").select("wb_id", "sheet_idx", "row_no", "col_no", "text")
