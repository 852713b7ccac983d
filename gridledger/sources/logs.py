"""JSON sources: attempts, tasks, weights, alternates, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = ("id BIGINT, task_id INT, agent_model_name STRING, agent_model_type STRING, attempt_files STRING, prompt_files STRING, "
            "start_time TIMESTAMP, end_time TIMESTAMP, time_taken_min DOUBLE, cost DOUBLE, prompt_version STRING, agent_failed BOOLEAN, "
            "agent_failed_reason STRING, deprecated BOOLEAN, created_at TIMESTAMP, context_reduced BOOLEAN, deprecated_reason STRING, "
            "updated_at TIMESTAMP, extra_configs STRING")
TASKS = ("task_id INT, task_name STRING, difficulty STRING, difficulty_score DOUBLE, model_type STRING, description STRING, "
         "estimated_solve_time_hours DOUBLE, starting_files ARRAY<STRING>, solution_files ARRAY<STRING>")
TRAJECTORY = {
    "call": "type STRING, ts TIMESTAMP, step BIGINT, attempt_id BIGINT, model STRING, latency_ms BIGINT, usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT>",
    "blob": "type STRING, id STRING, chars BIGINT, content STRING",
    "event": "type STRING, ts TIMESTAMP, step BIGINT, attempt_id BIGINT, kind STRING, payload STRING",
    "end": "type STRING, ts TIMESTAMP, step BIGINT, attempt_id BIGINT, status STRING",
}


def read_attempts(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """Every attempts file below ``root``. A malformed line stops the strict reader and is dropped by the lenient one."""
    reader = spark.read.schema(ATTEMPTS).option("recursiveFileLookup", True)
    if strict:
        return reader.option("mode", "FAILFAST").json(root).withColumn("source", F.col("_metadata.file_path"))
    # DROPMALFORMED still keeps half-parsed rows when few columns are read; the corrupt column decides
    loose = spark.read.schema(ATTEMPTS + ", _bad STRING").option("recursiveFileLookup", True).option("mode", "PERMISSIVE")
    rows = loose.option("columnNameOfCorruptRecord", "_bad").json(root).withColumn("source", F.col("_metadata.file_path"))
    return rows.filter(F.col("_bad").isNull()).drop("_bad")


def duplicate_ids(attempts: DataFrame) -> DataFrame:
    """Rows without an id, and ids seen twice, with two of the files that hold them."""
    seen = attempts.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("first_source"), F.max("source").alias("last_source"))
    return seen.filter(F.col("id").isNull() | (F.col("n") > 1)).withColumn("problem", F.when(F.col("id").isNull(), "no id").otherwise("repeated id"))


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    """Task rows by id: of ``task_id=N/`` folders, the folder's number being the id, and of files with a task in each line.

    A line outside such a folder names its task in ``task_id`` or ``id``. A folder a task suits hundreds of tasks; a
    million of them would be as many folders to make and to list, so many tasks are kept as lines of few files.
    """
    rows = spark.read.schema(TASKS + ", id INT").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(root)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/task_id=([0-9]+)/[^/]*$", 1).try_cast("int")
    body = [c.split()[0] for c in TASKS.split(", ")[1:]]
    return rows.select(*body, F.coalesce(folder, "task_id", "id").alias("task_id")).orderBy("task_id")


def file_refs(column: Column) -> Column:
    """A file column in any of its shapes - text, list of texts, list of name/path, name-to-path map - as ARRAY<STRUCT<name, path>>."""
    ref = "ARRAY<STRUCT<name: STRING, path: STRING>>"
    last = lambda p: F.element_at(F.split(p, "/"), -1)
    plain = lambda paths: F.transform(paths, lambda p: F.struct(last(p).alias("name"), p.alias("path")))
    text = F.trim(column)
    structs = F.transform(F.from_json(text, ref), lambda x: F.struct(F.coalesce(F.nullif(x["name"], F.lit("")), last(x["path"])).alias("name"), x["path"].alias("path")))
    pairs = F.transform(F.map_entries(F.from_json(text, "MAP<STRING, STRING>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("path")))
    out = (F.when(text.rlike(r"^\[\s*\{"), structs).when(F.startswith(text, F.lit("[")), plain(F.from_json(text, "ARRAY<STRING>")))
           .when(F.startswith(text, F.lit("{")), pairs).when(text.isNotNull(), plain(F.array(text))))
    return F.filter(out, lambda x: F.length(F.coalesce(x["path"], F.lit(""))) > 0)


def workbook_path(files: Column) -> Column:
    """The first Excel file of an attempt."""
    return F.get(F.filter(files, lambda x: x["name"].rlike(r"(?i)\.(xlsx|xlsm|xlsb|xls)$")), F.lit(0))["path"]


def read_weights(documents: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Weights documents to one row per check with its category's weight.

    The document is ``{"CategoryWeights": [{category: w}], category: [{"name":, "weight":}]}``.
    """
    doc = F.from_json(F.col(column), "MAP<STRING, ARRAY<MAP<STRING, STRING>>>")
    d = documents.select(*keep, doc.alias("doc"))
    cats = d.select(*keep, F.explode(F.element_at("doc", F.lit("CategoryWeights"))[0]).alias("category", "cw"))
    checks = (d.select(*keep, F.explode("doc").alias("category", "items")).filter("category <> 'CategoryWeights'")
              .select(*keep, "category", F.explode("items").alias("item")))
    return (checks.join(cats, [*keep, "category"], "left")
            .select(*keep, "category", F.col("item")["name"].alias("name"), F.col("item")["weight"].try_cast("double").alias("weight"),
                    F.col("cw").try_cast("double").alias("category_weight")))


def read_alternates(spark: SparkSession, root: str) -> DataFrame:
    """Second accepted answers, one row per task and question."""
    schema = "task_id BIGINT, questions ARRAY<STRUCT<qid: INT, label: STRING, golden: STRING, alternate: STRING>>"
    return spark.read.schema(schema).json(root).select("task_id", F.inline("questions"))


def read_trajectory(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The records of one type from mixed, possibly gzipped, JSON lines."""
    return spark.read.schema(TRAJECTORY[kind]).json(root).filter(F.col("type") == kind)
