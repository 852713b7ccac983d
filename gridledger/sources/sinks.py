"""Sinks: attempts, gradings, sheet grids."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[A-Za-z0-9._-]+")


def append_rows(df: DataFrame, schema_of: DataFrame, folder: str, partition: str) -> None:
    """Appends rows as JSON lines under their cohort's folder; columns the rows lack are written as null.

    Each append adds files of its own, so concurrent writers need no lock.
    """
    unknown = set(df.columns) - set(schema_of.columns)
    if unknown:
        raise ValueError(f"columns the table does not have: {sorted(unknown)}")
    full = schema_of.limit(0).unionByName(df, allowMissingColumns=True)
    full.write.mode("append").partitionBy(partition).option("ignoreNullFields", False).json(folder)


def append_once(df: DataFrame, schema_of: DataFrame, folder: str, partition: str, batch_id: str) -> bool:
    """As ``append_rows``, but a batch counts once, however often it is written; says whether this call made it count.

    Rows go to a folder of this try alone; a commit file named after the batch then names the try. Creating that
    file is the commit: it fails if it exists, so of a replay, or of two writers with one batch, one counts. A
    writer that dies before it leaves rows that no reader takes. On a store without exclusive creation, give
    each batch one writer.
    """
    unknown = set(df.columns) - set(schema_of.columns)
    if unknown:
        raise ValueError(f"columns the table does not have: {sorted(unknown)}")
    if not _PLAIN.fullmatch(batch_id):
        raise ValueError("a batch id is made of letters, digits, dots, dashes and underscores")
    store, commit = jvm_path(df.sparkSession, f"{folder}/_commits/{batch_id}.json")
    if store.exists(commit):
        return False
    token = os.urandom(8).hex()
    full = schema_of.limit(0).unionByName(df, allowMissingColumns=True)
    full.write.partitionBy(partition).option("ignoreNullFields", False).json(f"{folder}/rows/batch={batch_id}/try={token}")
    try:
        out = store.create(commit, False)
    except Exception:  # noqa: BLE001  the other writer was first, if there is a commit now
        if store.exists(commit):
            return False
        raise
    out.write(bytearray(json.dumps({"batch": batch_id, "try": token}).encode()))
    out.close()
    return True


def read_committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of committed batches; ``schema`` names all columns, the partition included. No commit, no rows."""
    commits = jvm_path(spark, f"{folder}/_commits")
    if not commits[0].exists(commits[1]):
        return spark.createDataFrame([], schema)
    made = spark.read.schema("batch STRING, `try` STRING").json(f"{folder}/_commits")
    rows = spark.read.schema(f"{schema}, batch STRING, `try` STRING").option("basePath", f"{folder}/rows").json(f"{folder}/rows")
    return rows.join(made, ["batch", "try"], "left_semi").drop("batch", "try")


def jvm_path(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as the session's own Hadoop configuration sees them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def with_grading_id(gradings: DataFrame, run_id: str) -> DataFrame:
    """Ids from what identifies a grading, so that a repeated task writes the same id."""
    return gradings.withColumn("id", F.xxhash64("attempt_id", "grader_model", F.lit(run_id)))


def sheet_lines(cells: DataFrame, keys: list[str], separator: str = ",") -> DataFrame:
    """One line per sheet row: cells in column order, gaps filled, formulas marked.

    ``cells`` carries col_no, shown and formula (or null). A row holds at most 16,384 cells.
    """
    text = F.coalesce("shown", F.lit("")) if "formula" not in cells.columns else F.concat(
        F.coalesce("shown", F.lit("")), F.coalesce(F.concat(F.lit("|="), "formula"), F.lit("")))
    quoted = F.when(F.contains(text, F.lit(separator)) | F.contains(text, F.lit('"')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    row = cells.groupBy(*keys, "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", quoted.alias("t")))).alias("m"), F.max("col_no").alias("n"))
    line = F.array_join(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), separator)
    return row.select(*keys, "row_no", line.alias("line"))
