"""A corpus pipeline over `documents`: each stage's rows are written and read again as the next one's.

Stages take (spark, docs, sf_dir). All but the last return the columns of `documents`; the last one
returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.llm.decontamination import find_contained
from gridledger.llm.jaccard import jaccard_join
from gridledger.llm.language import UNKNOWN, identify_language
from gridledger.llm.packing import pack_documents
from gridledger.llm.substrings import remove_repeats
from gridledger.session import checkpointed

BATCH_ROWS = "2000"  # of a batch that goes to Python: whole texts are long, and both sides hold a batch
LEAST_SCORE = 0.25  # of a language that is accepted; two languages that are equally likely have more


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, made longer until no column of ``docs`` has them."""
    taken = "_" * max((len(c) for c in docs.columns), default=0)
    return tuple(n + taken for n in names)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in ``gone``; a table of few ids is sent to all tasks, others meet by shuffle.

    Ids are compared, not rows: all rows of an id go, whatever their texts, and rows with a null id stay.
    """
    return docs.join(checkpointed(gone.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that no language fits; a missing label is filled in."""
    held_out, lang, score = _free(docs, "held_out", "lang_pred", "score")
    found = identify_language(docs, carry=docs.columns, names=(held_out, lang, score)).filter((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of linked documents; of a repeated row, one."""
    groups = checkpointed(jaccard_join(docs))
    left = _without(docs, groups.filter("component_id < doc_id"))
    again = groups.filter("component_id = doc_id AND n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    again = checkpointed(again)
    if again.isEmpty():
        return left
    (turn,) = _free(docs, "turn")
    one = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text")
    repeated = left.join(again, "doc_id", "left_semi").withColumn(turn, F.row_number().over(one)).filter(F.col(turn) == 1).select(*docs.columns)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)


def strike_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words out that lie in repeated passages; texts that lose nothing stay as they are."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    kept, *rest = _free(docs, "kept", "n_words", "n_removed")
    left = remove_repeats(docs, carry=others, keep_layout=True, names=(kept, *rest))
    return left.withColumn("text", F.col(kept)).withColumn("n_chars", F.length(kept).cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return _without(docs, find_contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", strike_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: the last stage counts tokens of a byte-pair vocabulary, which SQL cannot
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BATCH_ROWS)
    try:
        for k, (_, stage) in enumerate(STAGES, 1):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES):
                docs = checkpointed(docs)
    finally:
        spark.conf.set(setting, before)
    return docs
