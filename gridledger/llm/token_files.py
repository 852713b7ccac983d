"""Token shards on disk: raw id payloads behind a minimal perfect hash of document keys.

A shard is one file of whole documents in ascending key order:

    header    7 little-endian int64: magic, format version, bytes per id, keys, ids, buckets, slots
    seeds     uint32 per bucket: the displacement that sends its keys to free slots
    prints    uint32 per slot: a fingerprint of the key that owns the slot
    places    int64 per slot: the document's number in the shard
    keys      int64 per document, ascending (to list a shard; a lookup does not read them)
    bounds    int64 per document and one more: first id of each document
    payload   the ids, 2 or 4 bytes each

and one line feed, which the writer ends records with. A key's slot is found in constant time: hash
to a bucket, add the bucket's seed, hash to a slot, compare the fingerprint. As many slots as keys.

Documents are range-partitioned by key with the size of their texts in view; Spark's text writer puts
down one record per file, so every file system Spark knows will do. A manifest has one row per shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_folder
from . import tokens
from .words import mix, slices

MAGIC, VERSION = 0x4C47544F4B454E53, 1
SHARD_IDS = 4 << 20
_HEAD = 7
_U32 = np.uint64(0xFFFFFFFF)


def _hash(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(seed).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0x0F1F) >> np.uint64(32)).astype(np.uint32)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_hash(keys, 0xB0C) % np.uint64(buckets)).astype(np.int64)


def _slot(keys: np.ndarray, seed: np.ndarray | int, slots: int) -> np.ndarray:
    return (_hash(keys, seed) % np.uint64(slots)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each bucket, slot of each key) for distinct keys, as many slots as keys.

    Buckets of about four keys, largest first; each takes the first seed whose slots are all free.
    """
    n = len(keys)
    seeds, slot = np.zeros(max(1, n // 4), np.uint32), np.zeros(n, np.int64)
    bucket = _bucket(keys, len(seeds))
    order = np.argsort(bucket, kind="stable")
    cut = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=len(seeds)))))
    taken = np.zeros(n, bool)
    tries = np.arange(1, 65, dtype=np.uint64)
    for b in np.argsort(-np.diff(cut), kind="stable").tolist():
        own = order[cut[b]:cut[b + 1]]
        if not len(own):
            break
        base = 0
        while True:
            at = _slot(keys[own][None, :], (tries + np.uint64(base))[:, None], n)
            ok = ~taken[at].any(axis=1)
            if len(own) > 1:
                s = np.sort(at, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            hit = np.flatnonzero(ok)
            if len(hit):
                seeds[b] = base + 1 + hit[0]
                slot[own] = at[hit[0]]
                taken[at[hit[0]]] = True
                break
            base += len(tries)
    return seeds, slot


def build_shard(keys: np.ndarray, ids: np.ndarray, bounds: np.ndarray, width: int) -> bytes:
    """One shard's bytes. Keys ascend; of equal keys the index holds the first document."""
    distinct, first = np.unique(keys, return_index=True)
    seeds, slot = perfect_hash(distinct)
    prints, places = np.zeros(len(slot), "<u4"), np.zeros(len(slot), "<i8")
    prints[slot], places[slot] = fingerprint(distinct), first
    head = np.array([MAGIC, VERSION, width, len(keys), len(ids), len(seeds), len(slot)], "<i8")
    parts = (head, seeds.astype("<u4"), prints, places, keys.astype("<i8"), bounds.astype("<i8"), ids.astype(f"<u{width}"))
    return b"".join(x.tobytes() for x in parts)


class Shard:
    """A shard file's content, read in place."""

    def __init__(self, content: bytes):
        magic, version, self.width, self.n, ids, buckets, slots = np.frombuffer(content, "<i8", _HEAD).tolist()
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token shard")
        at = _HEAD * 8

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        self.seeds, self.prints, self.places = part("<u4", buckets), part("<u4", slots), part("<i8", slots)
        self.keys, self.bounds, self.ids = part("<i8", self.n), part("<i8", self.n + 1), part(f"<u{self.width}", ids)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The document number of each key; -1 where the fingerprint says it is not here.

        A key that is not in the shard passes with odds of 2**-32.
        """
        if not self.n:
            return np.full(len(keys), -1)
        slot = _slot(keys, self.seeds[_bucket(keys, len(self.seeds))], len(self.prints))
        return np.where(self.prints[slot] == fingerprint(keys), self.places[slot], -1)

    def document(self, number: int) -> np.ndarray:
        return self.ids[self.bounds[number]:self.bounds[number + 1]]


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text",
                      shard_ids: int = SHARD_IDS, partitions: int | None = None) -> None:
    """Encodes whole texts and writes ``path``/shards and ``path``/manifest in ascending key order.

    Null keys come first, as the smallest long; a null text is empty: its end id alone. Repeated keys
    are written each; lookups find the first. Ids take 2 bytes if the vocabulary allows, else 4.
    An empty table writes an empty manifest.
    """
    spark = docs.sparkSession
    spec = tokens.tokenizer_json(tokenizer)
    shared = spark.sparkContext.broadcast(spec)
    width = 2 if tokens.encoder(spec).vocab <= 1 << 16 else 4
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(shared.value)
        keys, parts, counts = [], [], []

        def out() -> pa.RecordBatch:
            ids, all_keys, each = np.concatenate(parts), np.concatenate(keys), np.concatenate(counts)
            body = build_shard(all_keys, ids, np.concatenate(([0], np.cumsum(each))), width)
            keys.clear(), parts.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])

        for batch in slices(batches, "text", 8 << 20):
            ids, begin = enc.encode_many(batch.column(1))
            keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            parts.append(ids.astype(f"u{width}"))
            counts.append(np.diff(begin))
            if sum(len(x) for x in parts) >= shard_ids:
                yield out()
        if keys:
            yield out()

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # the random number lets a key that recurs without end span several partitions
    ranged = (rows.withColumn("_deal", F.rand(11)).repartitionByRange(partitions, "doc_id", "_deal")
              .sortWithinPartitions("doc_id", "text").drop("_deal"))
    (ranged.mapInArrow(encode, "body binary").select(F.col("body").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).text(f"{path}/shards"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Shard(content.as_buffer())
                yield pa.RecordBatch.from_pydict({"file": [name], "first_key": s.keys[:1], "last_key": s.keys[-1:], "n_docs": [s.n], "n_ids": [len(s.ids)]})

    files = _files(spark, path).mapInArrow(describe, "file string, first_key long, last_key long, n_docs long, n_ids long")
    # one row per shard: sums over shards, not over documents
    order = Window.orderBy("first_key", "last_key", "file")
    files.withColumn("start", F.sum("n_ids").over(order) - F.col("n_ids")).write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/shards").select(F.substring_index("path", "/", -1).alias("file"), "content").filter(F.length("content") > 1)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

    Each key of a shard goes through its hash index; documents that repeat a key follow the one
    that the index holds.
    """
    starts = spark.read.parquet(f"{path}/manifest").select("file", F.col("start").alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = Shard(content.as_buffer())
                at = s.find(s.keys)
                if (at < 0).any() or (s.keys[at] != s.keys).any():
                    raise ValueError("a key is not where the shard's index puts it")
                at = np.maximum(at, np.arange(s.n))  # repeats stand right behind the first
                raw = memoryview(s.ids.astype("<u4")).cast("B")
                a, b = s.bounds[at], s.bounds[at + 1]
                crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                keys = pa.array(s.keys, pa.int64(), mask=s.keys == -(2**63))
                yield pa.RecordBatch.from_arrays([keys, pa.array(base + a), pa.array(b - a), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _files(spark, path).join(starts, "file").select("content", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the asked keys that the files hold: each key meets only its shard.

    Keys are routed by the manifest, which has one row per shard of millions of ids.
    """
    spark = keys.sparkSession
    bounds = spark.read.parquet(f"{path}/manifest").orderBy("first_key").select("file", "first_key").toPandas()
    names, firsts = bounds["file"].tolist(), bounds["first_key"].to_numpy(np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(firsts, k, "left") - 1  # the first shard that can hold it
            at = np.where((at + 1 < len(firsts)) & (firsts[np.minimum(at + 1, len(firsts) - 1)] == k), at + 1, at) if len(firsts) else at
            ok = at >= 0
            yield pa.RecordBatch.from_arrays([pa.array(k[ok]), pa.array([names[i] for i in at[ok]], pa.string())], ["doc_id", "file"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s, k = Shard(content.as_buffer()), np.array(wanted, np.int64)
                at = s.find(k)
                hit = np.flatnonzero(at >= 0)
                yield pa.RecordBatch.from_pydict({"doc_id": k[hit], "ids": [s.document(i).astype(np.int64) for i in at[hit]]},
                                                 schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    asked = keys.select(F.col(key).cast("long").alias("doc_id")).dropna().distinct().mapInArrow(route, "doc_id long, file string")
    # at most one entry for each document of a shard's size and asked key
    wanted = asked.groupBy("file").agg(F.collect_list("doc_id").alias("wanted"))
    return _files(spark, path).join(wanted, "file").select("content", "wanted").mapInArrow(read, "doc_id long, ids array<long>")


def token_file_digest(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, **options) -> DataFrame:
    """Writes the files (below the shared folder, unless ``path`` says where) and reads them back."""
    path = path or fresh_folder(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(docs.sparkSession, path)
