"""Substring dedup: suffix subtrees in groups that share a prefix; deep nodes are repeats.

A window is ``WINDOW`` consecutive words; it is repeated when its words also start somewhere else.
All suffixes of a corpus do not fit anywhere, so the tree is built where it can branch deep enough:

1. Suffixes are sampled by content: a window's sample is its 7-word block of least hash, the leftmost
   of equals. Equal windows have the same sample at the same place. One suffix in fifteen is
   sampled; those whose 7-word prefix occurs once in the corpus are leaves at depth 7 and go.
2. What remains is cut into pieces: the windows of one sample, with their words. Equal pieces become
   one with a multiplicity, so thousands of copies cost as much as two.
3. Pieces are partitioned by a prefix of variable length: 7 words, or, where more pieces share those
   than fit in memory, the whole window. Groups of 7 words go to tasks together and sorted.
4. A task builds the subtree of each group by prefix doubling: suffixes with one rank at depth d
   hang below one node. Nodes at depth ``WINDOW`` with two leaves or more are the repeats.

Removal is judged on the input; words are codes of 32 bits, so a window of 35 words is mistaken for
another that differs in one word with odds of 2**-32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .words import hash_words, mix, runs, slices, text_bytes

WINDOW, PREFIX = 35, 7
GROUP_PIECES = 20_000  # pieces of one prefix that a task holds
_BUFFER = 1 << 19  # words
_KEYS = "row_id long, row_hash long"


def samples(words: np.ndarray, first: np.ndarray, window: int, prefix: int):
    """Of every window: its row, its start, its sample's start (both in the row) and its sample's hash."""
    blocks, begin = runs(words, first, prefix)
    span = window - prefix + 1
    if len(blocks) < span:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    low, at, width = blocks, np.arange(len(blocks)), 1
    while width < span:
        step = min(width, span - width)
        left = low[:-step] <= low[step:]
        low, at, width = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:]), width + step
    per_row = np.maximum(0, np.diff(begin) - span + 1)
    row = np.repeat(np.arange(len(per_row)), per_row)
    start = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    i = begin[row] + start
    return row, start, at[i] - begin[row], low[i]


def _starts_of(row: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Where the run of windows with one sample begins."""
    return np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (sample[1:] != sample[:-1])))) if len(row) else np.empty(0, np.int64)


def _sampled_prefixes(window: int, prefix: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, first = hash_words(*text_bytes(batch.column(2)), lower=False)
            row, _, sample, value = samples(words, first, window, prefix)
            at = _starts_of(row, sample)
            row, value = row[at], value[at].view(np.int64)
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            at = _starts_of(row, value)
            times = np.diff(np.append(at, len(row)))
            take = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(value[at]), pa.array(times)],
                                             ["row_id", "row_hash", "prefix", "times"])

    return read


def _pieces(window: int, prefix: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, first = hash_words(*text_bytes(batch.column(2)), lower=False)
            codes = (words >> np.uint64(32)).astype(np.uint32)
            row, start, sample, value = samples(words, first, window, prefix)
            at = _starts_of(row, sample)
            n = np.diff(np.append(at, len(row)))
            shared = np.unique(batch.column(3).flatten().to_numpy())
            keep = np.isin(value[at].view(np.int64), shared)
            at, n = at[keep], n[keep]
            a = first[row[at]] + start[at]
            size = n + window - 1
            begin = np.concatenate(([0], np.cumsum(size)))
            flat = codes[np.repeat(a - begin[:-1], size) + np.arange(begin[-1])]
            place = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
            hashed = mix(flat.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed)))
            digest = mix(sums[begin[1:]] - sums[begin[:-1]] + size.astype(np.uint64)).view(np.int64)
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer((begin * 4).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            take = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start[at], pa.int32()), pa.array(digest),
                                              pa.array(value[at].view(np.int64)), body], ["row_id", "row_hash", "start", "piece", "prefix", "codes"])

    return cut


def ranks(codes: np.ndarray, depth: int) -> np.ndarray:
    """Rank, among all suffixes, of the first ``depth`` words of each suffix that has as many."""
    rank, d = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while d < depth:
        step = min(d, depth - d)
        rank = np.unique(rank[:-step] * len(codes) + rank[step:], return_inverse=True)[1].astype(np.int64)
        d += step
    return rank


def _subtrees(window: int):
    """Sorted by prefix: (piece, windows of it that hang below a deep node with another leaf, as bits)."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def build(rows: list) -> pa.RecordBatch:
            codes = np.frombuffer(b"".join(r[3] for r in rows), np.uint32)
            length = np.array([len(r[3]) // 4 for r in rows])
            n = length - window + 1
            rank = ranks(codes, window)
            owner = np.repeat(np.arange(len(rows)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            node = rank[(np.cumsum(length) - length)[owner] + place]
            leaves = np.bincount(node, weights=np.array([r[2] for r in rows], np.float64)[owner])
            bits = np.where(leaves[node] >= 2, np.int64(1) << place, 0)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(np.add.reduceat(bits, np.cumsum(n) - n))], ["piece", "repeated"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= _BUFFER and r[1] != held[-1][1]:
                    yield build(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3]) // 4
        if held:
            yield build(held)

    return grow


def _whole_windows(window: int):
    """Every window of a piece: (piece, place, window, times), the prefix in full length."""

    schema = pa.schema([("piece", pa.int64()), ("place", pa.int32()), ("window", pa.binary()), ("times", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, times, body in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                codes = np.frombuffer(body, np.uint32)
                n = len(codes) - window + 1
                keys = [codes[i:i + window].tobytes() for i in range(n)]
                yield pa.RecordBatch.from_pydict({"piece": [piece] * n, "place": list(range(n)), "window": keys, "times": [times] * n}, schema=schema)

    return read


def repeated_pieces(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(piece, repeated): of a written table of pieces with their multiplicity, the repeated windows as bits."""
    crowded = pieces.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_pieces).select("prefix")
    small, out = pieces, []
    if not crowded.isEmpty():
        crowded = checkpointed(crowded)
        small = pieces.join(crowded, "prefix", "left_anti")
        windows = (pieces.join(crowded, "prefix", "left_semi").select("piece", "prefix", "times", "codes")
                   .mapInArrow(_whole_windows(window), "piece long, place int, window binary, times long"))
        again = windows.groupBy("window").agg(F.sum("times").alias("n")).filter("n > 1").select("window")
        out.append(windows.join(again, "window").groupBy("piece").agg(F.expr("bit_or(shiftleft(1L, place))").alias("repeated")))
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out.append(small.select("piece", "prefix", "times", "codes").repartition(parts, "prefix").sortWithinPartitions("prefix")
               .mapInArrow(_subtrees(window), "piece long, repeated long"))
    found = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return found.filter("repeated <> 0")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of one key and one text share everything, so a repeated row needs no key of its own."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")).alias("row_id"),
                       F.xxhash64(F.col(text).cast("string")).alias("row_hash"), F.col(text).cast("string").alias("text"))


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX,
                  group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(row_id, row_hash, runs): for each text with repeated windows, (start, bits) of its pieces."""
    if not prefix < window <= 62 + prefix:
        raise ValueError("a window holds more words than a prefix, and at most 62 more")
    rows = _keyed(docs, key, text)
    seen = checkpointed(rows.mapInArrow(_sampled_prefixes(window, prefix), f"{_KEYS}, prefix long, times long"))
    shared = seen.groupBy("prefix").agg(F.sum("times").alias("n")).filter("n > 1").select("prefix")
    wanted = seen.join(shared, "prefix").groupBy("row_id", "row_hash").agg(F.collect_set("prefix").alias("shared"))
    cut = (rows.join(wanted, ["row_id", "row_hash"]).select("row_id", "row_hash", "text", "shared")
           .mapInArrow(_pieces(window, prefix), f"{_KEYS}, start int, piece long, prefix long, codes binary"))
    cut = checkpointed(cut)
    pieces = checkpointed(cut.groupBy("piece").agg(F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("times"), F.first("codes").alias("codes")))
    repeated = repeated_pieces(pieces, window, group_pieces)
    return (cut.select("row_id", "row_hash", "start", "piece").join(repeated, "piece")
            .groupBy("row_id", "row_hash").agg(F.collect_set(F.struct("start", "repeated")).alias("runs")))


def _strike(window: int, keep_layout: bool):
    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept, total, gone = [], [], []
            for t, runs_ in zip(texts, marks, strict=True):
                words = (t or "").encode().split()
                total.append(len(words))
                if not runs_:
                    kept.append((t or "").encode() if keep_layout else b" ".join(words))
                    gone.append(0)
                    continue
                start = np.array([r["start"] for r in runs_], np.int64)
                bits = np.array([r["repeated"] for r in runs_], np.int64)
                at = (start[:, None] + np.arange(63))[(bits[:, None] >> np.arange(63)) & 1 == 1]
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                stays = (np.cumsum(step[:-1]) == 0).tolist()
                left = [w for w, s in zip(words, stays, strict=True) if s]
                kept.append(b" ".join(left))
                gone.append(len(words) - len(left))
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), *rest],
                                             ["kept", "n_words", "n_removed", *batch.schema.names[2:]])

    return strike


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, carry: list[str] | None = None,
                   keep_layout: bool = False, names: tuple[str, str, str] = ("kept", "n_words", "n_removed"), **options) -> DataFrame:
    """(kept, n_words, n_removed) beside the columns in ``carry`` (default: the key), for every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a repeated window covers it; ``kept`` are
    the others, joined by one space. Both places of a repeat lose it, in one document or in two; so do
    repeated rows. A null or empty text, and one of fewer words than ``window``, loses nothing. A null
    key stays null. An empty table gives no rows. ``carry`` names columns to keep, whatever they hold;
    ``names`` renames the operator's own, should they clash.
    With ``keep_layout``, a text that loses nothing comes back with its own white space.
    """
    carry = carry or [key]
    found = repeated_runs(docs, key, text, window, **options)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")).alias("row_id"),
                       F.xxhash64(F.col(text).cast("string")).alias("row_hash"), F.col(text).cast("string").alias("text"), F.struct(*[F.col(c) for c in carry]).alias("carried"))
    both = rows.join(found, ["row_id", "row_hash"], "left").select("text", "runs", "carried")
    kind = both.schema["carried"].dataType.simpleString()
    out = both.mapInArrow(_strike(window, keep_layout), f"kept string, n_words long, n_removed long, carried {kind}")
    return out.select("carried.*", *[F.col(c).alias(n) for c, n in zip(("kept", "n_words", "n_removed"), names, strict=True)])
