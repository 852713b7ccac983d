"""Packing into fixed-length sequences: first-fit decreasing in randomised groups of pieces.

Documents are tokenised once; a document longer than a sequence is cut at multiples of its length.
Pieces are dealt at random into groups of bounded size, and each group is packed alone: the pieces
by falling length, each into the first bin with room, found by descending a tournament tree whose
inner nodes hold the largest room below. A group's waste is its last few bins, so it shrinks with
the group size, not with the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import tokens
from .words import slices

GROUP_PIECES = 8192
_BINS = 21  # bits of a bin's number inside its group
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece. Equal lengths keep their order; none may exceed ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(1, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * leaves)  # node i has children 2i and 2i + 1; bins are leaves
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for at, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        node = 1
        while node < leaves:
            node += node
            if room[node] < size:
                node += 1
        bins[at], offsets[at] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node >>= 1
            left, right = room[2 * node], room[2 * node + 1]
            largest = left if left >= right else right
            if room[node] == largest:
                break
            room[node] = largest
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def token_pieces(docs: DataFrame, spec: str, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids, with the crc of its little-endian uint32 ids."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(shared.value)
        for batch in slices(batches, "text", 2 << 20):
            ids, begin = enc.encode_many(batch.column(1))
            raw, total = memoryview(ids.astype("<u4")).cast("B"), np.diff(begin)
            n = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, total[row] - start)
            a = (begin[row] + start) * 4
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), (a + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                                              pa.array(crc, pa.int64()), pa.array(total[row], pa.int64())],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, PIECE)


def pack_pieces(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """Adds (sequence_id, offset) to pieces with a ``length``; ``pieces`` must be a written table.

    The random deal is by position in the table, so a key that recurs without end is spread too,
    and a task that runs again deals the same.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = f"{PIECE}, sequence_id long, offset long"

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").drop(columns="_group")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(key[0]) << _BINS) + bins, offset=offsets)

    dealt = pieces.withColumn("_group", F.floor(F.rand(seed) * groups).cast("long"))
    return dealt.groupBy("_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, key: str = "doc_id", text: str = "text",
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    A null or empty text is its end id alone; repeated rows are packed as often as they come; a null
    key stays null; an empty table gives no rows. Other columns are not read. Sequences are gapless
    from offset 0. ``tokenizer`` is the path of a tokenizer file.
    """
    pieces = checkpointed(token_pieces(docs, tokens.tokenizer_json(tokenizer), capacity, key, text))
    return pack_pieces(pieces, capacity, group_pieces)
