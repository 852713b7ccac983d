"""Benchmark decontamination: size-partitioned MinHash containment search, then an exact check.

A short item inside a long document has a tiny Jaccard similarity with it, so MinHash finds
nothing there. Items are partitioned by size: class U holds those with U/2 to U shingles. Documents
are cut into blocks of 16 shingles; for class U every run of 2U/16 blocks is a window, so whatever
lies within U shingles lies whole in one window. An item of over ``BRIEF`` shingles contained to 0.8 has a
Jaccard similarity of at least 0.19 with that window, mostly 0.36, and ``PERMUTATIONS`` single-value bands miss
it with odds of 0.81**32 = 0.1 % at worst. Window minima double up from block minima, so all classes cost one pass.

Items of up to ``BRIEF`` shingles are too small for any window of 32 and are sought without MinHash: who
holds k of n shingles holds one of any n - k + 1 of them, so the item's rarest ones are looked up. That loses nothing.

Candidates are verified against the whole document's shingle set. Items are read in blocks of
bounded size; each block is one pass over the documents, which are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import hash_words, mix, runs, shingles, slices, text_bytes

PERMUTATIONS, BLOCK = 32, 16
BRIEF = 8  # shingles of an item that is sought exactly
BLOCK_SHINGLES = 500_000  # of benchmark items in memory at once
_OUT = "doc_id long, item_id long, n_shared long, n_item long"
_MULTIPLIERS = np.random.default_rng(1234).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def permuted(h: np.ndarray, i: int) -> np.ndarray:
    x = (h ^ _MULTIPLIERS[i]) * _MULTIPLIERS[i]
    return x ^ (x >> np.uint64(31))


class ItemIndex:
    """Signatures of a block of items: per size class and permutation, sorted minima and their items.

    ``brief`` has, per words in a shingle, the sorted shingles of which a match of a brief item holds one.
    """

    def __init__(self, items: list[tuple[int, str]], size: int, threshold: float):
        raw, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        words, first = hash_words(raw, offsets)
        shingle, begin = shingles(words, first, size)
        counts = np.diff(first)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sets = [np.unique(shingle[a:b]) for a, b in zip(begin, begin[1:], strict=False)]
        self.width = np.minimum(counts, size)  # words in one of its shingles
        exact = [len(s) <= BRIEF or w < size for s, w in zip(self.sets, self.width.tolist(), strict=True)]
        levels = [max(0, -(-len(s) // BLOCK) - 1).bit_length() for s in self.sets]
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for level in sorted(set(levels)):
            own = [k for k, x in enumerate(levels) if x == level and not exact[k]]
            if own:
                self.tables[level] = [self._table(own, i) for i in range(PERMUTATIONS)]
        brief: dict[int, list[int]] = {}
        for k, w in enumerate(self.width.tolist()):
            if len(self.sets[k]) and exact[k]:
                brief.setdefault(w, []).append(k)
        self.brief = {w: self._rarest(own, threshold) for w, own in brief.items()}

    def _rarest(self, own: list[int], threshold: float):
        known, times = np.unique(np.concatenate([self.sets[k] for k in own]), return_counts=True)
        keys, of = [], []
        for k in own:
            s = self.sets[k]
            n = len(s) - max(1, math.ceil(threshold * len(s))) + 1
            keys.append(s[np.argsort(times[np.searchsorted(known, s)], kind="stable")[:n]])
            of.append(np.full(len(keys[-1]), k))
        return _sorted_table(np.concatenate(keys), np.concatenate(of))

    def _table(self, own: list[int], i: int):
        return _sorted_table(np.array([permuted(self.sets[k], i).min() for k in own]), np.array(own))


def _sorted_table(low: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(low, kind="stable")
    marks = np.zeros(1 << 16, bool)
    marks[(low >> np.uint64(48)).astype(np.int64)] = True
    return low[order], own[order], marks


def _matches(values: np.ndarray, table) -> Iterator[tuple[int, np.ndarray]]:
    low, own, marks = table
    at = np.flatnonzero(marks[(values >> np.uint64(48)).astype(np.int64)])
    a, b = np.searchsorted(low, values[at], "left"), np.searchsorted(low, values[at], "right")
    for x, lo, hi in zip(at[a < b].tolist(), a[a < b].tolist(), b[a < b].tolist(), strict=True):
        yield x, own[lo:hi]


def candidates(index: ItemIndex, shingle: np.ndarray, begin: np.ndarray) -> set[tuple[int, int]]:
    """(row, item number) pairs of which some window and the item share a minimum."""
    sizes = np.diff(begin)
    blocks = -(-sizes // BLOCK)
    row = np.repeat(np.arange(len(sizes)), blocks)
    if not len(row):
        return set()
    end = np.cumsum(blocks)[row]  # the first block of the next row
    starts = begin[row] + (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    found: set[tuple[int, int]] = set()
    here = np.arange(len(row))
    for i in range(PERMUTATIONS):
        low, reach = np.minimum.reduceat(permuted(shingle, i), starts), 1
        for level in range(max(index.tables, default=-1) + 1):
            ahead = np.minimum(here + reach, len(row) - 1)
            low, reach = np.where(here + reach < end, np.minimum(low, low[ahead]), low), reach * 2
            if level in index.tables:
                for x, items in _matches(low, index.tables[level][i]):
                    found.update((int(row[x]), int(k)) for k in items)
    return found


def find_contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", size: int = 5, threshold: float = 0.8, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): documents that hold at least ``threshold`` of an item.

    Shingles are sets of ``size`` lower-cased words (A-Z); of an item with fewer words the shingle is
    its whole word sequence, looked for anywhere in a document. Items without words match nothing, nor
    does an empty or null document. Items that share an id report their best match once; repeated
    documents report each time; null ids of items are left out, null ids of documents stay. Empty
    tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    listed = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).dropna().distinct().orderBy("item_id", "text")
    passes, block, n = [], [], 0
    for r in listed.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        n += len(r["text"].split())
        if n >= block_shingles:
            passes.append(rows.mapInArrow(_search(block, size, threshold), _OUT))
            block, n = [], 0
    if block or not passes:
        passes.append(rows.mapInArrow(_search(block, size, threshold), _OUT))
    return reduce(DataFrame.unionByName, passes)


def _search(items: list[tuple[int, str]], size: int, threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items, size, threshold)
        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column(1))
            words, first = hash_words(raw, offsets)
            shingle, begin = runs(words, first, size)
            found = candidates(index, shingle, begin)
            cut = {w: (shingle, begin) if w == size else runs(words, first, w) for w in {size, *index.brief}}
            for w, table in index.brief.items():
                s, at = cut[w]
                for x, own in _matches(s, table):
                    row = int(np.searchsorted(at, x, "right")) - 1
                    found.update((row, int(k)) for k in own)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for x, k in sorted(found):
                s, at = cut[int(index.width[k])]
                n_item = len(index.sets[k])
                shared = int(np.isin(index.sets[k], s[at[x]:at[x + 1]]).sum())
                if shared >= threshold * n_item:
                    pair = (x, int(index.ids[k]))
                    best[pair] = max(best.get(pair, (0, 1)), (shared, n_item), key=lambda p: (p[0] / p[1], p))
            if best:
                take = batch.column(0).take(pa.array([x for x, _ in best]))
                yield pa.RecordBatch.from_arrays([take, pa.array([i for _, i in best], pa.int64()), pa.array([p[0] for p in best.values()], pa.int64()),
                                                  pa.array([p[1] for p in best.values()], pa.int64())], ["doc_id", "item_id", "n_shared", "n_item"])

    return search
