"""Jaccard join on word n-grams by vertical partitioning.

The global n-gram order is cut into fragments, ranges of the n-gram hash. Each fragment sees, for
every document, only its segment there:

1. Documents become sets of 5-word shingles. Equal sets are one class from here on; its id is a
   hash of the set. Tasks send each fragment the segments of a chunk of documents, packed.
2. A fragment counts in how many sets each n-gram lies. It answers each chunk with the n-grams that
   are shared at all and their counts. What nobody shares comes first in the order rare-to-common.
3. A set can only be linked if 80 % of it is shared, and two linked sets meet in an n-gram of both
   prefixes: the rarest 20 % and one. Unshared n-grams fill most prefixes, so few sets remain.
4. Candidate pairs from the prefixes are verified by fragments: partial overlaps are counted for
   each fragment apart and summed per pair.

A group of n near copies has n*n/2 links, which nobody needs to see one by one. Candidates are taken
as stars (all members of a prefix group with one pivot) until the pairs that could still connect
different components are about as few as the prefix entries; all of those are then verified. So
components are those of all links.

An n-gram that is common inside a chunk sends only its count to the fragment; its occurrences stay
with the chunk. No fragment holds a common n-gram's documents.
N-grams are compared by 48 bits of hash: an overlap of two sets of 500 is off by one with odds of 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import checkpointed
from .components import connected_components
from .words import hash_words, mix, release, shingles, slices, text_bytes

SIZE, PERCENT = 5, 80
CHUNK_NGRAMS, CHUNK_SETS = 3 << 19, 1 << 16
COMMON = 1 / 64  # of a chunk's sets: an n-gram that is in more of them is counted, not listed
OVERLAP_FRAGMENTS = 8
ANSWER_ENTRIES = 1 << 20
_BITS = np.uint64(16)
_BLOBS = "part long, chunk long, entries binary, ids binary, sizes binary, common binary, common_counts binary"
_ANSWERS = "chunk long, entries binary, counts binary, common binary, common_counts binary, ids binary, sizes binary, own binary"
_SETS = "set_id long, n long, unshared long, prefix array<long>, segments array<array<long>>"


def needed(n, percent: int = PERCENT):
    """The smallest overlap that a set of ``n`` has with any linked set."""
    return -(-percent * n // 100)


def text_sets(column, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit n-grams of each row, each row's first one, sizes and set ids."""
    raw, offsets = text_bytes(column)
    words, first = hash_words(raw, offsets)
    grams, begin = shingles(words, first, size)
    rows = len(begin) - 1
    out, sizes = [], np.zeros(rows, np.int64)
    for a in range(0, rows, 1 << 16):
        b = min(rows, a + (1 << 16))
        row = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(begin[a:b + 1]))
        key = np.unique((row << np.uint64(48)) | (grams[begin[a]:begin[b]] >> _BITS))
        sizes[a:b] = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=b - a)
        out.append(key & np.uint64((1 << 48) - 1))
    grams = np.concatenate(out) if out else np.empty(0, np.uint64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams * np.uint64(0x9E3779B97F4A7C15)))))
    ids = mix(sums[begin[1:]] - sums[begin[:-1]] + sizes.astype(np.uint64)).view(np.int64)
    return grams, begin, sizes, ids


def document_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_shingles, set_id) of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, _, sizes, ids = text_sets(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(ids)], ["doc_id", "n_shingles", "set_id"])

    return docs.mapInArrow(read, "doc_id long, n_shingles long, set_id long")


def _send(size: int, fragments: int):
    """Chunks of sets, cut into fragments: entries are n-gram and set number in 64 bits."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        seen: dict[int, int] = {}
        entries, sizes, held = [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal number, held
            chunk = (task << 32) + number
            key = np.sort(np.concatenate(entries)) if entries else np.empty(0, np.uint64)
            gram = key >> _BITS
            edge = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.empty(0, np.int64)
            count = np.diff(np.append(edge, len(gram)))
            often = count > max(64, int(COMMON * len(seen)))
            common, counts = gram[edge[often]], count[often].astype(np.uint32)
            apart = np.repeat(often, count)
            own, key = key[apart], key[~apart]
            cuts = np.array([-(-(f << 48) // fragments) << 16 for f in range(1, fragments)], np.uint64)
            at, to = np.searchsorted(key, cuts), np.searchsorted(common, cuts >> _BITS)
            ids, n = np.fromiter(seen, np.int64, len(seen)), np.array(sizes, np.uint32)
            rows = [{"part": f, "chunk": chunk, "entries": x.tobytes(), "ids": ids.tobytes(), "sizes": None, "common": c.tobytes(), "common_counts": k.tobytes()}
                    for f, (x, c, k) in enumerate(zip(np.split(key, at), np.split(common, to), np.split(counts, to), strict=True)) if len(x) or len(c)]
            rows.append({"part": -1 - chunk, "chunk": chunk, "entries": own.tobytes(), "ids": ids.tobytes(), "sizes": n.tobytes(), "common": None, "common_counts": None})
            seen.clear(), entries.clear(), sizes.clear()
            number, held = number + 1, 0
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("chunk", pa.int64())] + [
                (c, pa.binary()) for c in ("entries", "ids", "sizes", "common", "common_counts")]))

        for batch in slices(batches, "text"):
            grams, begin, n, ids = text_sets(batch.column(0), size)
            for a, b, k, i in zip(begin.tolist(), begin[1:].tolist(), n.tolist(), ids.tolist(), strict=False):
                if k and i not in seen:
                    entries.append((grams[a:b] << _BITS) | np.uint64(len(seen)))
                    seen[i] = k
                    sizes.append(k)
                    held += k
                    if held >= CHUNK_NGRAMS or len(seen) == CHUNK_SETS:
                        yield out()
        if seen:
            yield out()

    return send


def _buffers(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """The binary values of a column as arrays that share its memory."""
    return [np.frombuffer(v.as_buffer(), kind) if v.is_valid else np.empty(0, kind) for v in column]


def _answer_range(keys: list[np.ndarray], ids: list[np.ndarray], commons: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list, list, list]:
    """Of one range of n-grams, each chunk's entries that are shared, how many sets share them, and the counts of its common ones."""
    where = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
    owner = np.concatenate([i[(k & np.uint64(0xFFFF)).astype(np.int64)] for i, k in zip(ids, keys, strict=True)])
    key = np.concatenate(keys)
    often, inverse = np.unique(np.concatenate(commons), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts).astype(np.int64), minlength=len(often)).astype(np.int64)

    order = np.argsort(key >> _BITS, kind="stable")
    gram = key[order] >> _BITS
    twice = np.zeros(len(gram), bool)
    same = gram[1:] == gram[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    if len(often):
        at = np.minimum(np.searchsorted(often, gram), len(often) - 1)
        twice |= often[at] == gram
    order, gram = order[twice], gram[twice]
    inner = np.lexsort((owner[order], gram))
    order, gram = order[inner], gram[inner]
    new_gram = np.concatenate(([True], gram[1:] != gram[:-1])) if len(gram) else np.empty(0, bool)
    new_set = new_gram.copy()
    new_set[1:] |= owner[order][1:] != owner[order][:-1]
    group = np.cumsum(new_gram) - 1
    count = np.bincount(group, weights=new_set, minlength=group[-1] + 1 if len(group) else 0).astype(np.int64)
    if len(often) and len(gram):
        distinct = gram[new_gram]
        at = np.minimum(np.searchsorted(often, distinct), len(often) - 1)
        hit = often[at] == distinct
        count[hit] += total[at[hit]]
        to = np.minimum(np.searchsorted(distinct, often), len(distinct) - 1)
        total = np.where(distinct[to] == often, count[to], total)
    shared = count[group] >= 2 if len(group) else np.empty(0, bool)
    order, n_sets = order[shared], count[group][shared].astype(np.uint32) if len(group) else np.empty(0, np.uint32)
    back = np.argsort(where[order], kind="stable")
    order, n_sets = order[back], n_sets[back]
    cut = np.searchsorted(where[order], np.arange(1, len(keys)))
    return np.split(key[order], cut), np.split(n_sets, cut), [total[np.searchsorted(often, c)].astype(np.uint32) for c in commons]


def _answer(table: pa.Table) -> pa.Table:
    """Of one fragment, all chunks' entries that are shared, with the number of sets that share them.

    The fragment is worked off in ranges of about ``ANSWER_ENTRIES`` n-grams, so what it needs beside its own bytes is bounded.
    """
    schema = pa.schema([("chunk", pa.int64())] + [(c, pa.binary()) for c in ("entries", "counts", "common", "common_counts", "ids", "sizes", "own")])
    n = table.num_rows
    if table["part"][0].as_py() < 0:
        kept = {"chunk": table["chunk"], "ids": table["ids"], "sizes": table["sizes"], "own": table["entries"]}
        return pa.table([kept.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)
    keys, ids = _buffers(table["entries"], np.uint64), _buffers(table["ids"], np.int64)
    commons, counts = _buffers(table["common"], np.uint64), _buffers(table["common_counts"], np.uint32)
    steps = max(1, -(-sum(map(len, keys)) // ANSWER_ENTRIES))
    low, high = min((int(k[0]) for k in keys if len(k)), default=0) >> 16, (max((int(k[-1]) for k in keys if len(k)), default=0) >> 16) + 1
    cuts = np.array([low + (high - low) * i // steps for i in range(1, steps)], np.uint64)
    at = [np.concatenate(([0], np.searchsorted(k, cuts << _BITS), [len(k)])) for k in keys]
    to = [np.concatenate(([0], np.searchsorted(c, cuts), [len(c)])) for c in commons]
    found: list[list[bytes]] = [[[] for _ in range(n)] for _ in range(3)]
    for i in range(steps):
        part = _answer_range([k[a[i]:a[i + 1]] for k, a in zip(keys, at, strict=True)], ids,
                             [c[a[i]:a[i + 1]] for c, a in zip(commons, to, strict=True)], [c[a[i]:a[i + 1]] for c, a in zip(counts, to, strict=True)])
        for name, lists in zip(found, part, strict=True):
            for row, values in zip(name, lists, strict=True):
                row.append(values.tobytes())
    entries, n_sets, totals = ([b"".join(row) for row in name] for name in found)
    out = {"chunk": table["chunk"], "entries": pa.array(entries, pa.binary()), "counts": pa.array(n_sets, pa.binary()), "common": table["common"], "common_counts": pa.array(totals, pa.binary())}
    done = pa.table([out.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)
    del keys, ids, commons, counts, found, part
    release()
    return done


def _join_chunk(percent: int):
    """One chunk's sets with their shared n-grams: the prefix, and a segment for each overlap fragment."""

    def part(table: pa.Table, name: str, kind) -> np.ndarray:
        return np.concatenate(_buffers(table[name], kind))

    def join(table: pa.Table) -> pa.Table:
        # one row is the chunk's own: it alone has ids, sizes and what never left
        ids, sizes = part(table, "ids", np.int64), part(table, "sizes", np.uint32).astype(np.int64)
        key, count = part(table, "entries", np.uint64), part(table, "counts", np.uint32)
        own = part(table, "own", np.uint64)
        if len(own):
            common, total = part(table, "common", np.uint64), part(table, "common_counts", np.uint32)
            order = np.argsort(common)
            key = np.concatenate((key, own))
            count = np.concatenate((count, total[order][np.searchsorted(common[order], own >> _BITS)]))
        who, gram = (key & np.uint64(0xFFFF)).astype(np.int64), (key >> _BITS).astype(np.int64)
        shared = np.bincount(who, minlength=len(ids))
        least = needed(sizes, percent)
        stays = shared >= least
        keep = stays[who]
        who, gram, count = who[keep], gram[keep], count[keep]
        kept = np.flatnonzero(stays)
        by_order = np.lexsort((gram, count, who))
        first = np.searchsorted(who[by_order], kept)
        length = (sizes - least + 1 - (sizes - shared))[kept]
        prefix = gram[by_order][np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())] if len(kept) else np.empty(0, np.int64)
        by_gram = np.lexsort((gram, who))
        who, gram = who[by_gram], gram[by_gram]
        piece = np.searchsorted(kept, who) * OVERLAP_FRAGMENTS + (gram * OVERLAP_FRAGMENTS >> 48)
        release()
        inner = pa.ListArray.from_arrays(pa.array(np.searchsorted(piece, np.arange(len(kept) * OVERLAP_FRAGMENTS + 1)), pa.int32()), pa.array(gram))
        return pa.table({
            "set_id": ids[kept], "n": sizes[kept], "unshared": (sizes - shared)[kept],
            "prefix": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(prefix)),
            "segments": pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * OVERLAP_FRAGMENTS, pa.int32()), inner)})

    return join


def linkable_sets(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, fragments: int | None = None) -> DataFrame:
    """(set_id, n, prefix, segments) of the sets that may be linked to another; ``docs`` has a text."""
    fragments = fragments or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = (docs.select("text").mapInArrow(_send(size, fragments), _BLOBS)
               .groupBy("part").applyInArrow(_answer, _ANSWERS))
    sets = answers.groupBy("chunk").applyInArrow(_join_chunk(percent), _SETS)
    # a set that several chunks hold came back to each, with the same content
    return sets.groupBy("set_id").agg(F.first("n").alias("n"), F.first("unshared").alias("unshared"), F.first("prefix").alias("prefix"), F.first("segments").alias("segments"))


def _can_reach(percent: int) -> Column:
    """Could the sets have the overlap they need if their first shared n-gram is this one?

    At most as many n-grams as stand from here on are shared. A pair passes at its first one, or it
    is not linked; for sets of like size only the rarest ninth of each counts.
    """
    needs = (F.col("n") + F.col("n_b")) * percent
    return ((F.col("n") - F.col("at")) * (100 + percent) >= needs) & ((F.col("n_b") - F.col("at_b")) * (100 + percent) >= needs)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of distinct pairs (a, b): partial overlaps by fragment, summed per pair."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("set_id").alias(name), F.col("n").alias(f"n_{name}"), F.posexplode("segments").alias("fragment", f"g_{name}")).filter(F.size(f"g_{name}") > 0)

    overlap = F.size(F.array_intersect("g_a", "g_b"))
    return (pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"])
            .groupBy("a", "b").agg(F.sum(overlap).alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
            .filter(F.col("shared") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b"))


def set_components(sets: DataFrame, percent: int = PERCENT, rounds: int = 1, pivots: int = 3) -> DataFrame:
    """(node, label) of the sets of a written ``sets`` table that have a link.

    Star rounds, each with ``pivots`` members of every prefix group (the one with the fewest unshared
    n-grams, and random ones), go on while more pairs of
    different components share a prefix n-gram than there are prefix entries, ``rounds`` times at
    most; then every such pair is verified.
    """
    entries = sets.select("set_id", "n", "unshared", F.posexplode("prefix").alias("at", "gram")).withColumn("at", F.col("at") + F.col("unshared"))
    links, labels = None, None
    for turn in range(rounds + 1):
        if labels is None:
            marked = entries.withColumn("label", F.col("set_id"))
        else:
            marked = (entries.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
                      .withColumn("label", F.coalesce("label", "set_id")))
        # near copies change a text in places of their own: who shares most is nearest to all of them
        draws = {f"p{k}": F.struct((F.lit(0) if k else F.col("unshared")).alias("u"), F.xxhash64("set_id", F.lit(turn * pivots + k)).alias("h"), F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("label").alias("label_b"))
                 for k in range(pivots)}
        groups = (marked.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("c"), *[F.min(d).alias(p) for p, d in draws.items()])
                  .groupBy("gram").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("inside"), F.count(F.lit(1)).alias("labels"), *[F.min(p).alias(p) for p in draws])
                  .filter("labels > 1").select("gram", "m", "inside", F.array(*draws).alias("pivots")))
        seen = Observation()
        groups = checkpointed(groups.observe(seen, F.coalesce(F.sum("m"), F.lit(0)).alias("left"), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("inside")) / 2), F.lit(0)).alias("work")))
        left, work = seen.get["left"], seen.get["work"]
        if not left:
            break
        last = turn == rounds or work <= 2 * left
        own = marked.join(groups.select("gram", "pivots"), "gram").withColumnRenamed("set_id", "a")
        if last:
            pairs = own.join(own.select("gram", F.col("a").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("label").alias("label_b")), "gram").filter("label < label_b")
        else:
            pairs = own.select("a", "n", "at", "label", F.inline("pivots")).filter("label <> label_b")
        pairs = pairs.filter(_can_reach(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = checkpointed(verified(pairs, sets, percent))
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links)
        if last:
            break
    if labels is None:
        return sets.select(F.col("set_id").alias("node"), F.col("set_id").alias("label")).limit(0)
    return labels


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT,
                 fragments: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id) for every row.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets;
    ``component_id`` is the smallest key reachable by links. Words are lower-cased (A-Z); with fewer
    than ``size`` words the whole sequence is the one shingle. A document without words is empty and
    linked with nothing, copies of it neither. Repeated rows are copies; a null key takes part but
    never names a component that holds another key. An empty table gives no rows. Other columns are
    not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    members = checkpointed(document_sets(rows, size))
    labels = set_components(checkpointed(linkable_sets(rows, size, percent, fragments)), percent)
    classes = (members.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("low"))
               .join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id")))
    lowest = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "label").select("set_id", "component_id")
    full = members.join(named, "set_id", "left")
    return full.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "set_id")
