"""Prefix trie of conversations, each shard of it as balanced parentheses.

A node is a distinct prefix of turns; its name is its smallest member and its depth. Following smallest
members cuts the trie into chains: a conversation's own chain holds the nodes of which it is the smallest
member, and hangs on a node of a smaller conversation's chain. The path of chains (deeper attachments first)
and the depth put all nodes in preorder, so Spark sorts them by range into shards. A shard writes its nodes
as parentheses: `findclose` on the excess, with block minima in a tree, delimits every subtree; the rank of
pairs `()` counts its leaves and an array of running savings gives its savings. Nodes still open at a
shard's end are its spine: the tree of minima over shards tells where each closes, and its sums are put
together from that shard, the totals between and its own.

Nothing holds a whole conversation: prefixes are named by running sums of position hashes (two of 64 bits),
in blocks of the sorted table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

SHARD_NODES = 250_000
BLOCK = 64
PIECE_IDS = 50_000
_KEY = ["p1", "p2"]


class Excess:
    """A sequence of excesses with the minima of its blocks in a tree, for searches to the right."""

    def __init__(self, values: np.ndarray, block: int = BLOCK):
        self.values, self.block = values, block
        n = max(1, -(-len(values) // block))
        self.leaves = 1 << (n - 1).bit_length()
        self.high = int(values.max()) + 1 if len(values) else 1
        padded = np.full(self.leaves * block, self.high, np.int64)
        padded[:len(values)] = values
        self.padded = padded.reshape(self.leaves, block)
        tree = np.full(2 * self.leaves, self.high, np.int64)
        tree[self.leaves:] = self.padded.min(axis=1)
        level = self.leaves
        while level > 1:
            tree[level // 2:level] = tree[level:2 * level].reshape(-1, 2).min(axis=1)
            level //= 2
        self.tree = tree

    def next_at_most(self, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The first position from ``start`` on whose value is at most ``limit``; the length where there is none."""
        out = np.full(len(start), len(self.values), np.int64)
        for a in range(0, len(start), 1 << 16):
            out[a:a + (1 << 16)] = self._search(start[a:a + (1 << 16)], limit[a:a + (1 << 16)])
        return out

    def _inside(self, block: np.ndarray, begin: np.ndarray, limit: np.ndarray) -> np.ndarray:
        fits = (self.padded[block] <= limit[:, None]) & (np.arange(self.block) >= begin[:, None])
        return np.where(fits.any(axis=1), fits.argmax(axis=1), -1)

    def _search(self, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
        n = len(self.values)
        out = np.full(len(start), n, np.int64)
        live = np.flatnonzero(start < n)
        block = start[live] // self.block
        at = self._inside(block, start[live] % self.block, limit[live])
        out[live[at >= 0]] = block[at >= 0] * self.block + at[at >= 0]
        live, node = live[at < 0], self.leaves + block[at < 0]
        want = limit[live]
        climbing = np.ones(len(live), bool)
        while climbing.any():  # up until the right neighbour holds a small enough minimum
            right = climbing & (node % 2 == 0) & (self.tree[np.minimum(node + 1, 2 * self.leaves - 1)] <= want)
            node[right] += 1
            climbing &= ~right
            node[climbing] //= 2
            climbing &= node > 1
        found = node > 1
        live, node, want = live[found], node[found], want[found]
        while len(node) and (node < self.leaves).any():  # and down, left child first
            inner = node < self.leaves
            child = 2 * node
            child += self.tree[np.minimum(child, 2 * self.leaves - 1)] > want
            node = np.where(inner, child, node)
        at = self._inside(node - self.leaves, np.zeros(len(node), np.int64), want)
        out[live] = (node - self.leaves) * self.block + at
        return out


class Parentheses:
    """A preorder of depths as parentheses; a node opens after the closings down to its parent."""

    def __init__(self, depth: np.ndarray, own: np.ndarray):
        n = len(depth)
        closings = np.concatenate(([0], depth[:-1] - depth[1:] + 1)) if n else np.empty(0, np.int64)
        self.open_at = np.cumsum(closings + 1) - 1
        bits = np.full(int(self.open_at[-1]) + 1 if n else 0, -1, np.int64)
        bits[self.open_at] = 1
        base = int(depth[0]) if n else 0
        self.excess = Excess(np.cumsum(bits) + base)
        pair = np.zeros(len(bits) + 1, np.int64)  # leaf pairs "()" that begin before a position
        pair[1:][:-1] = (bits[:-1] == 1) & (bits[1:] == -1)
        self.leaf_rank = np.cumsum(pair)
        self.saved = np.concatenate(([0], np.cumsum(own)))
        self.open_rank = np.concatenate(([0], np.cumsum(bits == 1)))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes each opening one; the length if it lies behind the end."""
        return self.excess.next_at_most(at + 1, self.excess.values[at] - 1)

    def between(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf pairs and savings of the nodes that open in [a, b)."""
        return self.leaf_rank[b] - self.leaf_rank[a], self.saved[self.open_rank[b]] - self.saved[self.open_rank[a]]


_CARRIED = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256", "own"]
_SHARD = ("kind string, shard long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, ends_sha256 string, "
          "n_leaves long, saved_tokens long, first_depth long, least_depth long, last_depth long")


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the preorder: its nodes (closed or on the spine), the closings it has for earlier shards, and its totals."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    depth, own = table["depth"].to_numpy(), table["own"].to_numpy()
    n = len(depth)
    shard = table["shard"][0].as_py()
    tree = Parentheses(depth, own)
    size = len(tree.excess.values)
    close = tree.findclose(tree.open_at)
    leaves, saved = tree.between(tree.open_at, close)
    names = [f.split()[0] for f in _SHARD.split(", ")]

    def rows(kind: list[str], count: int, **columns) -> pa.RecordBatch:
        types = {f.split()[0]: pa.string() if f.endswith("string") else pa.int64() for f in _SHARD.split(", ")}
        full = {"kind": pa.array(kind), "shard": pa.array(np.full(count, shard))} | columns
        return pa.RecordBatch.from_arrays([full[c].cast(types[c]) if c in full else pa.nulls(count, types[c]) for c in names], names)

    carried = {c: table[c].combine_chunks() for c in _CARRIED if c != "own"}
    yield rows(np.where(close < size, "closed", "spine").tolist(), n, **carried, n_leaves=pa.array(leaves), saved_tokens=pa.array(saved))
    # depths of earlier shards that close behind the first node here
    least = int(depth.min())
    gone = np.arange(least, int(depth[0]))
    if len(gone):
        at = Excess(depth).next_at_most(np.zeros(len(gone), np.int64), gone)
        upto = tree.open_at[at]
        leaves, saved = tree.between(np.zeros_like(upto), upto)
        yield rows(["closing"] * len(gone), len(gone), depth=pa.array(gone), n_leaves=pa.array(leaves), saved_tokens=pa.array(saved))
    leaves, saved = tree.between(np.array([0]), np.array([size]))
    yield rows(["total"], 1, n_leaves=pa.array(leaves), saved_tokens=pa.array(saved), first_depth=pa.array(depth[:1]), least_depth=pa.array([least]), last_depth=pa.array(depth[-1:]))


def _merge_spines(spine: DataFrame, closings: DataFrame, totals: list) -> DataFrame:
    """Sums of the nodes that close in another shard than they open in, or nowhere.

    ``totals`` has one row per shard of a quarter of a million nodes; the last node of a shard is a leaf
    if the next shard does not begin below it, which no shard knows of itself.
    """
    totals = sorted(totals, key=lambda r: r["shard"])
    first, last = (np.array([r[c] for r in totals], np.int64) for c in ("first_depth", "last_depth"))
    leaf = np.append(first[1:] <= last[:-1], True).astype(np.int64) if totals else np.empty(0, np.int64)
    leaves = np.concatenate(([0], np.cumsum(np.array([r["n_leaves"] for r in totals], np.int64) + leaf)))
    saved = np.concatenate(([0], np.cumsum(np.array([r["saved_tokens"] for r in totals], np.int64))))
    shard = np.array([r["shard"] for r in totals], np.int64)
    least = np.array([r["least_depth"] for r in totals], np.int64)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Excess(least)
        for b in batches:
            place = np.searchsorted(shard, b.column("shard").to_numpy())
            depth = b.column("depth").to_numpy()
            until = tree.next_at_most(place + 1, depth)
            there = np.minimum(until, len(shard) - 1)
            count = b.column("n_leaves").to_numpy() + leaf[place] + leaves[until] - leaves[place + 1]
            token = b.column("saved_tokens").to_numpy() + saved[until] - saved[place + 1]
            inside = (until < len(shard)) & (depth < first[there])  # closes behind some nodes of that shard
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256")), pa.array(count), pa.array(token),
                 pa.array(shard[there], mask=~inside)], ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256", "n_leaves", "saved_tokens", "until"])

    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, ends_sha256 string, n_leaves long, saved_tokens long, until long"
    more = closings.select(F.col("shard").alias("until"), F.col("depth"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"))
    return (spine.mapInArrow(extend, schema).join(more, ["until", "depth"], "left")
            .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)))
            .withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))))


def _ends(rows: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256): digest of the ids that end at each node. Sorted ids are written in pieces, only pieces meet by node."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p1, p2, ids = (b.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.append(True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])))
            cut = np.unique(np.concatenate([cut, np.arange(0, len(ids), PIECE_IDS)]))
            text = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(p1[cut]), pa.array(p2[cut]), pa.array(ids[cut]), pa.array(text, pa.string())], ["p1", "p2", "first", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for b in batches:
            for p1, p2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (p1, p2) != node:
                    if state is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (p1, p2), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["p1", "p2", "ends_sha256"])
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["p1", "p2", "ends_sha256"])

    order = [*_KEY, "conv_id"]
    pieces = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "p1 long, p2 long, first long, text string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, "p1 long, p2 long, ends_sha256 string")


def _name(depth: Column, s1: Column, s2: Column) -> list[Column]:
    return [F.xxhash64(depth, s1, s2).alias("p1"), F.xxhash64(s2, depth, s1).alias("p2")]


def _rebuilt(conversations: DataFrame, conv: str, turn: str, role: str, text: str, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, depth) and (turns: conv_id, depth, x1, x2, words, block) after swapping in the first turns of the group's head."""
    t = (conversations.filter(F.col(conv).isNotNull())
         .select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie")))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("tie")]
    hashed = [F.xxhash64("role", "text").alias("x1"), F.xxhash64(F.lit(7), "text", F.length("role"), "role").alias("x2"),
              F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words")]
    placed = checkpointed(t.repartitionByRange(*order).sortWithinPartitions(*order)
                          .select("conv_id", *hashed, F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("seq")))
    # a conversation's turns are numbered in blocks: one count per block goes across
    blocks = placed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    across = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(across), F.lit(0)))
    inside = Window.partitionBy("conv_id", "block").orderBy("seq")
    turns = checkpointed(placed.withColumn("i", F.row_number().over(inside)).join(blocks.select("conv_id", "block", "before"), ["conv_id", "block"])
                         .select("conv_id", "block", (F.col("i") + F.col("before")).alias("i"), "x1", "x2", "words"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    heads = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    ids = (own.withColumn("h", h).withColumn("head", F.col("conv_id") - F.col("conv_id") % group).join(heads, "head", "left")
           .withColumn("k", F.least("h", F.coalesce("head_n", F.lit(0))))
           .select("conv_id", "head", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    ids = checkpointed(ids)
    first = turns.filter((F.col("conv_id") % group == 0) & (F.col("i") < most)).select(F.col("conv_id").alias("head"), "i", "x1", "x2", "words")
    taken = ids.join(first, "head").filter("i <= k").select("conv_id", F.col("i").alias("depth"), "x1", "x2", "words", F.lit(-1).cast("long").alias("block"), "length")
    kept = turns.filter(F.col("i") > h).join(ids.select("conv_id", "h", "k", "length"), "conv_id")
    kept = kept.select("conv_id", (F.col("k") + F.col("i") - F.col("h")).alias("depth"), "x1", "x2", "words", "block", "length")
    return ids.select("conv_id", "length"), taken.union(kept)


def build_prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      group: int = 20, most: int = 4, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node of the trie.

    Turns of a conversation are ordered by turn, null first, then by role and text; a null role or text is empty;
    rows with a null conversation are left out. A conversation c is rebuilt from the first h turns of c - c % ``group``
    (as many as there are) and its own behind its first h, h being crc32 of c in decimal modulo ``most``. Conversations
    without a turn left are members of the root alone. An empty table gives no rows; other columns are not read.
    Repeated rows are turns of their own. Prefixes are compared by 128 bits of hashes.
    """
    ids, rows = _rebuilt(conversations, conv, turn, role, text, group, most)
    # prefixes named by running sums, in blocks
    wide = "decimal(38,0)"
    rows = rows.withColumn("x1", F.xxhash64("depth", "x1", "x2").cast(wide)).withColumn("x2", F.xxhash64("x2", "depth", "x1").cast(wide))
    rows = checkpointed(rows)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("x1").alias("b1"), F.sum("x2").alias("b2"))
    zero = F.lit(0).cast(wide)
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), zero).cast(wide).alias(c) for c in ("b1", "b2")])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = (rows.select("*", *[F.sum(x).over(inside).alias(s) for x, s in (("x1", "s1"), ("x2", "s2"))]).join(blocks, ["conv_id", "block"])
              .withColumn("s1", (F.col("s1") + F.col("b1")).cast(wide)).withColumn("s2", (F.col("s2") + F.col("b2")).cast(wide)))
    up = _name(F.col("depth") - 1, (F.col("s1") - F.col("x1")).cast(wide), (F.col("s2") - F.col("x2")).cast(wide))
    prefixes = checkpointed(summed.select("conv_id", "depth", "length", "words", *_name(F.col("depth"), F.col("s1"), F.col("s2")), up[0].alias("u1"), up[1].alias("u2")))

    top = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    none = F.lit(0).cast("long")
    root = top.select(*_name(none, zero, zero), none.alias("depth"), "conv_id", "n_convs", none.alias("words"), F.lit(None).cast("long").alias("u1"), F.lit(None).cast("long").alias("u2"))
    nodes = (prefixes.groupBy(*_KEY).agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
                                         F.max("u1").alias("u1"), F.max("u2").alias("u2")).union(root.select(*_KEY, "depth", "conv_id", "n_convs", "words", "u1", "u2")))
    nodes = checkpointed(nodes)
    ends = _ends(prefixes.filter("depth = length").select(*_KEY, "conv_id").union(ids.filter("length = 0").select(*_name(none, zero, zero), "conv_id")))
    children = nodes.filter("depth > 0").groupBy(F.col("u1").alias("p1"), F.col("u2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    full = (nodes.join(children, _KEY, "left").join(ends, _KEY, "left").join(parents, ["u1", "u2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"), *_KEY))
    full = checkpointed(full)

    # the chains on the way from the root to each chain, deeper attachments first among those of one chain
    begins = full.filter("depth > 0 AND conv_id <> parent_conv_id").select(*_KEY, F.col("conv_id").alias("chain"))
    switch = F.sort_array(F.collect_list(F.struct("depth", "chain")))
    paths = (prefixes.select("conv_id", "depth", *_KEY).join(begins, _KEY).groupBy("conv_id").agg(switch.alias("path"))
             .filter(F.element_at("path", -1)["chain"] == F.col("conv_id"))
             .select("conv_id", F.transform("path", lambda s: F.struct((-s["depth"]).alias("back"), s["chain"].alias("chain"))).alias("path")))
    ordered = full.join(paths, "conv_id", "left").select(*_CARRIED, F.coalesce("path", F.array().cast("array<struct<back:bigint,chain:bigint>>")).alias("path"))
    shards = max(1, -(-full.count() // shard_nodes))
    placed = ordered.repartitionByRange(shards, "path", "depth").sortWithinPartitions("path", "depth")
    parts = checkpointed(placed.select(*_CARRIED, F.spark_partition_id().cast("long").alias("shard")).mapInArrow(_shard, _SHARD))
    totals = parts.filter("kind = 'total'").select("shard", "n_leaves", "saved_tokens", "first_depth", "least_depth", "last_depth").collect()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    spine = _merge_spines(parts.filter("kind = 'spine'"), parts.filter("kind = 'closing'"), totals)
    return parts.filter("kind = 'closed'").select(*columns).union(spine.select(*columns))
