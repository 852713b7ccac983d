"""Cross-tokenizer alignment: groups of two tokenizations of a text between byte offsets where both end a token.

Most groups hold one token of each side with the same bytes. For those the partner is known before any
text is read: ``Aligner.same`` maps each A id to the B id of the same bytes. Their links are counted in
vectors of the vocabulary's length; only pairs of the other, irregular groups are shuffled.

Neither tokenizer lets a token run over a space that follows a visible character, so texts are cut there
and each piece is aligned once per worker. Tokenizers without that property get whole texts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .words import slices, text_bytes

_CACHE_PIECES = 300_000
_CACHE_BYTES = 24 << 20
_LOADED: dict[str, Aligner] = {}
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long"


def _byte_letters() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: visible Latin-1 stands for itself, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Aligns texts under tokenizer A (byte-level, from JSON) and B (sentence pieces). One per worker process."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        by_bytes = {}
        for i, x in enumerate(self.b_bytes):
            if x and (x not in by_bytes or not self.b.is_byte(i)):  # a written piece before the byte of the same value
                by_bytes[x] = i
        self.same = np.array([by_bytes.get(x, -1) for x in self.a_bytes], np.int64)
        self.size_a, self.size_b = len(self.a_bytes), len(self.b_bytes)
        self.by_piece = self._cuts_safely()
        self.reset()

    def _cuts_safely(self) -> bool:
        """Whether texts may be cut before a space that follows a visible character; shown by the vocabulary and a probe."""
        spaced = [x for x in (*self.a_bytes, *self.b_bytes) if b" " in x.lstrip(b" ")]
        try:
            if len(self.cut(pa.array([x.decode() for x in spaced], pa.string()))[0]) > len(spaced):
                return False
        except UnicodeDecodeError:
            return False
        probe = "It's a  probe,\tof\n  WORDS é ßü 12 3456 !? <|x|> don't  世界 \U0001f600 end"
        pieces = self.cut(pa.array([f" {probe}"]))[0].to_pylist()
        a, b = self.encode([f" {probe}"])
        pa_, pb = self.encode(pieces)
        return a[0] == sum(pa_, []) and b[0] == sum(pb, [])

    def encode(self, spaced: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space; B adds that space by itself."""
        return ([e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)], self.b.encode([t[1:] for t in spaced], num_threads=1))

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.shown: list[str] = []
        none = np.empty(0, np.int64)
        self.numbers = np.empty((3, 0), np.int64)  # per piece tokens of A, of B, groups; -1 groups: the bytes do not come back
        self.alike = (none, np.zeros(1, np.int64))  # A ids of the groups of two equal tokens, and where each piece's begin
        self.other = (none, np.zeros(1, np.int64))  # pairs of the other groups, a * size_b + b, likewise

    @staticmethod
    def cut(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all rows, and how many each row has. A piece begins at a row's start or at a space behind a visible character.

        Behind a character that may be white space of any kind there is no cut: the longer piece is right as well.
        """
        raw, at = text_bytes(column)
        if not len(raw):
            return pa.array([], pa.string()), np.zeros(len(column), np.int64)
        before = raw[:-1]
        visible = ((before > 0x20) & (before < 0x7F)) | (before >= 0x80)
        gap = np.flatnonzero((raw[1:] == 0x20) & visible) + 1
        wide = gap[raw[gap - 1] >= 0x80]
        if len(wide):
            lead = [raw[np.maximum(wide - k, 0)] for k in (3, 2)]
            doubtful = (lead[1] == 0xC2) | np.isin(lead[0], (0xE1, 0xE2, 0xE3, 0xEF))
            gap = np.setdiff1d(gap, wide[doubtful], assume_unique=True)
        full = at[:-1][np.diff(at) > 0]
        starts = np.union1d(full, gap)
        offsets = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw)))
        return pieces, np.searchsorted(starts, at[1:]) - np.searchsorted(starts, at[:-1])

    def _together(self, pieces: list[str]) -> tuple | None:
        """Ids of both sides for pieces encoded as one text, and how many each piece has; None where the bytes or the cuts do not fit."""
        text = "".join(pieces)
        (a,), (b,) = self.encode([text])
        raw = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        cuts = np.cumsum(pc.binary_length(pa.array(pieces, pa.string())).to_numpy())
        out = []
        for ids, size in ((np.array(a, np.int64), self.a_len), (np.array(b, np.int64), self.b_len)):
            ends = np.cumsum(size[ids])
            at = np.searchsorted(ends, cuts)
            if (ends[at] != cuts).any():
                return None
            out.append((ids, np.diff(at, prepend=-1)))
        return out

    def learn(self, pieces: list[str]) -> list[tuple]:
        """Adds new pieces to the cache; returns their numbers to be added to the arrays."""
        if (found := self._together(pieces)) is None:
            if len(pieces) > 1:
                half = len(pieces) // 2
                return self.learn(pieces[:half]) + self.learn(pieces[half:])
            found = [(np.empty(0, np.int64), np.zeros(1, np.int64))] * 2
            unsound = True
        else:
            unsound = False
        (ids_a, size_a), (ids_b, size_b) = found
        ends_a, ends_b = np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        count_a, count_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
        alike = (count_a == 1) & (count_b == 1)
        if len(common):
            alike &= self.same[ids_a[first_a]] == ids_b[first_b]
        # between two neighbouring ends of either side lies the overlap of exactly one A and one B token
        ends = np.union1d(ends_a, ends_b)
        of = np.searchsorted(common, ends)
        rest = ~alike[of] if len(of) else np.empty(0, bool)
        pair = ids_a[np.searchsorted(ends_a, ends[rest])] * self.size_b + ids_b[np.searchsorted(ends_b, ends[rest])]
        groups = np.searchsorted(common, ends_a[np.cumsum(size_a) - 1]) + 1 if len(common) else np.zeros(len(pieces), np.int64)  # up to each piece's end
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        shown = [f"{text_a[i]}|{text_b[j]}" if n == 1 and m == 1 else ",".join(text_a[i:i + n]) + "|" + ",".join(text_b[j:j + m])
                 for i, j, n, m in zip(first_a.tolist(), first_b.tolist(), count_a.tolist(), count_b.tolist(), strict=True)]
        self.known.update(zip(pieces, range(len(self.shown), len(self.shown) + len(pieces)), strict=True))
        bounds = [0, *groups.tolist()]
        joined = [";".join(shown[g:h]) for g, h in zip(bounds[:-1], bounds[1:], strict=True)]
        self.shown += joined
        self.held += sum(map(len, pieces)) + sum(map(len, joined))
        n_groups = np.diff(groups, prepend=0) if not unsound else np.array([-1])
        return [(np.stack((size_a, size_b, n_groups)), ids_a[first_a[alike]], np.searchsorted(np.flatnonzero(alike), groups), pair, np.searchsorted(of[rest], groups))]

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece lies in the cache, after learning the new ones."""
        coded = pieces.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        new = [t for t in unique if t not in self.known]
        if new:
            # behind these a piece may follow in one text; the others are encoded alone
            last = np.array([ord(t[-1]) for t in new])
            free = ((last > 0x20) & (last < 0x7F)) | ((last >= 0xC0) & (last < 0x1000))
            added = []
            joint, size, batch = [], 0, []
            for t, ok in zip(new, free.tolist(), strict=True):
                if ok and self.by_piece:
                    batch.append(t)
                    size += len(t)
                    if size > 1 << 14:
                        joint.append(batch)
                        size, batch = 0, []
                else:
                    joint.append([t])
            for group in [*joint, *([batch] if batch else [])]:
                added += self.learn(group)
            self.numbers = np.concatenate([self.numbers, *[x[0] for x in added]], axis=1)
            for name, ids, ends in (("alike", 1, 2), ("other", 3, 4)):
                values, begin = getattr(self, name)
                shift = len(values) + np.cumsum([0, *[len(x[ids]) for x in added]])
                setattr(self, name, (np.concatenate([values, *[x[ids] for x in added]]), np.concatenate([begin, *[x[ends] + k for x, k in zip(added, shift.tolist(), strict=False)]])))
        return np.array([self.known[t] for t in unique], np.int64)[coded.indices.to_numpy()]

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of each text (tokens of A, of B, groups), its groups in writing, and its equal tokens and other pairs as (row, id)."""
        if len(self.known) > _CACHE_PIECES or self.held > _CACHE_BYTES:
            self.reset()
        spaced = pa.array([f" {t}" if t else "" for t in texts.to_pylist()], pa.string())
        n = len(spaced)
        pieces, count = self.cut(spaced) if self.by_piece else (spaced.filter(pa.array([bool(t) for t in spaced.to_pylist()])), np.array([int(bool(t)) for t in spaced.to_pylist()], np.int64))
        at = self.places(pieces) if len(pieces) else np.empty(0, np.int64)
        row = np.repeat(np.arange(n), count)
        doubtful = np.unique(row[self.numbers[2, at] < 0]) if len(at) else np.empty(0, np.int64)
        if len(doubtful):  # a piece whose bytes do not come back: the whole text decides
            keep = ~np.isin(row, doubtful)
            whole = self.places(spaced.take(pa.array(doubtful)))
            at, row = np.concatenate((at[keep], whole)), np.concatenate((row[keep], doubtful))
            keep = self.numbers[2, at] >= 0
            at, row = at[keep], row[keep]
            order = np.argsort(row, kind="stable")
            at, row = at[order], row[order]
        numbers = np.stack([np.bincount(row, x[at], n).astype(np.int64) for x in self.numbers]) if len(at) else np.zeros((3, n), np.int64)
        begin = np.searchsorted(row, np.arange(n + 1)).tolist()
        where = at.tolist()
        shown = [";".join(map(self.shown.__getitem__, where[x:y])) for x, y in zip(begin[:-1], begin[1:], strict=True)]

        def spread(part: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            values, start = part
            count = start[at + 1] - start[at]
            to = np.cumsum(count)
            return np.repeat(row, count), values[np.arange(to[-1] if len(to) else 0) + np.repeat(start[at] - to + count, count)]

        return numbers, shown, spread(self.alike), spread(self.other)


def aligner(a_json: str, b_model: bytes) -> Aligner:
    key = hashlib.sha256(a_json.encode() + b_model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Aligner(a_json, b_model)
    return _LOADED[key]


def _tallies(row: np.ndarray, value: np.ndarray, n: int, base: int) -> tuple[pa.Array, pa.Array]:
    """Per row the distinct values and how often each comes, as two list columns."""
    key, count = np.unique(row * base + value, return_counts=True)
    offsets = pa.array(np.searchsorted(key, np.arange(n + 1) * base).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(key % base, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(count, pa.int64()))


def align_tokenizers(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    A text is encoded with a space before it. Links are the pairs of an A and a B token that overlap; the count
    of a pair of ids is how many links it has in all documents, n_best counts the links whose count is the
    largest of their B id (ties included), count_sum adds the counts of all links. Null and empty texts, and
    texts whose bytes either side does not give back, have no tokens. Repeated rows count each; a null key
    stays null; an empty table gives no rows; other columns are not read.
    """
    import public_tokenizers
    with open(a_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        b_model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    own = Aligner(a_json, b_model)
    same, size_a, size_b = own.same, own.size_a, own.size_b

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = aligner(*shared.value)
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", 1 << 20):
            n = batch.num_rows
            (n_a, n_b, groups), shown, alike, other = worker.align(batch.column(1))
            digest = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(n)), batch.column(0), pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(n_a + n_b - groups), pa.array(digest, pa.string()),
                 *_tallies(*alike, n, size_a), *_tallies(*other, n, size_a * size_b)],
                ["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "alike", "alike_n", "other", "other_n"])
            number += n

    tables = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = checkpointed(tables.mapInArrow(encode, f"row_id long, {DIGEST}, groups_sha256 string, alike array<long>, alike_n array<long>, other array<long>, other_n array<long>"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size_a, np.int64)  # of the groups of two equal tokens, by A id
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
            pairs, at = np.unique(batch.column(2).flatten().to_numpy(), return_inverse=True)
            count = np.zeros(len(pairs), np.int64)
            np.add.at(count, at, batch.column(3).flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(count, pa.int64())], ["pair", "n"])
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids * size_b + same[ids], pa.int64()), pa.array(total[ids], pa.int64())], ["pair", "n"])

    counts = checkpointed(rows.select("alike", "alike_n", "other", "other_n").mapInArrow(tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b_of = (F.col("pair") % size_b).alias("b")
    # pairs and documents both grow with the input: always joined by shuffle, so that the plan is the same at every size
    highest = counts.select(b_of, "n").groupBy("b").agg(F.max("n").alias("most"))
    judged = checkpointed(counts.select("pair", "n", b_of).join(highest.hint("merge"), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))

    # one row per A id at most: the vocabulary's length bounds what is collected and sent out
    vector, best = np.zeros(size_a, np.int64), np.zeros(size_a, np.int64)
    ids = np.flatnonzero(same >= 0)
    wanted = docs.sparkSession.createDataFrame(pa.table({"pair": ids * size_b + same[ids]}))
    for r in judged.join(F.broadcast(wanted), "pair").toArrow().to_pylist():
        vector[r["pair"] // size_b], best[r["pair"] // size_b] = r["n"], r["best"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            at = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
            out = []
            for table in (best, vector):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, at, table[ids] * n)
                out.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["row_id", "n_best", "count_sum"])

    even = rows.select("row_id", "alike", "alike_n").mapInArrow(sums, "row_id long, n_best long, count_sum long")
    links = rows.select("row_id", F.explode(F.arrays_zip("other", "other_n")).alias("l")).select("row_id", F.col("l.other").alias("pair"), F.col("l.other_n").alias("links"))
    uneven = links.join(judged.hint("merge"), "pair").select("row_id", (F.col("links") * F.col("best")).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    added = even.union(uneven).groupBy("row_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(added.hint("merge"), "row_id").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
