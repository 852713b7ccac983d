"""Quality rules: counts of a text, then its distance from language references.

Each language label has two references, means over its documents that pass the counts: a histogram of
character classes, and one of its most common words and all others. A text is kept when some language
has both Jensen-Shannon distances within their limits. A histogram of few draws is far from its own
source, so each of the two is only asked of texts with a least length; a shorter text passes it.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .words import slices, text_bytes

SYMBOLS = "#*$%&|<>"
CLASSES = ("upper", "lower", "other_letter", "digit", "blank", "symbol", "punctuation", "rest")
SCALE = 1_000_000  # a document's histogram is taken in whole millionths, so sums do not depend on their order
WINDOW = 8
_BLANK = b" \t\n\x0b\x0c\r"
_FLUSH = 300_000
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@cache
def _class_table() -> np.ndarray:
    """Class number of every code point."""
    first = {"Lu": 0, "Lt": 0, "Ll": 1, "Lo": 2, "Lm": 2, "M": 2, "N": 3, "P": 6}
    out = np.full(0x110000, 7, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        out[point] = first.get(kind, first.get(kind[0], 7))
    out[[ord(c) for c in SYMBOLS]] = 5
    out[list(_BLANK)] = 4
    return out


def _repeated(codes: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row, the words that lie in a window of 8 words which the row holds more than once.

    Windows are named exactly, by doubling: the name of 2n words is that of a pair of names of n words.
    """
    none = np.zeros(n_rows, np.int64)
    if len(codes) < WINDOW:
        return none
    name, width = codes.astype(np.int64), 1
    while width < WINDOW:
        pair = name[:-width] * (int(name.max()) + 1) + name[width:]
        name, width = np.unique(pair, return_inverse=True)[1], 2 * width
    at = np.flatnonzero(row[:len(name)] == row[WINDOW - 1:])
    own = row[at] * (int(name.max()) + 1) + name[at]
    _, place, count = np.unique(own, return_inverse=True, return_counts=True)
    at = at[count[place] > 1]
    if not len(at):
        return none
    step = np.bincount(at, minlength=len(codes) + 1)[:len(codes) + 1] - np.bincount(at + WINDOW, minlength=len(codes) + 1)[:len(codes) + 1]
    return np.bincount(row[np.cumsum(step)[:-1] > 0], minlength=n_rows)


class Measured:
    """Counts and histograms of the texts of one batch."""

    def __init__(self, text: pa.Array, least_words: int, most_repeated: int):
        n = len(text)
        column = text.fill_null("")
        parts = pc.ascii_split_whitespace(column)
        flat = parts.flatten()
        begin = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.dictionary = pc.ascii_lower(coded.dictionary)
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(n), np.diff(begin))[full]
        self.n_words = np.bincount(self.row, minlength=n)
        raw, at = text_bytes(column)
        each = [raw[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.n_dup_lines = np.zeros(n, np.int64)
        for i, whole in enumerate(each):
            lines = [x for x in whole.split(b"\n") if x.strip(_BLANK)]
            self.n_dup_lines[i] = len(lines) - len(set(lines))
        points = [np.frombuffer(x.decode().encode("utf-32-le"), np.uint32) for x in each]
        who = np.repeat(np.arange(n), [len(p) for p in points])
        kind = _class_table()[np.concatenate(points)] if points else np.empty(0, np.uint8)
        self.classes = np.bincount(who * len(CLASSES) + kind, minlength=n * len(CLASSES)).reshape(n, len(CLASSES))
        self.word_chars = self.classes.sum(axis=1) - self.classes[:, 4]
        symbol = np.zeros(256, np.int64)
        symbol[[ord(c) for c in SYMBOLS]] = 1
        self.n_symbols = np.add.reduceat(np.append(symbol[raw], 0), np.minimum(at[:-1], len(raw))) * (np.diff(at) > 0) if n else np.empty(0, np.int64)
        self.n_repeat_words = _repeated(self.codes, self.row, n)
        self.failed = (self.n_words < least_words) | (100 * self.n_repeat_words > most_repeated * self.n_words)

    def word_shares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code of the lower-cased word, millionths of the row's words), once per row and word."""
        lowered = self.dictionary.dictionary_encode()
        code = lowered.indices.to_numpy().astype(np.int64)[self.codes] if len(self.codes) else self.codes
        self.lowered = lowered.dictionary
        key, count = np.unique(self.row * max(1, len(self.lowered)) + code, return_counts=True)
        row = key // max(1, len(self.lowered))
        return row, key % max(1, len(self.lowered)), SCALE * count // self.n_words[row]


def _references(docs: DataFrame, common: int, most_languages: int, least_words: int, most_repeated: int) -> dict[str, tuple[np.ndarray, dict[str, float]]]:
    """{language: (class shares, {common word: share})} over all labelled documents that pass the counts."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            keys, n = list(total), list(total.values())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                               pa.array([k[2] for k in keys], pa.string()), pa.array(n, pa.int64())], ["lang", "kind", "name", "n"])

        for batch in slices(batches, "text", 2 << 20):
            m = Measured(batch.column(1), least_words, most_repeated)
            label = batch.column(0).dictionary_encode()
            lang, of = label.dictionary.to_pylist(), label.indices.to_numpy(zero_copy_only=False)
            good = ~m.failed
            row, code, share = m.word_shares()
            keep = good[row]
            size = max(1, len(m.lowered))
            key, at = np.unique(of[row[keep]] * size + code[keep], return_inverse=True)
            words = m.lowered.to_pylist()
            for k, n in zip(key.tolist(), np.bincount(at, share[keep]).astype(np.int64).tolist(), strict=True):
                total[lang[k // size], "word", words[k % size]] += n
            for i in np.flatnonzero(good).tolist():
                name = lang[of[i]]
                total[name, "docs", ""] += 1
                for k, n in zip(CLASSES, (SCALE * m.classes[i] // m.classes[i].sum()).tolist(), strict=True):
                    total[name, "class", k] += n
            if len(total) > _FLUSH:
                yield flush()
        yield flush()

    labelled = docs.filter("lang IS NOT NULL").select("lang", "text")
    table = checkpointed(labelled.mapInArrow(shares, "lang string, kind string, name string, n long").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n")))
    most = table.filter("kind = 'docs'").orderBy(F.desc("n"), "lang").limit(most_languages).select("lang", F.col("n").alias("n_docs"))
    by_share = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "name")
    few = (table.filter("kind <> 'docs'").join(F.broadcast(most), "lang")
           .withColumn("rank", F.row_number().over(by_share)).filter(F.col("rank") <= common).collect())
    out: dict[str, tuple[np.ndarray, dict[str, float]]] = {}
    for r in few:
        classes, words = out.setdefault(r["lang"], (np.zeros(len(CLASSES)), {}))
        share = r["n"] / (SCALE * r["n_docs"])
        if r["kind"] == "word":
            words[r["name"]] = share
        else:
            classes[CLASSES.index(r["name"])] = share
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) of each row of ``p`` from ``q``; both sum to one."""
    mid = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / mid), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / mid), 0).sum(axis=1)
    return np.sqrt(np.maximum(0, (left + right) / 2))


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", class_limit: float = 0.28, word_limit: float = 0.46,
                  least_class_chars: int = 250, least_hist_words: int = 60, common: int = 50, least_words: int = 20, most_repeated: int = 30,
                  most_languages: int = 256) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, nearest, class_distance, word_distance), one row per row.

    A null or empty text has no words and fails; a null key stays null; repeated rows are judged each; an
    empty table gives no rows; other columns are not read. The label only says whose reference a text adds
    to: every text is compared with all languages, so a missing or wrong label changes nothing for it.
    ``nearest`` is the language with the smallest sum of both distances (the smaller name among equals);
    without any labelled document it is null and the counts alone decide. ``common`` words of a language
    are the largest mean shares, ties by the word. References are kept for the ``most_languages`` labels with
    most documents. Words are compared with A-Z lower-cased.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    known = _references(docs, common, most_languages, least_words, most_repeated)
    names = sorted(known)
    vocabulary = sorted({w for n in names for w in known[n][1]})
    place = {w: i for i, w in enumerate(vocabulary)}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(vocabulary, pa.string())
        references = []
        for n in names:
            classes, words = known[n]
            at = np.array(sorted(place[w] for w in words), np.int64)
            share = np.array([words[vocabulary[i]] for i in at.tolist()])
            references.append((classes / max(classes.sum(), 1e-300), at, np.append(share, max(0.0, 1 - share.sum()))))
        for batch in slices(batches, "text", 2 << 20):
            m = Measured(batch.column(1), least_words, most_repeated)
            n, v = batch.num_rows, len(vocabulary)
            found = pc.index_in(m.dictionary, value_set).fill_null(v).to_numpy(zero_copy_only=False).astype(np.int64)
            best = np.full(n, np.inf)
            near, by_class, by_word, good = np.full(n, -1), np.zeros(n), np.zeros(n), np.full(n, not names)
            step = max(1, (8 << 20) // (8 * (v + 1)))  # rows whose word histograms are held at once
            first = np.searchsorted(m.row, np.arange(n + 1))
            for a in range(0, n if names else 0, step):
                b = min(n, a + step)
                here = slice(first[a], first[b])
                hist = np.bincount((m.row[here] - a) * (v + 1) + found[m.codes[here]], minlength=(b - a) * (v + 1)).reshape(b - a, v + 1)
                size = np.maximum(1, m.n_words[a:b])[:, None]
                classes = m.classes[a:b] / np.maximum(1, m.classes[a:b].sum(axis=1))[:, None]
                for i, (class_ref, at, word_ref) in enumerate(references):
                    own = hist[:, at]
                    c = distance(classes, class_ref)
                    w = distance(np.column_stack((own, m.n_words[a:b] - own.sum(axis=1))) / size, word_ref)
                    good[a:b] |= (((c <= class_limit) | (m.word_chars[a:b] < least_class_chars))
                                  & ((w <= word_limit) | (m.n_words[a:b] < least_hist_words)))
                    closer = c + w < best[a:b]
                    rows = a + np.flatnonzero(closer)
                    best[rows], near[rows], by_class[rows], by_word[rows] = (c + w)[closer], i, c[closer], w[closer]
            empty = near < 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)),
                 pa.array(m.failed), pa.array(good & ~m.failed), pa.array([None if i < 0 else names[i] for i in near.tolist()], pa.string()),
                 pa.array(by_class, mask=empty), pa.array(by_word, mask=empty)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "class_distance", "word_distance"])

    return docs.select("doc_id", "text").mapInArrow(judge, f"{BASE}, kept boolean, nearest string, class_distance double, word_distance double")
