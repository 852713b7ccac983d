"""Language identification: the family first, then one-versus-one linear SVMs inside it.

Texts become frequencies of byte 1- to 3-grams, hashed into ``DIM`` places. Families are found from the
training rows: the languages' mean vectors are merged, nearest first, until about the square root of
their number remains. Families are told apart by pairwise linear SVMs too; inside a family every pair
of languages has its own. The most wins decide, then the larger sum of margins, then the name.

Fitting reads a bounded sample: at most ``SAMPLE_ROWS`` labelled rows, as many of each language, the
least by a hash of the key. Predictions read every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .words import mix, slices, text_bytes

DIM, SAMPLE_ROWS = 2048, 4000
UNKNOWN = "und"
_TABLE = (mix(np.arange(1, 769, dtype=np.uint64)).reshape(3, 256) % np.uint64(DIM)).astype(np.int32)
# letters stay, other ASCII becomes a space; bytes of longer characters stay
_FOLD = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
_FOLD[65:91] += 32


def features(column) -> np.ndarray:
    """One row per text: square roots of hashed n-gram counts, scaled to length 1 (0 without letters)."""
    raw, offsets = text_bytes(column)
    text = _FOLD[raw]
    if len(text) > 1:  # capitals of the Latin-1 letters
        text[1:][(text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E)] += 0x20
    rows = len(offsets) - 1
    out = np.zeros((rows, DIM), np.float32)
    for a in range(0, rows, 256):  # 256 rows of counts at a time, long rows in parts
        b = min(rows, a + 256)
        counts = np.zeros((b - a) * DIM, np.int64)
        for lo in range(int(offsets[a]), int(offsets[b]), 1 << 20):
            hi = min(int(offsets[b]), lo + (1 << 20))
            part = text[lo:min(hi + 2, int(offsets[b]))]
            row = np.searchsorted(offsets, np.arange(lo, lo + len(part)), "right") - 1 - a
            word = part != 32
            code, whole = _TABLE[0][part], word
            for n in range(3):
                m = min(hi - lo, len(part) - n)
                if m <= 0:
                    break
                if n:
                    code = (code[:m] * 5 + _TABLE[n][part[n:n + m]]) & (DIM - 1)
                    whole = (whole[:m] | word[n:n + m])
                same = whole[:m] & (row[:m] == row[n:n + m])
                counts += np.bincount(row[:m][same] * DIM + code[:m][same], minlength=len(counts))
        part = np.sqrt(counts.reshape(b - a, DIM)).astype(np.float32)
        out[a:b] = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, strength: float = 0.01, steps: int = 150) -> np.ndarray:
    """Weights and bias of a squared-hinge SVM for labels -1 and 1, both sides of equal weight."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, v, rate, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 1 / (2 * 2 + strength), 1.0
    for _ in range(steps):  # accelerated gradient; rows have length sqrt(2) at most
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - np.float32(rate) * (np.float32(strength) * v - 2 * ((weight * slack * y) @ x))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + np.float32((t - 1) / t2) * (new - w), t2
    return w


def slope(margins: np.ndarray, y: np.ndarray) -> float:
    """The steepness of the logistic curve that suits the margins best, capped by one smoothed error."""
    tries = np.geomspace(0.25, 16, 25)
    loss = [np.logaddexp(0, -a * y * margins).mean() + np.logaddexp(0, a * y * margins).mean() / (len(y) + 2) for a in tries]
    return float(tries[int(np.argmin(loss))])


class Level:
    """Pairwise linear SVMs between a few classes."""

    def __init__(self, names: list[str], x: np.ndarray, label: np.ndarray):
        self.names, self.pairs, weights, self.slopes = names, list(combinations(range(len(names)), 2)), [], []
        for i, j in self.pairs:
            at = np.flatnonzero((label == i) | (label == j))
            y = np.where(label[at] == i, 1.0, -1.0)
            w = linear_svm(x[at], y)
            weights.append(w)
            self.slopes.append(slope(x[at] @ w[:-1] + w[-1], y))
        self.weights = np.array(weights) if weights else np.zeros((0, x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's number and its least pairwise probability."""
        k = len(self.names)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        wins, sums, least = np.zeros((len(x), k)), np.zeros((len(x), k)), np.ones((len(x), k))
        for p, (i, j) in enumerate(self.pairs):
            chance = 1 / (1 + np.exp(-self.slopes[p] * margin[:, p]))
            for c, s, q in ((i, margin[:, p], chance), (j, -margin[:, p], 1 - chance)):
                wins[:, c] += s > 0
                sums[:, c] += s
                least[:, c] = np.minimum(least[:, c], q)
        best = np.lexsort((np.broadcast_to(-np.arange(k), sums.shape), sums, wins), axis=1)[:, -1]
        return best, least[np.arange(len(x)), best]


def families(x: np.ndarray, label: np.ndarray, k: int) -> list[list[int]]:
    """Languages merged by the nearest mean vectors (average linkage) to about sqrt(k) groups.

    What all languages have in common is taken off first.
    """
    means = np.array([x[label == i].mean(axis=0) for i in range(k)])
    means = means - means.mean(axis=0)
    means /= np.linalg.norm(means, axis=1, keepdims=True) + 1e-12
    near, groups = means @ means.T, [[i] for i in range(k)]
    while len(groups) > max(1, round(k**0.5)):
        _, a, b = max((near[np.ix_(p, q)].mean(), i, j) for (i, p), (j, q) in combinations(enumerate(groups), 2))
        groups[a] = sorted(groups[a] + groups.pop(b))
    return groups


class Model:
    def __init__(self, x: np.ndarray, labels: list[str]):
        self.names = sorted(set(labels))
        label = np.array([self.names.index(v) for v in labels], np.int64)
        self.groups = families(x, label, len(self.names)) if labels else []
        of = np.zeros(len(self.names), np.int64)
        for g, members in enumerate(self.groups):
            of[members] = g
        self.top = Level([str(g) for g in range(len(self.groups))], x, of[label]) if labels else None
        self.inner = [Level([self.names[i] for i in g], x[np.isin(label, g)], np.searchsorted(g, label[np.isin(label, g)])) for g in self.groups]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.groups:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        family, score = self.top.predict(x)
        out = np.full(len(x), "", object)
        for g, level in enumerate(self.inner):
            at = np.flatnonzero(family == g)
            if len(at):
                best, p = level.predict(x[at])
                out[at] = np.array(level.names, object)[best]
                score[at] *= p
        return out.tolist(), score


def held_out(key: Column) -> Column:
    """Rows kept for measuring: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


def fit(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labelled, not held-out rows with a letter; ``sample_rows`` of them at most."""
    rows = docs.select(F.col(label).cast("string").alias("label"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    # one label more than the sample has rows would leave none for some
    labels = max(1, rows.select("label").distinct().limit(sample_rows).count())
    order = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key")
    least = (rows.select("label", "key").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample_rows // labels)
             .select("label", "key").distinct())
    # a written table of at most sample_rows keys: Spark sends it to the texts, which stay where they are
    sample = rows.join(checkpointed(least), ["label", "key"]).filter(F.col("text").rlike(r"\p{L}")).select("label", "text").limit(sample_rows)
    got = sample.mapInArrow(_features_of, "label string, x binary").orderBy("label", "x").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, DIM)
    return Model(x, got["label"].tolist())


def identify_language(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", carry: list[str] | None = None,
                      names: tuple[str, str, str] = ("held_out", "lang_pred", "score"), **fitting) -> DataFrame:
    """(held_out, lang_pred, score) beside the columns in ``carry`` (default: the key), for every row.

    ``lang_pred`` is a learned label, or ``und`` with score 0 when the text is null or has no letter,
    or nothing was learned. ``score`` is the product of the least pairwise probabilities of the
    family and of the language in it. Repeated rows are predicted each; a null key is not held
    out. An empty table gives no rows. ``carry`` names columns to keep, whatever they hold;
    ``names`` renames the operator's own, should they clash.
    """
    model = model or fit(docs, key=key, text=text, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, score = shared.value.predict(features(batch.column(0)))
            ok = batch.column(1).to_numpy(zero_copy_only=False)
            names = [n if k else UNKNOWN for n, k in zip(names, ok, strict=True)]
            out = [batch.column(2), pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0)), batch.column(3)]
            yield pa.RecordBatch.from_arrays(out + [batch.column(0)] * with_text, ["held_out", "lang_pred", "score", "carried"] + ["text"] * with_text)

    carry = carry or [key]
    with_text = text in carry
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
                       held_out(F.col(key)).alias("held_out"), F.struct(*[F.col(c) for c in carry if c != text] or [F.lit(0).alias("_")]).alias("carried"))
    kind = rows.schema["carried"].dataType.simpleString()
    out = rows.mapInArrow(predict, f"held_out boolean, lang_pred string, score double, carried {kind}" + ", text string" * with_text)
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"carried.`{c}`") for c in carry], *[F.col(c).alias(n) for c, n in zip(("held_out", "lang_pred", "score"), names, strict=True)])
