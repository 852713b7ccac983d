"""Token ids of whole texts with a public tokenizer, through a cache of words in each worker.

The tokenizer splits at white space before anything else, so the ids of a text are those of
its words in order; most words recur. A word of letters with plain closing marks is looked up
by its lower-case letters. Everything else goes to the library as it is, so special tokens,
contractions and marks are the library's. The property on which this rests is tested when a
tokenizer is loaded; for a tokenizer that lacks it, whole texts go to the library.
"""

from __future__ import annotations

import hashlib
import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 1
_CACHE_WORDS = 300_000
_MARKS = string.punctuation
_LOADED: dict[str, Encoder] = {}


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file, read on the driver; a vocabulary has a fixed size of a few MB."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Encodes texts to uint32 ids. One per worker process and tokenizer."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.lib = Tokenizer.from_str(spec)
        self.vocab = self.lib.get_vocab_size()
        self.ends = np.zeros(self.vocab, bool)
        self.ends[[i for t, i in self.lib.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        # the same model without what changes nothing in a word of small letters
        self.plain = Tokenizer(self.lib.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.by_word = self._split_safe()
        self._reset()

    def _split_safe(self) -> bool:
        probe = "It's  a\tprobe, of WORDS\nand x2 signs!? <|x|> é ñß 'll don't"
        whole = self._library(probe)
        letters = "probe of words and é ñß überall"
        return (bool(self.ends.any()) and whole == [i for w in probe.split() for i in self._library(w)]
                and self._library(letters) == self.plain.encode(letters, add_special_tokens=False).ids
                and self._library("WORDS, Été.") == self._library("words") + self._library(",") + self._library("été") + self._library("."))

    def _library(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.n = 0

    def _add(self, ids, counts) -> int:
        """Appends entries, ``counts`` ids each; returns the number of the first."""
        first, a = self.n, int(self.begin[self.n])
        while a + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while first + len(counts) >= len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
        self.ids[a:a + len(ids)] = ids
        self.begin[first + 1:first + 1 + len(counts)] = a + np.cumsum(counts)
        self.n += len(counts)
        return first

    def _learn_plain(self, cores: list[str]) -> None:
        """Many words in one call; each is one unit of letters, so it ends at its first word-end id."""
        for a in range(0, len(cores), 512):
            part = cores[a:a + 512]
            ids = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                each = [self._library(w) for w in part]
                ids, cuts = np.array(sum(each, []), np.uint32), np.cumsum([len(x) for x in each])
            k = self._add(ids, np.diff(cuts, prepend=0))
            self.words.update(zip(part, range(k, k + len(part)), strict=True))

    def _learn(self, words: list[str]) -> None:
        known = self.words
        whole, cores, tails, rest = [], [], [], []
        for w in words:
            core = w.rstrip(_MARKS)
            if core.isalpha() and (core.isascii() or max(core) < "İ"):
                whole.append(w)
                cores.append(core.lower())
                tails.append(w[len(core):])
            else:
                rest.append(w)
        self._learn_plain([c for c in dict.fromkeys(cores) if c not in known])
        for w in (*(t for t in dict.fromkeys(tails) if t and t not in known), *(w for w in rest if w not in known)):
            ids = self._library(w)
            known[w] = self._add(ids, [len(ids)])
        if "" not in known:
            known[""] = self._add([], [0])
        pairs = np.array([list(map(known.__getitem__, cores)), list(map(known.__getitem__, tails))], np.int64)
        new = np.array([w not in known for w in whole], bool)
        if new.any():
            ids, counts = self._gather(pairs[:, new].T.ravel())
            k = self._add(ids, counts.reshape(-1, 2).sum(axis=1))
            known.update(zip((w for w, n in zip(whole, new.tolist(), strict=True) if n), range(k, k + int(new.sum())), strict=True))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.begin[at + 1] - self.begin[at]
        to = np.concatenate(([0], np.cumsum(counts)))
        return self.ids[np.arange(to[-1]) + np.repeat(self.begin[at] - to[:-1], counts)], counts

    def encode_many(self, texts: pa.Array | list[str | None], end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and where each begins (one more than texts).

        Null is the empty text.
        """
        tail = [] if end is None else [end]
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if not self.by_word:
            each = [self._library(t) + tail for t in column.to_pylist()]
            return np.array(sum(each, []), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        if len(self.words) > _CACHE_WORDS:
            self._reset()
        parts = pc.ascii_split_whitespace(column)
        coded = parts.flatten().dictionary_encode()
        unique = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.words.get, unique))
        if None in at:
            self._learn([w for w, k in zip(unique, at, strict=True) if k is None])
            at = list(map(self.words.__getitem__, unique))
        ids, counts = self._gather(np.array(at, np.int64)[coded.indices.to_numpy()])
        words = parts.offsets.to_numpy()
        begin = np.concatenate(([0], np.cumsum(counts)))[words - words[0]]
        if end is not None:
            ids = np.insert(ids, begin[1:], end).astype(np.uint32)
            begin = begin + np.arange(len(begin))
        return ids, begin

    def encode(self, text: str | None, end: int | None = END) -> np.ndarray:
        return self.encode_many([text], end)[0]


def encoder(spec: str) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Encoder(spec)
    return _LOADED[key]
