"""Quality rules, tokenizer alignment and the conversation trie against brute force."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from gridledger.llm import alignment, prefix_trie, quality, queries
from pyspark.sql import functions as F

from compare import DATA


def _sentences(rng, words, n):
    return ". ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4, 12))).capitalize() for _ in range(n)) + "."


def test_quality_rules(spark, awkward):
    rng = random.Random(9)
    tongues = {k: (common.split() * 6 + [common[i:i + 5].replace(" ", "") or "x" for i in range(0, len(common), 3)])
               for k, common in (("en", "the of and to a in is that it for was on with"), ("de", "der die und in den von zu das mit sich für größe"))}
    texts = [(100 + i, _sentences(rng, tongues[k], 20), k) for i, k in enumerate(["en", "de"] * 40)]
    bad = [(200, "$$$ ".join(_sentences(rng, tongues["en"], 20).split()), "en"), (201, _sentences(rng, tongues["en"], 30).upper().replace(" ", "!! "), "en"),
           (202, " | ".join(f"Item{rng.randrange(10**6)}x" for _ in range(90)), "de"), (203, "same line of text here\n" * 30, "en"),
           (204, _sentences(rng, tongues["en"], 20), None), (205, _sentences(rng, tongues["de"], 20), "en"), (206, "Ünï ①½ 世界 ʰ " * 3, "de")]
    df, rows = awkward
    whole = df.select("doc_id", "text", "lang", "label", "n", "kept").union(
        spark.createDataFrame(texts + bad, "doc_id long, text string, lang string").select("*", *[F.lit(None).cast("string")] * 3)).repartition(5)
    mine = [(r["doc_id"], r["text"], r["lang"]) for r in whole.collect()]
    got = [tuple(r) for r in quality.judge_quality(whole).collect()]
    assert Counter(g[:8] for g in got) == Counter(brute.quality(mine))
    alone = spark.createDataFrame(texts + bad, "doc_id long, text string, lang string")
    by_id = {g[0]: tuple(g) for g in quality.judge_quality(alone).collect()}
    assert all(by_id[i][7] for i, _, _ in texts) and by_id[204][7] and by_id[205][7]  # labels of the row itself decide nothing
    assert not any(by_id[i][7] for i in (200, 201, 202, 203))
    assert by_id[205][8] == "de"
    unlabelled = whole.withColumn("lang", F.lit(None).cast("string"))
    assert all(r["kept"] == (not r["base_failed"]) and r["nearest"] is None for r in quality.judge_quality(unlabelled).collect())
    assert quality.judge_quality(whole.limit(0)).count() == 0


def test_quality_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = queries.QUERIES["op11_quality_rules"](spark, f"{DATA}/sf0.001").collect()
    assert Counter(map(tuple, got)) == Counter(brute.quality(rows))
    assert sum(r["kept"] for r in got) > 0.8 * len(got)


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment._byte_letters()
    return (lambda t: a.encode(t, add_special_tokens=False).ids, lambda t: b.encode(t), lambda i: bytes(letters[c] for c in a.id_to_token(i)),
            lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())


STRANGE = [" ", "  ", "a ", "a  b \n c", "▁x y", "it's <|endoftext|> ok <s>", "é\xa0 b", "x　 y", "a\tb\nc ", "\n  b  c", "世界 你好 \U0001f600 end  z", "<0x41> b",
           "aaaa aaaaaa", "\x00 a\x1c b\x85 c", "x" * 3000 + " y", " a", "tab \t x", "  a  b", "é ﬁ ﻿ z", "don't WON'T 'll 1234567 a1b2"]


@pytest.mark.parametrize("limits", [(150_000, 16 << 20, True), (40, 300, True), (150_000, 16 << 20, False)])
def test_alignment(spark, awkward, tokenizers, monkeypatch, limits):
    aligner = alignment.Aligner

    class Small(aligner):
        def __init__(self, *args):
            alignment._CACHE_PIECES, alignment._CACHE_BYTES = limits[:2]
            super().__init__(*args)
            self.by_piece &= limits[2]

    df, _ = awkward
    some = df.filter("doc_id IS NULL OR doc_id <> 38").select("doc_id", "text", "score", "n").union(
        spark.createDataFrame([(1000 + i, t, None, None) for i, t in enumerate(STRANGE)], "doc_id long, text string, score string, n string")).repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        worker = Small(f.read(), g.read())
    assert worker.by_piece == limits[2]
    want = brute.alignment(rows, *tokenizers)
    seen = {}
    for at in range(0, len(rows), 7):  # the worker alone, with caches that overflow, or on whole texts
        import pyarrow as pa
        (n_a, n_b, n_groups), shown, alike, other = worker.align(pa.array([t for _, t in rows[at:at + 7]], pa.string()))
        links = np.bincount(alike[0], minlength=len(n_a)) + np.bincount(other[0], minlength=len(n_a))
        for i in range(len(n_a)):
            seen[at + i] = (int(n_a[i]), int(n_b[i]), int(n_groups[i]), int(links[i]))
    assert [seen[i] for i in range(len(rows))] == [w[1:5] for w in want]
    if limits[0] > 40 and limits[2]:
        assert Counter(map(tuple, alignment.align_tokenizers(some).collect())) == Counter(want)
        assert alignment.align_tokenizers(some.limit(0)).count() == 0


def test_alignment_query_against_brute_force(spark, tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = queries.QUERIES["op12_tokenizer_alignment"](spark, f"{DATA}/sf0.001").collect()
    assert Counter(map(tuple, got)) == Counter(brute.alignment(rows, *tokenizers))


TURNS = "conv_id long, turn long, role string, text string"


def test_prefix_trie(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([t, t, t, None]), rng.choice(["u", "a", None]), rng.choice(["x y", "x", None, "z  z\tz"]))
            for c in [*range(120), -5, -20, 400, 401, 2**62] for t in range(rng.choice([1, 2, 3, 5, 9]))]
    rows += [(7, 1, "u", "same")] * 3 + [(None, 1, "u", "x")] * 2 + [(c, i, "u", f"deep {i % 3}") for c, n in ((61, 400), (66, 390)) for i in range(n)]
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("x")).withColumn("block", F.lit(None).cast("int")).withColumn("p1", F.lit(1)).repartition(6)
    want = brute.trie(rows)
    for size in (23, 250_000):
        assert sorted(map(tuple, prefix_trie.build_prefix_trie(df, shard_nodes=size).collect())) == want
    assert prefix_trie.build_prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.build_prefix_trie(df.filter("conv_id IS NULL")).count() == 0
    lone = [(3, 0, "u", "x")] + [(5, 0, "u", "x")]  # both lose all their turns or keep one
    assert sorted(map(tuple, prefix_trie.build_prefix_trie(spark.createDataFrame(lone, TURNS)).collect())) == brute.trie(lone)


def test_prefix_trie_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(c, t, "u", "copy") for c in range(1, 600) for t in range(4)] + [(c, 0, "u", f"own {c}") for c in range(600, 700)]
    got = prefix_trie.build_prefix_trie(spark.createDataFrame(rows, TURNS).repartition(7), shard_nodes=5)
    assert sorted(map(tuple, got.collect())) == brute.trie(rows)


def test_parentheses_against_a_stack():
    rng = random.Random(1)
    for n in (1, 2, 63, 64, 65, 500):
        depth = [rng.randrange(3)]
        while len(depth) < n:
            depth.append(rng.randrange(max(0, depth[-1] - 3), depth[-1] + 2))
        tree = prefix_trie.Parentheses(np.array(depth), np.ones(n, np.int64))
        close = tree.findclose(tree.open_at)
        for i in range(n):
            end = next((j for j in range(i + 1, n) if depth[j] <= depth[i]), n)
            inside = depth[i:end] + ([depth[end]] if end < n else [])
            leaves = sum(inside[j + 1] <= inside[j] for j in range(len(inside) - 1))
            got = tree.between(tree.open_at[i:i + 1], close[i:i + 1])
            assert (int(got[0][0]), int(got[1][0])) == (leaves, end - i)
            assert (close[i] < len(tree.excess.values)) == (end < n)
