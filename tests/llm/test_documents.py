"""Operators over documents beside brute force, on awkward rows and on empty tables."""

from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridledger.llm import jaccard, language, packing, substrings, token_files, tokens
from gridledger.llm.components import connected_components
from gridledger.llm.decontamination import find_contained
from gridledger.llm.words import hash_words, shingles, text_bytes
from gridledger.session import checkpointed, fresh_folder

order = lambda rows: sorted(rows, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x0c\r\x1c\x85", max_size=40)), max_size=8))
def test_words_and_shingles_are_those_of_the_texts(texts):
    import pyarrow as pa
    words, first = hash_words(*text_bytes(pa.array(texts, pa.string())))
    plain = [brute.words(t) for t in texts]
    assert np.diff(first).tolist() == [len(p) for p in plain]
    named = {}
    for p, a, b in zip(plain, first, first[1:], strict=False):
        for w, h in zip(p, words[a:b].tolist(), strict=True):
            assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)
    s, begin = shingles(words, first)
    for t, a, b in zip(texts, begin, begin[1:], strict=False):
        assert len(set(s[a:b].tolist())) == len(brute.shingles(t))


def test_jaccard_join(awkward):
    df, rows = awkward
    got = jaccard.jaccard_join(df).select("doc_id", "n_shingles", "component_id").collect()
    assert order(map(tuple, got)) == order(brute.components(rows))


def test_fragments_answer_alike_in_any_number_of_ranges(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(2)
    rows = []
    for chunk in range(6):
        key = np.unique((rng.integers(0, 400, 500, dtype=np.uint64) << np.uint64(16)) | rng.integers(0, 20, 500, dtype=np.uint64))
        common = np.unique(rng.integers(0, 400, 9, dtype=np.uint64))
        key = key[~np.isin(key >> np.uint64(16), common)]
        rows.append({"part": 3, "chunk": chunk, "entries": key.tobytes(), "ids": rng.integers(0, 60, 20).tobytes(), "sizes": None, "common": common.tobytes(),
                     "common_counts": rng.integers(2, 9, len(common)).astype(np.uint32).tobytes()})
    rows.append({"part": 3, "chunk": 9, "entries": b"", "ids": b"", "sizes": None, "common": b"", "common_counts": b""})
    table = pa.Table.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("chunk", pa.int64())] + [(c, pa.binary()) for c in ("entries", "ids", "sizes", "common", "common_counts")]))
    sets = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], np.int64)
        for k in np.frombuffer(r["entries"], np.uint64).tolist():
            sets.setdefault(k >> 16, set()).add(int(ids[k & 0xFFFF]))
    more = Counter()
    for r in rows:
        more.update(dict(zip(np.frombuffer(r["common"], np.uint64).tolist(), np.frombuffer(r["common_counts"], np.uint32).tolist(), strict=True)))
    for entries in (1 << 20, 700, 11):
        monkeypatch.setattr(jaccard, "ANSWER_ENTRIES", entries)
        for r, a in zip(rows, jaccard._answer(table).to_pylist(), strict=True):
            want = [(k, len(sets[k >> 16]) + more[k >> 16]) for k in np.frombuffer(r["entries"], np.uint64).tolist() if len(sets[k >> 16]) + more[k >> 16] > 1]
            assert sorted(zip(np.frombuffer(a["entries"], np.uint64).tolist(), np.frombuffer(a["counts"], np.uint32).tolist(), strict=True)) == want
            assert np.frombuffer(a["common_counts"], np.uint32).tolist() == [len(sets.get(g, ())) + more[g] for g in np.frombuffer(r["common"], np.uint64).tolist()]


def test_jaccard_join_with_common_ngrams_and_other_thresholds(spark, monkeypatch):
    """Counted n-grams, several chunks and star rounds give the same components."""
    import random
    rng = random.Random(3)
    core = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(160):
        w = list(core)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(40)] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(w[:rng.randrange(25, 41)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for percent in (80, 60, 95):
        got = jaccard.jaccard_join(df, percent=percent, fragments=5).select("doc_id", "n_shingles", "component_id").collect()
        assert order(map(tuple, got)) == order(brute.components(rows, percent))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 102), (102, 104), (7, 7), (9, 9), (200, 200), (100, 102)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 102: 100, 104: 100, 200: 200}


def test_substring_dedup(awkward):
    df, rows = awkward
    got = substrings.remove_repeats(df, carry=["doc_id", "source"]).collect()
    assert order((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == order(brute.strike(rows))
    assert {r["source"] for r in got} == {None}


def test_crowded_prefixes_take_the_whole_window(awkward):
    df, rows = awkward
    got = substrings.remove_repeats(df, group_pieces=2).collect()
    assert order((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == order(brute.strike(rows))


def test_kept_layout(spark):
    df = spark.createDataFrame([(1, "a  b\nc"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in substrings.remove_repeats(df, keep_layout=True).collect()} == {1: "a  b\nc", 2: ""}


def test_decontamination(spark, awkward):
    df, rows = awkward
    items = [(1, "p3 P4 p5 p6 p7 p8 p9"), (2, "one"), (3, None), (4, ""), (None, "one"), (5, "c d"), (6, "not there at all today ever"), (1, "one"),
             (7, rows[-4][1]), (8, " ".join(f"p{i}" for i in range(10, 50)) + " other end here"), (9, " ".join(f"p{i}" for i in range(10)) + " q q2 q3 q4 q5 q6")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute.contained(rows, items)
    for block in (500_000, 3):
        got = find_contained(df, table, block_shingles=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert find_contained(df, table.limit(0)).count() == 0


def test_decontamination_recall(spark):
    """Every item of the smallest tables that brute force finds."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute.contained([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert {(r["doc_id"], r["item_id"]) for r in find_contained(docs, items).collect()} == want and want


def test_decontamination_finds_brief_items_at_any_place(spark):
    """Items of 5 to 12 words, whole or with a changed end, at every offset of a block in long documents."""
    import random
    rng = random.Random(5)
    rows, items = [], []
    for n in range(5, 13):
        for place in range(0, 320, 21):
            k = len(items)
            item = [f"i{k}w{j}" for j in range(n)]
            filler = [f"f{rng.randrange(3000)}" for _ in range(400)]
            rows.append((k, " ".join(filler[:place] + item[:n - (place % 2 and n > 8)] + filler[place:])))
            items.append((k, " ".join(item)))
    items += [(9000, "i0w0 i0w1"), (9001, "i1w3 i1w4"), (9002, "i0w1 i0w0")]
    got = find_contained(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = [(r["doc_id"], r["item_id"]) for r in got]
    assert len(found) == len(set(found)) and set(found) == brute.contained(rows, items)


def _ids(rows):
    lib = tokens.encoder(tokens.tokenizer_json()).lib
    return [(k, [*lib.encode(t or "", add_special_tokens=False).ids, tokens.END]) for k, t in rows]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAZ é'.,!<|>endoftxsşİ19\x1c\xa0\n\t ", max_size=60)), max_size=4))
def test_the_word_cache_encodes_as_the_library(texts):
    enc = tokens.encoder(tokens.tokenizer_json())
    ids, begin = enc.encode_many(texts)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [x for _, x in _ids([(0, t) for t in texts])]


def test_packing(awkward):
    df, rows = awkward
    capacity = 256
    got = packing.pack_documents(df, capacity, group_pieces=50).collect()
    assert order({(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got}) == order(
        {(k, a, len(x[a:a + capacity]), brute.crc(x[a:a + capacity]), len(x)) for k, x in _ids(rows) for a in range(0, len(x), capacity)})
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in _ids(rows))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_first_fit_decreasing_is_first_fit(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 100)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, x in enumerate(room) if x >= lengths[i]), len(room))
        if b == len(room):
            room.append(100)
        want[i] = (b, 100 - room[b])
        room[b] -= lengths[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [want[i] for i in range(len(lengths))]


def test_token_files(spark, awkward):
    df, rows = awkward
    path = fresh_folder(spark, "tokens")
    token_files.write_token_files(df, path, shard_ids=2000, partitions=3)
    got = token_files.read_token_files(spark, path).collect()
    full = _ids(rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((k, len(x), brute.crc(x)) for k, x in full)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):  # gapless, and in key order with nulls first
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys)
    asked = spark.createDataFrame([(k,) for k in (1, 4, 38, 40, 41, -5, None)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_files.look_up(asked, path).collect()}
    assert found == {k: x for k, x in full if k in (1, 4, 38, 40)}


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-2**63, 2**63 - 1), max_size=200))
def test_the_hash_index_is_minimal_and_perfect(keys):
    keys = np.array(sorted(keys), np.int64)
    ids = np.arange(2 * len(keys))
    shard = token_files.Shard(token_files.build_shard(keys, ids, np.arange(len(keys) + 1) * 2, 4))
    assert shard.find(keys).tolist() == list(range(len(keys)))
    assert len(shard.prints) == len(keys)


def test_language_id(spark, awkward):
    df, rows = awkward
    got = language.identify_language(df, carry=["doc_id", "text", "score"])
    assert got.columns == ["doc_id", "text", "score", "held_out", "lang_pred", "score"]
    got = language.identify_language(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)
    for r in got:
        text = next(t for k, t in rows if k == r["doc_id"] and (k is not None or t))  if r["doc_id"] is not None else None
        if r["doc_id"] in (1, 2, 3, 8):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif text:
            assert r["lang_pred"] in ("en", "de", "fr", "es") and 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and brute.zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(2, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.identify_language(df).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_held_out_accuracy_and_families(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    assert sorted(sorted(model.names[i] for i in g) for g in model.groups) == [["de", "en"], ["es", "fr"]]
    got = language.identify_language(docs, model, carry=["lang"]).filter("held_out")
    n, right = got.select(F.count("*"), F.sum(F.expr("int(lang = lang_pred)"))).first()
    assert right >= 0.97 * n


@pytest.mark.parametrize("run", [
    lambda d: jaccard.jaccard_join(d), lambda d: substrings.remove_repeats(d), lambda d: packing.pack_documents(d),
    lambda d: token_files.token_file_digest(d), lambda d: language.identify_language(d)])
def test_empty_tables(awkward, run):
    out = checkpointed(run(awkward[0].limit(0)))
    assert out.count() == 0 and len(out.columns) >= 3
