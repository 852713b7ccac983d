"""Pages, urls, vectors, conversations and the pipeline, on awkward rows and on empty tables."""

import math
import random
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pytest
from gridledger.llm import chat, queries, topk, tokens, url_rules, wrappers
from pyspark.sql import functions as F

from compare import DATA, check


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, key):
    ok, note = check(spark, key, queries.QUERIES[key], queries.ORACLES[key], f"{DATA}/sf0.001")
    assert ok, note


def _judge(url, rules, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].translate(brute.LOWER), rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)] if "://" in url else []
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x/y", "block"), ("a.example.net", "/", "block"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "", "block"), ("b.example.net", "/en/x/", "allow")]
    urls = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.NET/en/x/y/z?q", "https://example.net/en/x/z", "https://x.b.example.net/en/x/y",
            "http://notexample.net/en/", "http://net/", "http://net", "http://x.net?y=/en/", "ftp://u.org/fr/#/de/", "http://org/fr", "http://example.com/de/a://b",
            "http://example.com./de/", "http://ÉXAMPLE.net/en/", "http://a..net/é", "http://example.net/en/x/y\U0010ffff", "http://example.net/en/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(3, "http://net/", "x", "y")] * 3 + [(None, "http://net/", None, None)],
                               "page_id long, url string, key string, copies string")
    for table in (rules, [*rules, (None, "/", "block"), ("com", None, "block"), ("com", "/", None)]):
        got = url_rules.judge_urls(df, url_rules.rule_table(spark, table), salts=3).collect()
        want = Counter((r["page_id"], *_judge(r["url"], rules)) for r in df.collect())
        assert Counter(map(tuple, got)) == want
    assert {r["verdict"] for r in url_rules.judge_urls(df, url_rules.rule_table(spark, rules).limit(0), default="block").collect()} == {"block"}
    assert url_rules.judge_urls(df.limit(0), url_rules.rule_table(spark, rules)).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 7)
    monkeypatch.setattr(topk, "TILE_ROWS", 2)
    rows = [(i, [float((i * 7 + j * 3) % 5) / 3 - 1 for j in range(4)]) for i in range(0, 400, 5)]
    rows += [(700 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(15)] + [(900, [1e9, -1e9, 3.0, 1e300])]
    bad = [(1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0]), (1003, [math.nan] * 4), (1004, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>").withColumn("ids", F.lit(1)).withColumn("query_id", F.lit(2)).repartition(4)
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:10], 1)}
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, groups=3)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_sends_no_matrices_through_the_driver(spark):
    """A tile repeats for each group of shards, and the estimate of its size does not tell."""
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.col("id") * i % 13 / 5.0).alias("embedding"))
    found = topk.top_k(df, F.col("vec_id") % 100 == 0, groups=40)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_lists_of_shards_merge_per_deal(spark, monkeypatch):
    """One list of each query leaves a deal, whatever number of shards it holds; both sides are dealt in groups."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 5)
    monkeypatch.setattr(topk, "TILE_ROWS", 3)
    rng = random.Random(3)
    rows = [(rng.randrange(-60, 60), [float(rng.randrange(-2, 3)) for _ in range(3)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    best = {}
    for q, a in rows:
        for c, b in rows:
            if q % 2 == 0 and c != q:
                s = 1024 * 1024 * int(sum(x * y for x, y in zip(a, b, strict=True)))
                best[q, c] = max(s, best.get((q, c), s))
    want = {(q, n, c, s) for q in {q for q, _ in best} for n, (s, c) in enumerate(sorted(((s, c) for (p, c), s in best.items() if p == q), key=lambda x: (-x[0], x[1]))[:4], 1)}
    for deals in ((1, 1), (2, 3), (7, 2)):
        monkeypatch.setattr(topk, "_deals", lambda *_, d=deals: d)
        assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 2 == 0, k=4).collect()} == want
    assert topk._merged([(np.array([0, 0, 1]), np.array([5, 6, 5]), np.array([1, 9, -2**63])), (np.array([0, 0]), np.array([5, 4]), np.array([9, 9]))], 2)[1].tolist() == [4, 5, 5]


def test_deals_send_about_as_much_of_both_sides():
    d = topk._deals
    assert d(600, 600_000, 6000) == (245, 2) and d(200, 1000, 1000) == (14, 14) and d(8, 0, 0) == (3, 2)
    assert d(8, 10**8, 10**6)[0] == -(-10**8 // (32 * topk.SHARD_ROWS))


PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class='page'><nav><a href=1>Menu</a></nav><div class=\"cookie-notice\">We use cookies"
        "</div><aside>Side</aside><article><h1>Title {0}</h1><p>First <b>bo</b>ld&nbsp;{0} &amp;amp; x<br>line<p>Second\n  &lt;p&gt; {0}</p><script>var a='</p>'</script>"
        "<form><label>Mail</label></form><div class=\"ad-box\">Buy</div></article><section id=comments><p>Reader says</p></section><footer>&copy; F</footer></body></html>")


def test_html_extraction(spark):
    rows = [(i, f"http://h{i % 2}.x/{i}", PAGE.format(i)) for i in range(8)]
    rows += [(20, None, None), (21, "http://h0.x/", ""), (22, "x", "<p>only <i>this</i>"), (23, "http://z/", "<"), (24, "http://h0.x/", "<a href='" + "x" * 200_000), (None, "http://h1.x/", PAGE.format("n"))]
    rows += [rows[0]] * 2
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, host int, text int").repartition(3)
    got = wrappers.extract_articles(df).collect()
    want = {i: f"Title {i} First bold {i} &amp; x line Second <p> {i}" for i in range(8)}
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(texts[i] == want[i] for i in want)
    assert texts[20] == texts[21] == "" and texts[None] == want[0].replace("0", "n") and texts[22] == "only this"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert wrappers.extract_articles(df.limit(0)).count() == 0


def test_wrappers_without_an_article_element_take_the_densest(spark):
    page = "<body><div class=menu><a>one</a><a>two</a></div><div><ul><li><a>link {0}</a><li><a>link</a></ul></div><div id=c><h2>Head {0}</h2><p>Much text of the page {0}.</p><p>And more of it {0}</p><div>This site is best</div></div></body>"
    df = spark.createDataFrame([(i, "http://q/", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in wrappers.extract_articles(df).collect()}
    assert texts[5] == "Head 5 Much text of the page 5. And more of it 5"


def test_templates_of_one_host_keep_their_text(spark):
    long = "Plain text of a page without an article, number {0}, and it goes on and on."
    pages = ["<body><nav>menu</nav><article><p>Article {0}</p></article></body>", f"<body><nav>menu</nav><main><p>Main {long}</p></main></body>",
             f"<body><div><p>{long}</p><p>More {{0}}</p></div></body>", f"<body><table><tr><td>{long}</td></tr></table></body>"]
    rows = [(k + 10 * i, "http://blogs/", p.format(i)) for i in range(6) for k, p in enumerate(pages)]
    rows += [(100, None, pages[0].format(1)), (101, "a/b", pages[2].format(2)), (102, "c", pages[3].format(3))]
    texts = {r["page_id"]: r["text"] for r in wrappers.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {}
    for i in range(6):
        own = long.format(i)
        want |= {10 * i: f"Article {i}", 10 * i + 1: f"Main {own}", 10 * i + 2: f"{own} More {i}", 10 * i + 3: own}
    assert texts == want | {100: "Article 1", 101: f"{long.format(2)} More 2", 102: long.format(3)}


@pytest.mark.parametrize("page, text", [
    ("<body><header><input list=q><datalist id=q><option value=a><option value=b></datalist></header><article><p>All {0}</p></article>", "All {0}"),
    ("<body><header><svg><path d='M0'></header><article><p>All {0}</p></article>", "All {0}"),
    ("<body><svg viewBox='0 0'><path d='M0'/><article><p>All {0}</p></article>", "All {0}"),
    ("<body><select><option>one<option>two<article><p>All {0}</p></article>", "All {0}"),
    ("<body><div><video src=a></div><canvas><article><p>All {0}</p></article>", "All {0}"),
    ("<body><article><p>So <math><mi>x</mi><mo>=</mo><mn>{0}</mn><annotation encoding='tex'>\\x</annotation></math> holds</p></article>", "So x={0} holds"),
    ("<body><article><p title=it's>One {0}</p><p>isn't</p><p>three</p></article>", "One {0} isn't three"),
    ("<body><article><p>a <a href=/x?q='>b</a> it's {0}</p><p title='>' id = \"'>\">c</p></article>", "a b it's {0} c"),
    ("<body><article><p>a {0}</p><select><option>no<option>never</select><svg><title>t</title><text>no</text></svg><object>no</object><noscript>no</noscript><p>b</p></article>", "a {0} b")])
def test_unclosed_and_embedded_elements_lose_no_text(spark, page, text):
    for i in (1, 2):
        blocks = list(wrappers.segments(page.format(i)))
        keep = set(wrappers.article_paths(wrappers.Wrapper.of(blocks)))
        assert " ".join(b[1] for b in blocks if "\n".join(b[0]) in keep) == text.format(i)


@pytest.mark.parametrize("n", [2, 9, 10])
def test_constants_beside_the_text(spark, n):
    """Unlabelled menus go and constant subheadings stay, however many pages there are."""
    menu = "<body><div>Home About Contact</div><div>The text of page {0} is told here at length.</div><div>Copyright of us</div></body>"
    food = "<body><article><h1>Dish {0}</h1><div>Our notice</div><h2>Ingredients</h2><p>Salt</p><p>Item {0} of many</p></article></body>"
    rows = [(i, "http://menu/", menu.format(i)) for i in range(n)] + [(100 + i, "http://food/", food.format(i)) for i in range(n)]
    texts = {r["page_id"]: r["text"] for r in wrappers.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts == {i: f"The text of page {i} is told here at length." for i in range(n)} | {100 + i: f"Dish {i} Ingredients Salt Item {i} of many" for i in range(n)}


def test_alignment_gives_optional_and_repeated_groups():
    one, two = ("<div><h1>a</h1><p>b</p></div>", "<div><h1>c</h1><p>b</p><ul><li>x<li>y</ul><p>d</p></div>")
    w = wrappers.Wrapper.of(list(wrappers.segments(one))).align(wrappers.Wrapper.of(list(wrappers.segments(two))))
    assert w.expression() == "<div><h1>#</h1>(<p>#</p>(<ul>(<li>#</li>)+</ul>)?)+</div>"
    assert wrappers.Wrapper.unpack(w.pack()).expression() == w.expression()


def test_pages_of_the_tables_give_their_article(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    for r in wrappers.extract_articles(pages).join(pages.select("page_id", "html"), "page_id").collect():
        import html
        import re
        body = re.search("<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert r["text"] == " ".join(b for b in blocks if b)


def test_chat(spark):
    rows = [(1, 0, None, "System: be kind\nHuman: hi?\nmore\nAssistant: hello\nUser: bye"), (2, 0, "user", "Q"), (2, 1, None, "A long answer follows"), (2, 2, "USER", None),
            (2, 2, "USER", None), (3, None, "user", "x <|user|> y"), (3, None, "bot", ""), (None, 0, "user", "hi"), (None, 0, "nobody", "ho")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int").repartition(3)
    got = chat.format_conversations(df).orderBy("conv_id", "turn", "part").collect()
    assert [(r["role"], r["content"]) for r in got if r["conv_id"] == 1] == [("system", "be kind"), ("user", "hi?\nmore"), ("assistant", "hello"), ("user", "bye")]
    two = [(r["turn"], r["role"], r["content"], r["copies"]) for r in got if r["conv_id"] == 2]
    assert two[0] == (0, "user", "Q", 1) and two[2] == (2, "user", "", 2) and len(two) == 3
    assert {r["rendered"] for r in got if r["conv_id"] == 3 and r["content"]} == {"<|user|>\nx < |user|> y\n<|end|>\n"}
    assert sum(r["conv_id"] is None for r in got) == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_hidden_roles_are_recovered_and_blocks_change_nothing(spark):
    c = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet")
    model = chat.fit(chat.turn_rows(c.filter("conv_id % 3 <> 1")))
    hidden = c.filter("conv_id % 3 = 1").withColumn("truth", F.col("role")).withColumn("role", F.when(F.col("turn") == 3, F.col("role")))
    one = chat.format_conversations(hidden, model).select("conv_id", "turn", "part", "role")
    got = one.join(hidden.select("conv_id", "turn", "truth"), ["conv_id", "turn"])
    assert got.filter("role = truth").count() >= 0.93 * got.count()
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in chat.format_conversations(hidden, model, block=2).select(*one.columns).collect()}


def _pipeline(rows, items, lost):
    """What each stage keeps of (key, text) rows."""
    rows = [(k, t) for k, t in rows if k not in lost and any(c.isalpha() for c in t or "")]
    named = brute.components(rows)
    rows = [r for r, (k, n, low) in zip(rows, named, strict=True) if k is None or k == low]
    rows = list(dict.fromkeys(r for r in rows if r[0] is not None)) + [r for r in rows if r[0] is None]
    rows = [(k, t if not gone else kept) for (k, t), (_, _, gone, kept) in zip(rows, brute.strike(rows), strict=True)]
    leaks = {k for k, _ in brute.contained(rows, items)}
    return [r for r in rows if r[0] is None or r[0] not in leaks]


def test_pipeline_stages_on_awkward_rows(spark, awkward, tmp_path):
    df, rows = awkward
    items = [(1, "one"), (2, " ".join(f"b{i}" for i in range(30)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = corpus_pipeline.identify(spark, docs, str(tmp_path))
    assert sorted(first.columns) == sorted(docs.columns)
    lost = {k for k, _ in rows if k is not None} - {r["doc_id"] for r in first.select("doc_id").collect()}
    want = _pipeline(rows, items, lost)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lib = tokens.encoder(tokens.tokenizer_json()).lib
    pieces = Counter()
    for k, t in want:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, tokens.END]
        pieces.update((k, a, brute.crc(ids[a:a + 2048])) for a in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in got) == pieces
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
