"""Registered queries of these operators over whole tables, and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# words of a text, A-Z lower-cased, and the shingles of a list of words
WORDS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
SHINGLES = ("CASE WHEN len({0}) = 0 THEN [] WHEN len({0}) < 5 THEN [array_to_string({0}, ' ')] "
            "ELSE list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i+4], ' '))) END")


@query("op3_packing")
def _packing(spark, sf_dir):
    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op5_topk", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def _topk(spark, sf_dir):
    from .topk import top_k
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op6_token_files")
def _token_files(spark, sf_dir):
    from .token_files import token_file_digest
    return token_file_digest(table(spark, sf_dir, "documents"))


@query("op7_decontamination", f"""
    WITH d AS (SELECT doc_id, {SHINGLES.format('w')} AS s FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)),
    b AS (SELECT item_id, {SHINGLES.format('w')} AS s FROM (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark)),
    ds AS (SELECT DISTINCT doc_id, unnest(s) AS g FROM d), bs AS (SELECT DISTINCT item_id, len(s) AS n_item, unnest(s) AS g FROM b)
    SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item FROM ds JOIN bs USING (g)
    GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)""")
def _decontamination(spark, sf_dir):
    from .decontamination import find_contained
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op8_url_rules", """
    WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    f AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f""")
def _url_rules(spark, sf_dir):
    from .url_rules import judge_urls, rule_table
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


@query("op1_ngram_join", f"""
    WITH RECURSIVE d AS (SELECT doc_id, {SHINGLES.format('w')} AS s FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)),
    n AS (SELECT doc_id, len(s) AS n FROM d), g AS (SELECT doc_id, unnest(s) AS g FROM d),
    e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
          JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL""")
def _ngram_join(spark, sf_dir):
    from .jaccard import jaccard_join
    return jaccard_join(table(spark, sf_dir, "documents")).drop("set_id")


@query("op9_substring_dedup", """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
    h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM p),
    r AS (SELECT doc_id, list(i) AS s FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1 GROUP BY doc_id),
    c AS (SELECT doc_id, list_distinct(flatten(list_transform(s, lambda i: range(i, i + 35)))) AS gone FROM r),
    k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS g, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
    u AS (SELECT k.doc_id, i, w[i] AS x FROM k, unnest(range(1, n + 1)) AS t(i) WHERE NOT list_contains(gone, i)),
    t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM u GROUP BY doc_id)
    SELECT k.doc_id, n::BIGINT AS n_words, g::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN t ON t.doc_id = k.doc_id""")
def _substring_dedup(spark, sf_dir):
    from .substrings import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_language_id")
def _language_id(spark, sf_dir):
    from .language import identify_language
    return identify_language(table(spark, sf_dir, "documents"))


@query("op10_chat_format")
def _chat_format(spark, sf_dir):
    from .chat import format_conversations
    return format_conversations(table(spark, sf_dir, "conversations"))


@query("op2_html_text")
def _html_text(spark, sf_dir):
    from .wrappers import extract_articles
    return extract_articles(table(spark, sf_dir, "pages"))


def _shape(chars: str) -> str:
    """SQL for how many characters of t a class holds."""
    return f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"


# distance terms of shares p and q, in bits
APART = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"


@query("op11_quality_rules", f"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, eight) AS n
          FROM (SELECT doc_id, unnest(range(len(w) - 7)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i:i+7], ' ')))) AS eight FROM d)),
    r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, range(8) AS t(j) WHERE n > 1 GROUP BY doc_id),
    l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    b AS (SELECT l.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_shape('#*$%&|<>')} AS n_symbols,
                 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM l LEFT JOIN r ON r.doc_id = l.doc_id),
    k AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, length(t) AS n_all, {_shape('\\p{Lu}\\p{Lt}')} AS c1, {_shape('\\p{Ll}')} AS c2,
                 {_shape('\\p{Lo}\\p{Lm}\\p{M}')} AS c3, {_shape('\\p{N}')} AS c4, length(t) - word_chars AS c5, n_symbols AS c6,
                 {_shape('\\p{P}')} - {_shape('#*%&')} AS c7 FROM b),
    c AS MATERIALIZED (SELECT doc_id, unnest([c1, c2, c3, c4, c5, c6, c7, n_all - c1 - c2 - c3 - c4 - c5 - c6 - c7]) AS n, unnest(range(8)) AS class FROM k),
    good AS MATERIALIZED (SELECT doc_id, lang, n_words, n_all FROM k WHERE NOT base_failed AND lang IS NOT NULL),
    n_docs AS (SELECT lang, count(*) AS n FROM good GROUP BY lang),
    cs AS (SELECT lang, class, sum(1000000 * n // n_all)::DOUBLE AS s FROM good JOIN c USING (doc_id) GROUP BY ALL),
    cr AS MATERIALIZED (SELECT lang, class, s / sum(s) OVER (PARTITION BY lang) AS q FROM cs),
    wc AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM
           (SELECT doc_id, list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM d)) GROUP BY ALL),
    ws AS (SELECT lang, word, sum(1000000 * n // n_words)::DOUBLE AS s FROM good JOIN wc USING (doc_id) GROUP BY ALL),
    wr AS MATERIALIZED (SELECT lang, word, s / (1000000 * n) AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s DESC, word) AS rank FROM ws) JOIN n_docs USING (lang) WHERE rank <= 50),
    cd AS (SELECT doc_id, lang, sqrt(sum({APART.format('p', 'q')} + {APART.format('q', 'p')}) / 2) AS c
           FROM (SELECT doc_id, cr.lang, n / greatest(1, n_all) AS p, q FROM k JOIN c USING (doc_id) JOIN cr USING (class)) GROUP BY ALL),
    wp AS (SELECT x.doc_id, x.lang, coalesce(wc.n, 0) / greatest(1, n_words) AS p, q
           FROM (SELECT doc_id, n_words, wr.lang, wr.word, wr.q FROM k, wr WHERE NOT base_failed) x LEFT JOIN wc ON wc.doc_id = x.doc_id AND wc.word = x.word),
    wd AS (SELECT doc_id, lang, sqrt((s + {APART.format('rest_p', 'rest_q')} + {APART.format('rest_q', 'rest_p')}) / 2) AS v
           FROM (SELECT doc_id, lang, sum({APART.format('p', 'q')} + {APART.format('q', 'p')}) AS s, greatest(0, 1 - sum(p)) AS rest_p, greatest(0, 1 - sum(q)) AS rest_q FROM wp GROUP BY ALL)),
    fit AS (SELECT DISTINCT cd.doc_id FROM k JOIN cd USING (doc_id) JOIN wd ON wd.doc_id = cd.doc_id AND wd.lang = cd.lang WHERE (c <= 0.28 OR word_chars < 250) AND (v <= 0.46 OR n_words < 60))
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
           n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND (doc_id IN (FROM fit) OR NOT EXISTS (FROM n_docs)) AS kept FROM k""")
def _quality_rules(spark, sf_dir):
    from .quality import judge_quality
    return judge_quality(table(spark, sf_dir, "documents")).drop("nearest", "class_distance", "word_distance")


@query("op12_tokenizer_alignment")
def _tokenizer_alignment(spark, sf_dir):
    from .alignment import align_tokenizers
    return align_tokenizers(table(spark, sf_dir, "documents"))


# crc32 of a decimal text, bit by bit
CRC32 = ("xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({0}, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), "
         "lambda a, b: CASE WHEN xor(a, b) % 2 = 1 THEN xor(xor(a, b) // 2, 3988292384) ELSE xor(a, b) // 2 END))")


@query("op13_prefix_trie", f"""
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
                      md5(coalesce(role, '')) || md5(coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {CRC32.format('conv_id::VARCHAR')} % 4 AS h, conv_id - conv_id % 20 AS head FROM (SELECT DISTINCT conv_id FROM t)),
    k AS (SELECT c.conv_id, any_value(h) AS h, count(t.i) AS k FROM c LEFT JOIN t ON t.conv_id = c.head AND t.i <= c.h GROUP BY c.conv_id),
    f AS (SELECT c.conv_id, t.i AS depth, t.x, t.words FROM c JOIN t ON t.conv_id = c.head AND t.i <= c.h
          UNION ALL SELECT t.conv_id, k + t.i - h, t.x, t.words FROM t JOIN k ON k.conv_id = t.conv_id AND t.i > h),
    p AS (SELECT conv_id, depth, words, md5(string_agg(x, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM f
          UNION ALL SELECT conv_id, 0, 0, '' FROM c),
    n AS (SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY node),
    a AS (SELECT n.node, up.node AS above, up.depth AS above_depth FROM n JOIN p AS up ON up.conv_id = n.conv_id AND up.depth <= n.depth),
    u AS (SELECT n.node, m.conv_id AS parent_conv_id, m.node AS parent FROM n JOIN a ON a.node = n.node AND a.above_depth = n.depth - 1 JOIN n AS m ON m.node = a.above),
    b AS (SELECT parent AS node, count(*) AS n_children FROM u GROUP BY parent),
    s AS (SELECT above AS node, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (b.node IS NULL) AS n_leaves
          FROM a JOIN n ON n.node = a.node LEFT JOIN b ON b.node = a.node GROUP BY above),
    e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM p GROUP BY conv_id) GROUP BY node)
    SELECT n.conv_id, n.depth::BIGINT AS depth, u.parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
           s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM n LEFT JOIN u ON u.node = n.node LEFT JOIN b ON b.node = n.node JOIN s ON s.node = n.node LEFT JOIN e ON e.node = n.node""")
def _prefix_trie(spark, sf_dir):
    from .prefix_trie import build_prefix_trie
    return build_prefix_trie(table(spark, sf_dir, "conversations"))
