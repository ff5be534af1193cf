"""One query per operator over whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.llm import (
    embedding_dedup, exact_dedup, license_scan, near_dedup, packing, prefix_trie, sentence_pieces, source_divergence, suffix_dedup, token_counts, topk_search,
    toxicity, warc,
)
from tapewire.llm.common import documents
from tapewire.sources.sinks import work_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Held out: rows whose remainder of crc32 over the id as text is 0.
TRAIN_ROWS = "pmod(crc32(cast(cast({id} as string) as binary)), 5) <> 0"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, work_dir(spark, "digest_index"))
    return exact_dedup.deduplicate(documents(spark, sf_dir), index)


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=2, window=4096)


def _sql_urn(x: str) -> str:
    h = f"md5({x})"
    return f"'<urn:uuid:' || " + " || '-' || ".join(f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _sql_unescaped(x: str) -> str:
    code = "CASE WHEN regexp_matches(p, '^[xX][0-9a-fA-F]{1,6};') THEN CAST('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]+);', 1) AS BIGINT) WHEN regexp_matches(p, '^[0-9]{1,7};') THEN CAST(regexp_extract(p, '^([0-9]+);', 1) AS BIGINT) END"
    valid = f"coalesce(({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111, false)"
    letter = f"CASE WHEN {valid} THEN chr(CAST({code} AS INTEGER)) || regexp_replace(p, '^[xX]?[0-9a-fA-F]+;', '') ELSE '&#' || p END"
    out = f"(SELECT l[1] || array_to_string(list_transform(l[2:], lambda p: {letter}), '') FROM (SELECT string_split({x}, '&#') AS l))"
    for name, value in warc.ENTITIES.items():
        out = f"replace({out}, '&{name};', {_sql_text(value)})"
    return f"replace({out}, '&amp;', '&')"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_without_tags(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in warc.SILENT:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)</?({warc.LINES})\\b[^>]*>', chr(10), 'g')"
    return f"regexp_replace({out}, '</?[a-zA-Z!][^>]*>', '', 'g')"


_SQL_WARC = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html,
    regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title\s*>', 1) AS raw,
    regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1) AS hrefs FROM pages),
q AS (SELECT *, 'sha256:' || sha256(html) AS payload_digest,
    {_sql_urn("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || target_uri || '|' || md5(html)")} AS refers_to,
    {_sql_without_tags('html')} AS bare, regexp_replace(raw, '</?[a-zA-Z!][^>]*>', '', 'g') AS head FROM p),
u AS (SELECT *, {_sql_unescaped('bare')} AS opened, trim(regexp_replace({_sql_unescaped('head')}, '\s+', ' ', 'g')) AS title,
    list_transform(hrefs, lambda h: replace(h, '&amp;', '&')) AS targets,
    {_sql_urn("'conversion|' || refers_to")} AS converted, {_sql_urn("'metadata|' || refers_to")} AS described FROM q),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(opened, '[ \t\x0B\f\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS body,
    chr(13) || chr(10) AS nl FROM u),
r AS (SELECT page_id, 'conversion' AS record_type, converted AS record_id, refers_to, target_uri, 'text/plain; charset=UTF-8' AS content_type,
    payload_digest, body AS block FROM t
  UNION ALL SELECT page_id, 'metadata', described, refers_to, target_uri, 'application/warc-fields', payload_digest,
    'http-status: 200' || nl || 'http-content-type: text/html; charset=UTF-8' || nl || 'http-content-length: ' || strlen(html) || nl
    || 'source-payload-digest: ' || payload_digest || nl || 'title: ' || title || nl || 'conversion: ' || converted || nl
    || array_to_string(list_transform(list_filter(targets, lambda x, i: list_position(targets, x) = i), lambda x: 'outlink: ' || x || nl), '') FROM t)
SELECT *, '2024-01-01T00:00:00Z' AS date, 'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length FROM r
"""


@query(_SQL_WARC)
def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.derivatives(found.withColumnRenamed("source_id", "page_id"), keep=("page_id",))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.top_k(vectors.where("vec_id % 20 = 0"), vectors, k=20, scale=64)


@query()
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), length=50, seed=16).drop("spans")


@query()
def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), with_ids=False)


@query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).withColumn("n_spans", F.size("spans")).drop("spans")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, rows=TRAIN_ROWS)
    scored = toxicity.score(spark, docs, model)
    return scored.select(
        "doc_id", (~F.expr(TRAIN_ROWS.format(id="doc_id"))).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), width=2, percent=80)


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query(r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS total
      FROM d LEFT JOIN v USING (lang) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
        CAST(1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS BIGINT) AS p
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS BIGINT) AS q
      FROM p JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
            WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50
""")
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir), least=30, top=50)


@query("""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS id, vec_id, CASE WHEN vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings),
l AS (SELECT id, vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM w WHERE v IS NOT NULL),
e AS (SELECT a.id, a.vec_id AS u, b.vec_id AS t FROM l a JOIN l b ON a.id <> b.id AND len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r AS (SELECT DISTINCT vec_id AS u, vec_id AS t FROM w UNION SELECT r.u, e.t FROM r JOIN e ON r.t = e.u),
c AS (SELECT u, min(t) AS component_id FROM r GROUP BY u)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.id = w.id) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM w LEFT JOIN c ON c.u = w.vec_id
""")
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


_SQL_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
    lambda s, d: list_reduce([xor(s, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384)), 4294967295))"""


@query(rf"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {_SQL_CRC.format(x='conv_id')} % 4 AS h FROM o),
b AS (SELECT h.conv_id, coalesce((SELECT list(t ORDER BY pos) FROM o WHERE o.conv_id = h.base AND pos <= h.h), [])
    || coalesce((SELECT list(t ORDER BY pos) FROM o WHERE o.conv_id = h.conv_id AND pos > h.h), []) AS seq FROM h),
m AS (SELECT conv_id, unnest(range(len(seq) + 1)) AS depth, seq FROM b),
n AS (SELECT depth, seq[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, list(conv_id ORDER BY conv_id) FILTER (len(seq) = depth) AS ends
      FROM m GROUP BY ALL),
k AS (SELECT *, CASE WHEN depth > 0 THEN len(regexp_extract_all(p[depth].text, '[^ 	-
]+')) ELSE 0 END * (n_convs - 1) AS saves,
      (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND c.p[1:n.depth] = n.p) AS n_children,
      (SELECT u.conv_id FROM n u WHERE u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]) AS parent_conv_id FROM n)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children,
    (SELECT count(*) FROM k d WHERE d.depth >= k.depth AND d.n_children = 0 AND d.p[1:k.depth] = k.p) AS n_leaves,
    (SELECT CAST(sum(saves) AS BIGINT) FROM k d WHERE d.depth >= k.depth AND d.p[1:k.depth] = k.p) AS saved_tokens,
    sha256(coalesce(array_to_string(ends, ','), '')) AS ends_sha256 FROM k
""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), share=20, most=3)
