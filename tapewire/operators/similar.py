"""Similar articles of every article at once.

Articles with the same key phrases and category ask the same question, so it is asked once.  Articles
and their postings are dealt to shards of bounded size; every question goes through every shard, where
postings lie in arrays, and only its best few articles there leave it (see `similar_shards`).  No pair
of articles is moved or written otherwise; what grows with the number of pairs is arithmetic in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewire.fixed_values import SIMILAR_BOOSTS
from tapewire.operators import similar_shards as shards
from tapewire.operators.search import B, K1, SAME_CATEGORY_SCORE, TextIndex, tokens
from tapewire.operators.search_spec import check_range
from tapewire.sources.sinks import stored

#: Postings of a shard, about, of which a task takes some 110 bytes each at its peak; and, while cores are idle, at least.
SHARD_POSTINGS, LEAST_POSTINGS = 2_500_000, 500_000
FIELDS = list(SIMILAR_BOOSTS)


def _weights(index: TextIndex, asked: DataFrame) -> tuple[DataFrame, list[float | None], int]:
    """``asked`` with ``weights``, what one occurrence adds at most by field; the mean lengths of the
    fields; and the number of postings.  One row a field goes through the driver."""
    boost = F
    for field, value in SIMILAR_BOOSTS.items():
        boost = boost.when(F.col("field") == field, F.lit(float(value)))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    vocabulary = index.vocabulary.where(F.col("field").isin(FIELDS))
    # field_stats has one row per text field, at most six.
    terms = vocabulary.join(F.broadcast(index.field_stats), "field").withColumn("weight", boost * idf * (K1 + 1))
    terms = terms.groupBy("term").agg(F.array(*[F.max(F.when(F.col("field") == f, F.col("weight"))) for f in FIELDS]).alias("weights"))
    means = {r["field"]: r["avg_dl"] for r in index.field_stats.select("field", "avg_dl").collect()}
    count = vocabulary.agg(F.sum("df")).first()[0] or 0
    return asked.join(terms, "term"), [means.get(f) for f in FIELDS], count


def _keys(spark: SparkSession, n: int) -> list[int]:
    """Numbers of ``n`` shards that a hash partitioning into ``n`` deals to one task each."""
    placed = spark.range(40 * n + 200).select(F.col("id").cast("int").alias("id"))
    placed = placed.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("to")).agg(F.min("id").alias("id"))
    first = {r["to"]: r["id"] for r in placed.collect()}
    rest = iter(set(range(-1, -n - 1, -1)))
    return [first[i] if i in first else next(rest) for i in range(n)]


def _named(asked: DataFrame, groups: DataFrame, postings: DataFrame, articles: DataFrame, asking: tuple) -> DataFrame:
    """``gid, number, score, publishedAt``: of each question the best articles of each shard.

    ``asking``: how many of them, the mean lengths of the fields and the numbers of the shards.
    """
    most, means, keys = asking
    of = lambda c: F.element_at(F.array(*map(F.lit, keys)), (F.pmod(F.xxhash64(c), F.lit(len(keys))) + 1).cast("int"))
    lists = asked.groupBy("gid").agg(*[F.collect_list(F.struct("term", "times", "weights")).alias("asked")])
    field = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FIELDS) for x in (f, i)]), F.col("field"))
    kinds = {
        shards.ARTICLE: articles.select(of("doc_id").alias("shard"), F.col("doc_id").alias("id"), "number", F.col("category").alias("name"), F.col("publishedAt").alias("at")),
        shards.POSTING: postings.where(F.col("field").isin(FIELDS)).select(of("doc_id").alias("shard"), F.col("doc_id").alias("id"), F.col("term").alias("name"), field.alias("field"), "tf", "dl"),
        shards.QUESTION: groups.join(lists, "gid", "left").select(
            F.explode(F.array(*map(F.lit, keys))).alias("shard"), F.col("gid").alias("number"), F.col("category").alias("name"),
            F.col("asked.term").alias("terms"), F.col("asked.times").alias("times"), F.col("asked.weights").alias("weights"),
        ),
    }
    union = None
    for kind, rows in kinds.items():
        columns = [(F.lit(kind) if c == "kind" else F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.strip().split(" ", 1) for x in shards.ROWS.split(","))]
        union = rows.select(*columns) if union is None else union.unionByName(rows.select(*columns))
    make = partial(shards.Shard, means, K1, B, most, SAME_CATEGORY_SCORE)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shards.ask(batches, make)

    return union.repartition(len(keys), "shard").sortWithinPartitions("shard", "kind").mapInArrow(ask, shards.FOUND)


def similar_to_all(df: DataFrame, index: TextIndex, n: int = 5) -> DataFrame:
    """``doc_id, rank, similar_id, score``: for each article the ``n`` most like it.

    Results and scores are those of `search.similar_articles`: the best field's BM25 score of the key
    phrases plus one for the same category, ties to the newer one, then the smaller id; articles that
    share neither are never found.  ``doc_id`` must be unique: of rows that share one the postings add up,
    as in a search.
    """
    check_range(n, 1, 20, "limit")
    spark = df.sparkSession
    words = F.sort_array(F.coalesce(tokens(F.col("key_phrases")), F.array().cast("array<string>")))
    category = F.coalesce(F.concat(F.lit("="), F.col("category")), F.lit(""))
    members = df.select("doc_id", "category", "publishedAt", words.alias("words"), F.sha2(F.concat(category, F.lit(" "), F.array_join(words, " ")), 256).alias("question"))
    members = stored(members, "similar_members")
    # Numbers in the order of ids take the place of the ids, and of the questions' hashes.
    ids = members.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy("doc_id")
    ids = stored(ids.withColumn("number", F.monotonically_increasing_id()), "similar_ids")
    articles = members.select("doc_id", "category", "publishedAt").join(ids, "doc_id")
    groups = members.groupBy("question").agg(F.first("category", True).alias("category"), F.first("words").alias("words"))
    groups = stored(groups.withColumn("gid", F.monotonically_increasing_id()), "similar_groups")
    asked = groups.select("gid", F.explode("words").alias("term")).groupBy("gid", "term").agg(F.count(F.lit(1)).alias("times"))
    asked, means, postings = _weights(index, asked)
    asked = stored(asked, "similar_terms")

    idle = min(spark.sparkContext.defaultParallelism, postings // LEAST_POSTINGS)
    keys = _keys(spark, max(1, idle, -(-postings // SHARD_POSTINGS)))
    named = _named(asked, groups.select("gid", "category"), index.postings, articles, (n + 1, means, keys))
    rank = [F.desc("score"), F.desc_nulls_last("publishedAt"), F.asc("number")]
    # Of a question no more than n + 1 rows a shard.
    found = named.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(*rank))).where(F.col("rank") <= n + 1)
    found = found.join(ids, "number").select("gid", "rank", "doc_id", "score")

    # One more than wanted, as an article may have found itself; a list of n + 1 per question.
    listed = found.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("found"))
    listed = listed.join(groups.select("gid", "question"), "gid")
    others = F.slice(F.filter("found", lambda x: x["doc_id"] != F.col("doc_id")), 1, n)
    out = members.select("doc_id", "question").join(listed, "question").select("doc_id", F.posexplode(others).alias("at", "hit"))
    return out.select("doc_id", (F.col("at") + 1).alias("rank"), F.col("hit.doc_id").alias("similar_id"), F.col("hit.score").alias("score"))
