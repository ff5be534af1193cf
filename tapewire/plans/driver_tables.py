"""News tables derived from general-purpose tables.

The tables at hand (documents, labels, events, ...) hold no news, so articles, model
output and request events are derived from whole tables by integer arithmetic that
any SQL engine repeats exactly.  Everything stays a plain projection of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.fixed_values import CATEGORY_LABELS, COMMODITY_WORDS
from tapewire.functions import identity
from tapewire.operators.topn import latest_per_id
from tapewire.plans.scoring import add_scores, score_articles

START_DAY = "2024-01-01"

# Example word lists that occur in the invented prose; real ones come in as parameters.
COMMODITY_EXAMPLE = [*COMMODITY_WORDS, "license", "worthless", "queque"]
MA_EXAMPLE_EXTRA = ["stupid", "doci"]
DICTIONARY_EXAMPLE = {
    "A": ["license", "licensed under", "released under", "apache license", "version", "under the", "mit", "earnings"],
    "B": ["worthless", "stupid", "disgusting", "clown", "from the", "from", "upgrade"],
    "C": ["deal", "merger", "thor", "thorre", "the thor"],
    "D": ["nicht", "nicht die", "keit", "keiten", "ung", "regulation", "lawsuit", "probe", "court case", "policy"],
    "E": ["rate", "erat", "interest rate", "rate hike", "inflation", "central bank", "gdp", "fed", "cpi", "ppi"],
    "F": ["ceo", "leadership", "onou", "onou the", "anou"],
    "G": ["market", "trend", "that the", "that", "with the", "with", "rally", "rotation", "volatility", "sector"],
    "H": ["ipo", "listing", "queque", "que", "de que"],
    "I": ["launch", "innovation", "patent", "r&d", "inging", "ingsh"],
    "J": ["business", "company", "this is", "this", "is he"],
    "K": ["oil", "gas", "eau", "eaux", "eauaux", "les eaux", "coal", "steel", "wheat", "corn", "copper", "opec+"],
    "L": ["esg", "carbon", "climate", "une", "ment", "emente", "la une"],
    "M": ["war", "sanctions", "trade war", "hate", "haon", "treaty", "embargo", "conflict", "unrest", "coup"],
    "N": ["ai", "ai chip", "cloud", "blockchain", "hai", "ation", "5g", "robotics", "fintech", "data science"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _published(n: Column) -> Column:
    """Seven minutes apart; five readable formats and one that is not."""
    minute = n * 7
    day = F.date_add(F.lit(START_DAY).cast("date"), F.floor(minute / 1440).cast("int")).cast("string")
    time = F.concat(_two(F.floor(F.pmod(minute, F.lit(1440)) / 60)), F.lit(":"), _two(F.pmod(minute, F.lit(60))), F.lit(":00"))
    kind = F.pmod(n, F.lit(6))
    iso = F.concat(day, F.lit("T"), time)
    return (
        F.when(kind == 0, F.concat(iso, F.lit(".123456Z")))
        .when(kind == 1, F.concat(iso, F.lit("Z")))
        .when(kind == 2, F.concat(iso, F.lit("+05:00")))
        .when(kind == 3, F.concat(iso, F.lit(".123+00:00")))
        .when(kind == 4, F.concat(day, F.lit(" "), time))
        .otherwise(day)
    )


def _sentiment(n: Column) -> Column:
    return (F.pmod(n * 37, F.lit(201)) - 100).cast("double") / F.lit(100.0)


def _confidence(n: Column) -> Column:
    return F.pmod(n * 53, F.lit(131)).cast("double")


def _entity(n: Column, k: int) -> Column:
    number = F.pmod(n, F.lit(10 if k == 0 else 7)).cast("string")
    return F.struct(
        F.concat(F.lit("S"), number).alias("symbol"),
        F.concat(F.lit("Company "), number).alias("name"),
        _sentiment(n + k).alias("sentiment_score"),
        F.when(F.pmod(n, F.lit(23)) != 0, _confidence(n + k)).alias("match_score"),
    )


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed articles: ``ingest_seq`` and the vendor's fields."""
    n, count = F.col("doc_id"), F.pmod(F.col("doc_id"), F.lit(3))
    entities = F.slice(F.array(_entity(n, 0), _entity(n, 1)), F.lit(1), count.cast("int"))
    return documents(spark, sf_dir).select(
        n.alias("ingest_seq"),
        F.substring("text", 1, 80).alias("title"),
        F.substring("text", 1, 200).alias("description"),
        F.col("text").alias("snippet"),
        _published(n).alias("published_at"),
        "source",
        F.concat(F.lit("https://news.example/"), n.cast("string")).alias("url"),
        F.lit(None).cast("string").alias("image_url"),
        entities.alias("entities"),
        "lang",
    )


def messages(spark: SparkSession, sf_dir: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Decoded messages: the 18 fields with first symbol and first entity name."""
    docs = documents(spark, sf_dir) if source is None else source
    n = F.col("doc_id")
    words = F.filter(F.split(F.substring("text", 1, 200), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    letter = F.substr(F.lit("ABCDEFGHIJKLMN"), (F.pmod(n, F.lit(15)) + 1).cast("int"), F.lit(1))
    count = F.pmod(n, F.lit(3)).cast("int")
    symbols = F.array(*[F.concat(F.lit("S"), F.pmod(n, F.lit(m)).cast("string")) for m in (10, 7)])
    names = F.transform(symbols, lambda s: F.concat(F.lit("Company "), F.substring(s, 2, 9)))
    text, none = F.col("text"), F.lit(None).cast("string")
    shaped = docs.select(
        F.substring(text, 1, 80).alias("title"),
        F.substring(text, 1, 200).alias("description"),
        text.alias("content"),
        _published(n).alias("publishedAt"),
        "source",
        F.when(F.pmod(n, F.lit(19)) != 0, _sentiment(n)).alias("sentiment"),
        F.when(F.pmod(n, F.lit(23)) != 0, _confidence(n)).alias("confidence"),
        F.lit(None).cast("double").alias("risk_score"),
        F.concat(F.lit("https://news.example/"), n.cast("string")).alias("link"),
        none.alias("image_url"),
        F.array_join(F.slice(words, 1, 3), ", ").alias("key_phrases"),
        F.when(letter != "", letter).alias("category"),
        F.substring(text, 1, 60).alias("summary"),
        none.alias("impact_assessment"),
        none.alias("content_quality"),
        F.slice(symbols, F.lit(1), count).alias("symbols"),
        F.slice(names, F.lit(1), count).alias("entity_names"),
        n.cast("string").alias("doc_id"),
    )
    return shaped.withColumns(
        {
            "symbol": identity.first_or_null(F.col("symbols")),
            "entity_name": identity.first_or_null(F.col("entity_names")),
        }
    )


def word_lists() -> dict[str, list[str]]:
    from tapewire.fixed_values import MA_WORDS

    return {"commodity_words": COMMODITY_EXAMPLE, "ma_words": [*MA_WORDS, *MA_EXAMPLE_EXTRA]}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_articles(messages(spark, sf_dir), **word_lists())


def scored_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_scores(messages(spark, sf_dir), **word_lists())


def model_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ingest_seq, label, score)`` for the labelled documents."""
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "POSITIVE").otherwise("neutral")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("ingest_seq"), label.alias("label"), F.lit(0.9).alias("score")
    )


def model_sentiment_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same keyed by article id: of copies of a text the last labelled one counts."""
    ids = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ingest_seq"),
        identity.extract_doc_id(F.substring("text", 1, 80), F.col("text")).alias("doc_id"),
    )
    return latest_per_id(
        model_sentiment(spark, sf_dir).join(ids, "ingest_seq"), "doc_id", ["ingest_seq"]
    ).select("doc_id", "label", "score")


def _label_scores(n: Column) -> Column:
    labels = [F.struct(F.lit(text).alias("label"), F.lit(i).alias("i")) for i, text in enumerate(CATEGORY_LABELS.values())]
    other = F.struct(F.lit("something else").alias("label"), F.lit(14).alias("i"))
    return F.transform(
        F.array(*labels, other),
        lambda s: F.struct(
            s["label"].alias("label"),
            (F.pmod(n * (s["i"] * 2 + 3) + s["i"] * 13, F.lit(97)).cast("double") / F.lit(100.0)).alias("score"),
        ),
    )


def model_scores(spark: SparkSession, sf_dir: str, by_id: bool = False) -> DataFrame:
    """``(doc_id, label, score)``: fifteen label scores per document, one label unknown."""
    docs = table(spark, sf_dir, "documents")
    if by_id:
        ids = docs.select(
            F.col("doc_id").alias("n"),
            identity.extract_doc_id(F.substring("text", 1, 80), F.col("text")).alias("doc_id"),
        )
        docs = ids.groupBy("doc_id").agg(F.max("n").alias("n"))
    else:
        docs = docs.select(F.col("doc_id"), F.col("doc_id").alias("n"))
    return docs.select("doc_id", F.inline(_label_scores(F.col("n"))))


def metric_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``(event_id, pipeline, ts, ts_ms, latency_ms, status)``; one in ten requests fails."""
    df = table(spark, sf_dir, "events") if events is None else events
    ts = F.col("ts").cast("timestamp")
    failed = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(10)) == 0
    return df.select(
        "event_id",
        F.col("event_type").alias("pipeline"),
        ts.alias("ts"),
        F.unix_millis(ts).alias("ts_ms"),
        F.col("value").alias("latency_ms"),
        F.when(failed, 500).otherwise(200).alias("status"),
    )


PIPELINES_EXAMPLE = ["click", "error", "purchase", "signup", "view", "baseline"]


def keyword_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(existing, new)`` dictionaries: words of the benchmark and of the conversations."""

    def words(df: DataFrame, number: Column, lower: bool) -> DataFrame:
        letter = F.substr(F.lit("ABCDEFGHIJKLMN"), (F.pmod(number, F.lit(14)) + 1).cast("int"), F.lit(1))
        text = F.lower("text") if lower else F.col("text")
        return (
            df.select(letter.alias("category"), F.explode(F.split(text, r"[^\p{L}\p{N}]+")).alias("keyword"))
            .where(F.length("keyword") > 3)
            .distinct()
        )

    existing = words(table(spark, sf_dir, "benchmark"), F.col("item_id"), True)
    new = words(table(spark, sf_dir, "conversations"), F.col("conv_id"), False)
    return existing, new
