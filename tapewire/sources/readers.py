"""Scans: landed files, the archive, message streams, dictionaries and tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tapewire.fixed_values import DEFAULT_RISK_WORDS
from tapewire.functions.identity import first_or_null
from tapewire.functions.text import strip
from tapewire.schemas import MESSAGE, METRIC_EVENT, PAYLOAD, RAW_RESPONSE, SCORED

CORRUPT = "_malformed"


def read_raw_articles(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Articles of landed response objects, one object per file or per line.

    A body that is not JSON, or has no ``data``, yields no rows.
    """
    responses = spark.read.schema(RAW_RESPONSE).json(path, multiLine=not one_per_line)
    return responses.select(F.inline("data"))


def where_requested(df: DataFrame, **wanted: str) -> DataFrame:
    """Filters the vendor applies on its side, for example ``language="en"``."""
    for column, value in wanted.items():
        df = df.where(F.col(column) == value)
    return df


def read_archive(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """Archived payloads of all files below ``path``; bad lines and lines without an id are
    skipped.  Empty when there is no archive yet.  ``without`` leaves out one subfolder.
    """
    reader = spark.read.schema(PAYLOAD).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true")
    try:
        lines = reader.json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PAYLOAD)
    if without:
        lines = lines.where(~F.contains(F.col("_metadata.file_path"), F.lit(f"/{without}/")))
    return lines.where(F.col("doc_id").isNotNull())


def stream_articles(spark: SparkSession, source: str, location: str, **options: str) -> DataFrame:
    """Stream with a text column ``value``.

    ``source="kafka"`` subscribes to the topic ``location`` (pass
    ``kafka.bootstrap.servers`` in ``options``), from the latest offsets;
    ``source="files"`` follows a directory of JSON lines, for tests and replays.
    """
    if source == "kafka":
        settings = {"startingOffsets": "latest", "failOnDataLoss": "false", **options}
        stream = spark.readStream.format("kafka").option("subscribe", location).options(**settings).load()
        return stream.select(F.col("value").cast("string").alias("value"))
    if source == "files":
        return spark.readStream.options(**options).text(location)
    raise ValueError(f"unknown source {source!r}")


def _decoded(value: Column) -> Column:
    schema = StructType([*MESSAGE.fields, StructField(CORRUPT, StringType())])
    return F.from_json(value.cast("string"), schema, {"columnNameOfCorruptRecord": CORRUPT})


def decode_articles(df: DataFrame, value_col: str = "value", on_malformed: str = "default") -> DataFrame:
    """JSON messages to the 18 fields plus first symbol and first entity name.

    A malformed value becomes a row of nulls.  With ``on_malformed="quarantine"`` such
    rows are left out here and come from `malformed`.
    """
    if on_malformed not in ("default", "quarantine"):
        raise ValueError("on_malformed is 'default' or 'quarantine'")
    data = df.select(_decoded(F.col(value_col)).alias("data"))
    if on_malformed == "quarantine":
        data = data.where(F.col(f"data.{CORRUPT}").isNull())
    blank = F.col(f"data.{CORRUPT}").isNotNull()
    fields = [F.when(~blank, F.col(f"data.{f.name}")).alias(f.name) for f in MESSAGE.fields]
    return data.select(*fields).withColumns(
        {"symbol": first_or_null(F.col("symbols")), "entity_name": first_or_null(F.col("entity_names"))}
    )


def malformed(df: DataFrame, value_col: str = "value") -> DataFrame:
    """The values `decode_articles` cannot read."""
    return df.where(_decoded(F.col(value_col))[CORRUPT].isNotNull())


def read_keywords(spark: SparkSession, path: str, default: list[str] | None = None) -> list[str]:
    """Word list of a text file: trimmed, lower-cased, without blank and ``#`` lines.

    Where there is no file the default list counts; any other error is raised, as other words
    would silently change every level.  The list becomes a pattern, so it is brought to the
    driver; a list too large for that belongs into a dictionary table.
    """
    word = F.lower(strip(F.col("value")))
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return list(default or DEFAULT_RISK_WORDS)
    words = lines.select(word.alias("w")).where((F.col("w") != "") & ~F.col("w").startswith("#")).distinct()
    return sorted(r["w"] for r in words.collect())


def read_category_commands(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary from lines ``SADD category_keywords_A word "two words"``."""
    key = F.regexp_extract("value", r"^\s*SADD\s+category_keywords_(\w+)\s", 1)
    rest = F.regexp_replace("value", r"^\s*SADD\s+\S+\s+", "")
    words = F.regexp_extract_all(rest, F.lit(r'"[^"]*"|\S+'), F.lit(0))
    return (
        spark.read.text(path)
        .select(key.alias("category"), F.explode(words).alias("keyword"))
        .select("category", F.btrim("keyword", F.lit('"')).alias("keyword"))
        .where((F.col("category") != "") & (F.col("keyword") != ""))
        .distinct()
    )


def read_category_json(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """Dictionary from objects ``{letter: [keyword, ...]}``, one per line or one per file."""
    table = F.from_json("value", "map<string,array<string>>")
    return (
        spark.read.text(path, wholetext=not one_per_line)
        .select(F.explode(table).alias("key", "keywords"))
        .select(
            F.regexp_replace("key", "^category_keywords_", "").alias("category"),
            F.explode("keywords").alias("keyword"),
        )
        .distinct()
    )


def read_scored(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Scored articles; the scan reads only the columns that are used."""
    df = spark.read.schema(SCORED).parquet(path)
    return df.select(*columns) if columns else df


def read_metric_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Request events, with the time also as epoch milliseconds."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(METRIC_EVENT).parquet(path).withColumn("ts_ms", F.unix_millis("ts"))
