import itertools
import math

import pytest
from pyspark.sql import functions as F

from tapewire.functions import bands, scoring
from tapewire.plans.scoring import add_scores, score_articles
from tapewire.schemas import MESSAGE, SCORED
from tapewire.sources import decode_articles, to_messages

# Sentiment, raw confidence and what they have to give, for titles without any listed word.
GOLDEN = [
    (0.7, 319.8039, 2.069716, "low_risk", 0.121394, "BULLISH", 4.246403),
    (0.299717, 55.7562, 0.639289, "low_risk", 0.092786, "SLIGHTLY POSITIVE", 0.283573),
    (0.398469, 69.8668, 0.764404, "low_risk", 0.095288, "SLIGHTLY POSITIVE", 0.358642),
    (-0.268823, 24.4893, 0.316022, "moderate_risk", 0.604243, "MODERATE RISK", -0.952817),
    (0.377524, 36.6279, 0.450252, "low_risk", 0.089005, "SLIGHTLY POSITIVE", 0.170151),
    (0.0, 9.3676, 0.129185, "low_risk", 0.082584, "NEUTRAL", -0.087082),
    (0.7, 25.5884, 0.328704, "low_risk", 0.086574, "BULLISH", 0.590278),
    (0.352383, 18.1742, 0.240915, "low_risk", 0.084818, "NEUTRAL", -0.075908),
    (0.0, 28.6727, 0.363706, "low_risk", 0.087274, "NEUTRAL", -0.063629),
    (-0.6249, 77.2079, 0.825443, "moderate_risk", 0.675562, "MODERATE RISK", -1.360354),
    (0.7906, 12.0216, 0.163776, "low_risk", 0.083276, "NEUTRAL", -0.083622),
]


def article(**fields):
    return tuple(fields.get(f.name) for f in MESSAGE.fields)


def articles(spark, rows):
    df = spark.createDataFrame([article(**r) for r in rows], MESSAGE)
    return df.withColumns({"symbol": F.get("symbols", F.lit(0)), "entity_name": F.get("entity_names", F.lit(0))})


def test_golden_rows(spark):
    rows = [dict(title=f"t{i}", content="plain", sentiment=g[0], confidence=g[1], doc_id=str(i)) for i, g in enumerate(GOLDEN)]
    got = {r["title"]: r for r in score_articles(articles(spark, rows)).collect()}
    for i, (_, _, norm, level, adjusted, impact, final) in enumerate(GOLDEN):
        r = got[f"t{i}"]
        assert (r["risk_level"], r["impact_assessment"]) == (level, impact)
        for value, want in ((r["conf_norm"], norm), (r["risk_adj"], adjusted), (r["final_score"], final)):
            assert value == pytest.approx(want, abs=5e-6)


def test_output_columns_and_defaults(spark):
    out = score_articles(articles(spark, [{}]))
    assert out.columns == SCORED.names
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in SCORED.fields]
    r = out.first()
    assert (r["title"], r["content"], r["symbol"], r["content_quality"]) == ("", "", "", "unknown")
    assert r["entity_name"] is None and r["source"] is None and r["publishedAt"] is None
    assert (r["sentiment"], r["confidence"], r["risk_level"], r["impact_assessment"]) == (0.0, 0.0, "low_risk", "NEUTRAL")


@pytest.mark.parametrize(
    "raw, norm",
    [(None, 0.0), (0.0, 0.0), (-3.0, 0.0), (1.0, 1.0), (1.01, math.log2(1.0101)), (100.0, 1.0), (319.8, math.log2(4.198))],
)
def test_confidence(column, raw, norm):
    assert column(lambda x: scoring.conf_norm(scoring.rescale_confidence(x)), [raw], "double")[0] == pytest.approx(norm)


def test_impact_boundaries(column):
    steps = [
        (0.7, "BULLISH"), (0.6999, "POSITIVE"), (0.4, "POSITIVE"), (0.3999, "SLIGHTLY POSITIVE"), (0.1, "SLIGHTLY POSITIVE"),
        (0.0999, "NEUTRAL"), (0.0, "NEUTRAL"), (-0.0999, "NEUTRAL"), (-0.1, "SLIGHTLY NEGATIVE"), (-0.4, "NEGATIVE"),
        (-0.3999, "SLIGHTLY NEGATIVE"), (-0.6999, "NEGATIVE"), (-0.7, "BEARISH"),
    ]
    got = column(lambda x: scoring.impact_from_sentiment(x, F.lit(0.2)), [s for s, _ in steps], "double")
    assert got == [want for _, want in steps]
    assert set(column(lambda x: scoring.impact_from_sentiment(x, F.lit(0.1999)), [s for s, _ in steps], "double")) == {"NEUTRAL"}


def test_risk_level_order(spark):
    texts = {"none": "quiet", "risk": "a Lawsuit", "commodity": "smelters", "deal": "M&A news", "both": "merger and crash"}
    rows = [
        dict(title=f"{name} {s}", content=text, sentiment=s, confidence=50.0)
        for (name, text), s in itertools.product(texts.items(), (-0.1, 0.0, 0.2, 0.21))
    ]
    got = {r["title"]: r["risk_level"] for r in score_articles(articles(spark, rows)).collect()}
    for name in texts:
        low = "moderate_risk" if name in ("none", "deal") else "high_risk"
        high = "medium_risk" if name in ("deal", "both") else "low_risk"
        assert [got[f"{name} {s}"] for s in (-0.1, 0.0, 0.2, 0.21)] == [low, "low_risk", "low_risk", high], name


def test_negative_sentiment_always_ends_as_risk(spark):
    rows = [dict(title=f"{s} {c}", content="fraud" if c > 50 else "", sentiment=s / 10, confidence=float(c))
            for s in range(-10, 11) for c in (0, 10, 60, 130)]
    for r in add_scores(articles(spark, rows)).collect():
        assert (r["sentiment"] < 0) == (r["impact_assessment"] in ("HIGH RISK", "MODERATE RISK"))
        assert 0.8 * r["risk_raw"] - 1e-12 <= r["risk_adj"]
        if r["conf_norm"] <= 1:
            assert r["risk_adj"] <= r["risk_raw"] + 1e-12


def test_document_examples(spark):
    df = spark.createDataFrame([(0.9, 0.2, 0.756), (0.9, 0.5, 0.81), (0.9, 0.9, 0.882)], "b double, n double, want double")
    for r in df.select(scoring.risk_adjusted(F.col("b"), F.col("n")).alias("got"), "want").collect():
        assert r["got"] == pytest.approx(r["want"])
    df = spark.createDataFrame([(2.0, 0.9, 0.1, 1.79), (-1.0, 0.3, 0.7, -0.79), (-3.0, 0.95, 0.9, -2.895)], "i double, n double, r double, want double")
    for r in df.select(scoring.final_score(F.col("i"), F.col("n"), F.col("r")).alias("got"), "want").collect():
        assert r["got"] == pytest.approx(r["want"])


def test_scores_survive_a_round_trip_as_messages(spark):
    rows = [dict(title="a", content="x", sentiment=0.5, confidence=70.0, symbols=["S1", "S2"], entity_names=["E"], publishedAt="2024-01-01 00:00:00")]
    df = articles(spark, rows)
    again = decode_articles(to_messages(df.drop("symbol", "entity_name")))
    assert score_articles(again).collect() == score_articles(df).collect()


def test_bands(column):
    assert column(bands.impact_group, ["bullish", "HIGH_RISK", "Medium Risk", "SPECULATIVE", "BEARISH", None, "?"]) == [
        "positive", "high risk", "medium risk", "speculative", "negative", "neutral", "neutral"]
    assert column(bands.risk_display, ["high_risk", "medium_risk", "zzz", None]) == ["HIGH RISK", "MEDIUM RISK", "LOW RISK", "LOW RISK"]
    assert column(bands.risk_band, [0.329, 0.33, 0.67], "double") == ["low_risk", "medium_risk", "high_risk"]
    assert column(bands.category_name, ["A", "K", None]) == ["Earnings", "General News", "General News"]
    assert column(lambda x: bands.category_name(x, True), [None, ""]) == ["General Business & Industry News"] * 2
    assert column(bands.trend_band, [0.51, 0.5, -0.51, None], "double") == ["up", "flat", "down", None]


def test_filter_on_a_score_does_not_copy_the_text_scan(spark):
    rows = [dict(title="a", content="crash", sentiment=-0.5, confidence=70.0)]
    df = score_articles(articles(spark, rows).repartition(2)).where(F.col("final_score") < 0).where("risk_level = 'high_risk'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bankruptcy") <= 4 and plan.lower().count("rlike") <= 6
    assert df.count() == 1


def test_filters_stand_below_the_word_scan(spark, tmp_path):
    from tapewire.operators.search_spec import SearchSpec
    from tapewire.plans.scoring import score_where

    rows = [dict(title=str(i), content="crash" * (i % 2), sentiment=(i - 20) / 20, source=f"src{i % 4}", category="D", publishedAt="2024-01-01 00:00:00") for i in range(40)]
    articles(spark, rows).write.parquet(str(tmp_path / "messages"))
    messages = spark.read.parquet(str(tmp_path / "messages"))
    spec = SearchSpec(sentiment="positive", category="d", source="src3", risk_level="low_risk", start_ms=0, end_ms=2 * 10**12)
    got = score_where(messages, spec)
    want = [r for r in score_articles(messages).collect() if r["sentiment"] > 0 and r["source"] == "src3" and r["risk_level"] == "low_risk"]
    assert sorted(got.collect()) == sorted(want) and want
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    words = min(i for i, line in enumerate(plan) if "RLIKE" in line)
    for condition in ("sentiment", "category", "source", "publishedAt"):
        assert max(i for i, line in enumerate(plan) if "Filter" in line and condition in line) > words
    pushed = plan[-1] if "PushedFilters" in plan[-1] else next(line for line in plan if "PushedFilters" in line)
    assert "EqualTo(source,src3)" in pushed
