import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tapewire.fixed_values import SEARCH_BOOSTS, SIMILAR_BOOSTS
from tapewire.operators import filters, search
from tapewire.operators.search_spec import SearchSpec, check_symbol

VOCABULARY = ["oil", "oils", "price", "prices", "pricey", "market", "rally", "élan", "élans", "ab", "abc", "fed"]


def corpus(n=60, seed=5):
    rng = random.Random(seed)

    def words(low, high):
        return " ".join(rng.choices(VOCABULARY, k=rng.randint(low, high)))

    return [
        dict(
            doc_id=f"d{i:03d}", title=words(0, 4), description=words(0, 8), content=words(0, 40).replace(" ", ", "),
            key_phrases=", ".join(words(1, 2) for _ in range(2)), summary=None if i % 5 == 0 else words(1, 6),
            source=rng.choice(["wire", "oil"]), category=rng.choice("ABC"), publishedAt=rng.choice([1000 * i, None]),
            symbol=rng.choice(["", "S1"]), entity_name=rng.choice([None, "E"]), sentiment=rng.uniform(-1, 1),
            risk_adj=0.1, confidence=0.5, conf_norm=0.5, impact_assessment="NEUTRAL", risk_level="low_risk",
        )
        for i in range(n)
    ]


SCHEMA = """doc_id string, title string, description string, content string, key_phrases string, summary string, source string,
    category string, publishedAt bigint, symbol string, entity_name string, sentiment double, risk_adj double, confidence double,
    conf_norm double, impact_assessment string, risk_level string"""


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def articles(spark, docs):
    return spark.createDataFrame([tuple(r.values()) for r in docs], SCHEMA).repartition(5).cache()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def bm25(docs, query, boosts, fuzzy):
    best = defaultdict(float)
    for field, boost in boosts.items():
        if field == "source":
            bags = {d["doc_id"]: [d["source"]] for d in docs}
            wanted = Counter([query.strip()])
        else:
            bags = {d["doc_id"]: tokens(d[field]) for d in docs}
            wanted = Counter(tokens(query))
        bags = {k: b for k, b in bags.items() if b}
        if not bags:
            continue
        mean = sum(map(len, bags.values())) / len(bags)
        df = Counter(w for b in bags.values() for w in set(b))
        weights = defaultdict(float)
        for q, times in wanted.items():
            k = 0 if not fuzzy or len(q) <= 2 else 1 if len(q) <= 5 else 2
            for w in df:
                e = edits(q, w)
                if e <= k:
                    weights[w] += times * (1 - e / min(len(q), len(w)))
        for doc, bag in bags.items():
            score = 0.0
            for w, weight in weights.items():
                tf = bag.count(w)
                if tf:
                    idf = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
                    score += weight * idf * boost * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))
            if score:
                best[doc] = max(best[doc], score)
    return best


@pytest.mark.parametrize("query", ["oil", "oil price", "pricee élan", "ab fed fed", "nothinglike", "", "OIL-rally"])
@pytest.mark.parametrize("fuzzy", [True, False])
def test_bm25_equals_brute_force(articles, docs, query, fuzzy):
    got = dict(search.bm25(search.build_index(articles), query, SEARCH_BOOSTS, fuzzy).collect())
    want = bm25(docs, query, SEARCH_BOOSTS, fuzzy)
    if fuzzy and query:  # keyword fields compare the whole query
        assert set(want) == set(got)
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}


def test_saved_index(spark, articles, tmp_path):
    path = str(tmp_path / "index")
    index = search.build_index(articles)
    search.write_index(index, path, buckets=16)
    saved = search.read_index(spark, path)
    assert saved.buckets == 16
    result = search.bm25(saved, "pricey rally")
    assert dict(result.collect()) == dict(search.bm25(index, "pricey rally").collect())
    exact = dict(search.bm25(saved, "rally market", fuzzy=False).collect())
    assert exact == dict(search.bm25(index, "rally market", fuzzy=False).collect())
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_search_page_and_totals(articles, docs):
    params = {"q": "oil price", "sentiment": "positive", "sortBy": "relevant", "limit": 7}
    scores = bm25(docs, "oil price", SEARCH_BOOSTS, True)
    want = []
    for d in docs:
        if d["doc_id"] in scores and d["sentiment"] > 0:
            score = round(scores[d["doc_id"]], 6) + (2.0 if d["symbol"] else 0) + (1.5 if d["entity_name"] else 0)
            want.append((-score, -(d["publishedAt"] if d["publishedAt"] is not None else -1), d["doc_id"]))
    want.sort()
    index = search.build_index(articles)
    for page in (1, 2):
        spec = SearchSpec.from_params({**params, "page": page})
        rows, totals = search.search(articles, index, spec)
        assert [r["doc_id"] for r in rows.collect()] == [w[2] for w in want[7 * (page - 1): 7 * page]]
        t = totals.first()
        assert (t["total"], t["total_pages"], t["page"]) == (len(want), -(-len(want) // 7), page)


def test_similar_articles(articles, docs):
    index = search.build_index(articles, ("key_phrases", "title", "description"), ())
    for me in (docs[3], docs[10]):
        text = bm25(docs, me["key_phrases"].replace(",", " "), SIMILAR_BOOSTS, False)
        want = []
        for d in docs:
            score = round(text.get(d["doc_id"], 0), 6) + (d["category"] == me["category"])
            if d is not me and score > 0:
                want.append((-score, -(d["publishedAt"] if d["publishedAt"] is not None else -1), d["doc_id"]))
        got = search.similar_articles(articles, index, me["doc_id"], 5).select("doc_id", "score").collect()
        assert {r["doc_id"] for r in got} == {w[2] for w in sorted(want)[:5]}
    assert search.similar_articles(articles, index, "nobody", 5).count() == 0
    with pytest.raises(ValueError):
        search.similar_articles(articles, index, "d001", 21)


def test_highlight(spark):
    body = "x " * 100 + "The AI, theory the-ai. ai" + " y" * 100
    df = spark.createDataFrame([("1", "the AI theory", body, None), ("2", "none", "none", "none")], "doc_id string, title string, content string, key_phrases string")
    rows = search.highlight(df, ["ai", "the"], ("title", "key_phrases")).orderBy("doc_id").collect()
    assert rows[0]["hl_title"] == "<em>the</em> <em>AI</em> theory"
    assert rows[0]["hl_key_phrases"] is None and rows[1]["hl_title"] is None and rows[1]["hl_content"] is None
    shown = rows[0]["hl_content"]
    assert "<em>The</em> <em>AI</em>, theory <em>the</em>-<em>ai</em>. <em>ai</em>" in shown
    assert len(shown.replace("<em>", "").replace("</em>", "")) == 150


def test_spec_reads_all_accepted_names():
    spec = SearchSpec.from_params({
        "search": " oil ", "sentiment": "all", "category": "", "source": "wire", "riskLevel": "low_risk", "riskScoreMin": "0.2",
        "confidence": "[10, 90]", "dateStart": "2024-01-02", "dateEnd": "2024-01-03", "sortBy": "oldest", "page": "2", "limit": "5",
        "impact_assessment": "BULLISH", "ticker": "S1",
    })
    assert (spec.q, spec.sentiment, spec.category, spec.source, spec.impact, spec.symbol) == ("oil", None, None, "wire", "BULLISH", "S1")
    assert spec.risk_score == (0.2, 1.0) and spec.confidence == (10.0, 90.0)
    assert (spec.start_ms, spec.end_ms) == (1704153600000, 1704240000000)
    assert (spec.sort_column, spec.ascending, spec.offset) == ("publishedAt", True, 5)
    inclusive = SearchSpec.from_params({"end_date": "2024-01-03"}, end_inclusive_day=True)
    assert inclusive.end_ms == 1704240000000 + 86_399_999
    assert SearchSpec.from_params({"sort_by": "risk"}).sort_column == "risk_adj"
    assert SearchSpec.from_params({"sort_by": "whatever"}).sort_column == "publishedAt"
    assert SearchSpec.from_params({"page_size": 30}).page_size == 30


@pytest.mark.parametrize("bad", [
    {"q": "x" * 501}, {"sentiment": "happy"}, {"page": 1001}, {"limit": 101}, {"riskScore": "[0.5, 0.2]"},
    {"riskScore": [0, 2]}, {"confidence": "[-1, 50]"}, {"dateStart": "yesterday"},
])
def test_spec_refuses(bad):
    with pytest.raises(ValueError):
        SearchSpec.from_params(bad)


def test_filters(articles, docs):
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    of = lambda test: {d["doc_id"] for d in docs if test(d)}
    assert ids(filters.where_sentiment(articles, "positive")) == of(lambda d: d["sentiment"] > 0)
    assert ids(filters.where_sentiment(articles, "neutral", "client")) == of(lambda d: abs(d["sentiment"]) <= 0.1)
    assert ids(filters.where_category(articles, "b")) == of(lambda d: d["category"] == "B")
    assert ids(filters.where_published(articles, 5000, 20000)) == of(lambda d: d["publishedAt"] is not None and 5000 <= d["publishedAt"] <= 20000)
    assert ids(filters.where_contains(articles, "OIL, ")) == of(lambda d: "oil, " in f"{d['title']} {d['key_phrases']} {d['content']}".lower())
    assert ids(filters.where_has_ticker(articles)) == of(lambda d: d["symbol"] and d["entity_name"])
    assert ids(filters.where_symbol(articles, " s1")) == of(lambda d: d["symbol"] == "S1")
    assert filters.get_article(articles, "nobody").count() == 0
    with pytest.raises(ValueError):
        check_symbol(" ")


def test_filters_reach_the_scan(spark, articles, tmp_path):
    path = str(tmp_path / "scored")
    articles.write.parquet(path)
    spec = SearchSpec.from_params({"sentiment": "positive", "category": "a", "dateStart": "2024-01-01"})
    plan = filters.apply_filters(spark.read.parquet(path), spec).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    for part in ("GreaterThan(sentiment", "EqualTo(category", "GreaterThanOrEqual(publish"):
        assert part in pushed
    assert "content" not in plan.split("ReadSchema")[1]


def test_paging_keeps_a_bounded_top(articles):
    spec = SearchSpec.from_params({"page": 3, "limit": 4})
    top = search.page(search.ranked_hits(articles, None, spec), spec)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    assert F is not None and top.count() == 4


def test_a_page_shows_what_it_hit(spark):
    """Misspelt words and a source as a whole are marked; a column without a hit is null."""
    kind = "doc_id string, publishedAt bigint, sentiment double, risk_adj double, confidence double, symbol string, entity_name string, title string, description string, content string, key_phrases string, summary string, source string"
    rows = [("a", 2, 0.1, 0.0, 0.5, "", None, "a license", "plain", "x " * 200 + "the licence", None, "", "wire"), ("b", 1, 0.1, 0.0, 0.5, "", None, "other", "word", "", "licensed", "", "licens")]
    df = spark.createDataFrame(rows, kind)
    found, _ = search.search(df, search.build_index(df), SearchSpec(q="licens"), highlights=True)
    got = {r["doc_id"]: r for r in found.collect()}
    assert got["a"]["hl_title"] == "a <em>license</em>" and got["a"]["hl_description"] is None and got["a"]["hl_source"] is None
    assert got["a"]["hl_content"].endswith("the <em>licence</em>") and len(got["a"]["hl_content"]) < 170
    assert got["b"]["hl_key_phrases"] == "<em>licensed</em>" and got["b"]["hl_source"] == "<em>licens</em>"


def test_tokens_are_counted_without_moving_them(spark):
    kind = "doc_id string, title string, content string"
    rows = [("a", "one two one", "x y"), ("a", "two three", None), ("b", "four four", ""), (None, "five", "z z"), (None, "five six", None)]
    df = spark.createDataFrame(rows, kind)
    counts = search.token_counts(df, ("title", "content"))
    got = {(r["doc_id"], r["field"]): (r["tokens"], r["terms"]) for r in counts.collect()}
    assert got == {("a", "title"): (5, 3), ("a", "content"): (2, 2), ("b", "title"): (2, 1), (None, "title"): (3, 2), (None, "content"): (2, 1)}
    plan = search.tokenize(df, ("title",), distinct="n").groupBy("doc_id").agg({"n": "sum"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_saved_index_shuffles_no_postings(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(f"d{i}", f"word{i} and more", "src") for i in range(9)], "doc_id string, title string, source string")
    seen, parquet = [], type(df.write).parquet
    monkeypatch.setattr(type(df.write), "parquet", lambda self, path, *a, **k: (seen.append((path, self._df)), parquet(self, path, *a, **k))[1])
    search.write_index(search.build_index(df, ("title",)), str(tmp_path / "index"), buckets=4)
    (postings,) = [d for path, d in seen if path.endswith("/postings")]
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Rebalance" not in plan and "Sort" not in plan


def test_postings_of_a_saved_index_stay_where_they_are(spark, tmp_path):
    """The vocabulary is too large for a broadcast, the wanted terms are not: no posting is shuffled."""
    rows = [(f"d{i:04}", " ".join(f"word{i * 5 + k}" for k in range(5)) + " the", "", "", "", "", "src") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id string, title string, description string, content string, key_phrases string, summary string, source string")
    search.write_index(search.build_index(df), str(tmp_path / "index"), buckets=4)
    index = search.read_index(spark, str(tmp_path / "index"))
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "8k")
    try:
        hits = index.hits(search._weights(index, "the word7", search.SEARCH_BOOSTS, False))
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert hits.count() == 801
    finally:
        spark.conf.set(key, before)
