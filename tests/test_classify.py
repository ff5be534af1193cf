import random
import re

import pytest
from pyspark.sql import functions as F

from tapewire.fixed_values import CATEGORY_LABELS, CATEGORY_LETTERS
from tapewire.functions.sentiment import fuse_sentiment
from tapewire.operators import classify, keywords, word_filter

DICTIONARY = {
    "A": ["earnings", "earnings beat", "net income", "beat the street", "eps"],
    "B": ["upgrade", "rating"],
    "C": ["deal", "m&a", "deal value"] + [f"w{i}" for i in range(30)],
    "N": ["ai", "ai chip", "chip"],
}
WORDS = ["earnings", "beat", "the", "street", "net", "income", "upgrade", "deal", "value", "said", "ai", "chip", "M&A", "EPS", "x"]


def keyword_score(text):
    scores = {}
    for c, ws in DICTIONARY.items():
        flat = "|".join(re.escape(w) for w in sorted(ws, key=lambda w: (-len(w), w)))
        found = re.findall(flat, text.lower())
        if found:
            unique = set(found)
            specific = sum(min(len(w.split()) * 0.2, 1.0) for w in unique) / len(unique)
            scores[c] = min(len(unique) / len(set(ws)) + min(specific + min(len(found) * 0.1, 0.5), 0.5), 1.0)
    return scores


def decide(text, confidence, labels):
    kw = keyword_score(text)
    if confidence is None:
        return min(kw, default="J"), None, "KEYWORD_FALLBACK"
    best = max(CATEGORY_LETTERS, key=lambda c: kw.get(c, 0))
    if kw.get(best, 0) >= 0.6:
        return best, kw[best], "REDIS_RULE_OVERRIDE"
    ml = {}
    if len(text.strip()) >= 15 and labels:
        top = sorted(labels.items(), key=lambda e: (-e[1], e[0]))[:3]
        by_text = {v: k for k, v in CATEGORY_LABELS.items()}
        for label, score in top:
            c = by_text.get(label, "J")
            ml[c] = ml.get(c, 0) + score
        total = sum(ml.values()) or 1
        ml = {c: v / total * confidence for c, v in ml.items()}
    combined = {c: 0.7 * ml.get(c, 0) + 0.3 * kw.get(c, 0) for c in CATEGORY_LETTERS}
    best = max(CATEGORY_LETTERS, key=lambda c: round(combined[c], 12))
    if combined[best] < 0.4:
        return "J", 0.3, "DEFAULT_LOW_CONFIDENCE"
    if ml.get(best, 0) > 0.6:
        return best, combined[best], "WEIGHTED_ML_DOMINANT"
    return best, combined[best], "WEIGHTED_KEYWORD_DOMINANT" if kw.get(best, 0) > 0.7 else "WEIGHTED_BALANCED"


def test_decision_equals_the_rule(spark):
    rng = random.Random(7)
    labels = [*CATEGORY_LABELS.values(), "unheard of"]
    docs, scores, want = [], [], {}
    for i in range(120):
        text = " ".join(rng.choices(WORDS, k=rng.choice([1, 3, 8, 20])))
        confidence = rng.choice([None, 0.0, 0.3, 0.8, 1.0, 45.0])
        own = {} if i % 7 == 0 else {label: rng.randint(1, 999) / 1000 for label in labels}
        docs.append((str(i), text, confidence))
        scores += [(str(i), label, s) for label, s in own.items()]
        want[str(i)] = decide(text, confidence, own)
    df = spark.createDataFrame(docs, "doc_id string, text string, confidence double")
    table = classify.model_table(spark.createDataFrame(scores, "doc_id string, label string, score double"))
    out = classify.classify(df, DICTIONARY, table).collect()
    assert len({r["method"] for r in out}) >= 4
    for r in out:
        category, confidence, method = want[r["doc_id"]]
        assert (r["category"], r["method"]) == (category, method), r
        assert r["category_confidence"] == (None if confidence is None else pytest.approx(confidence))
        assert (r["breakdown"] is None) == (method == "KEYWORD_FALLBACK")


def test_overlapping_keywords_take_the_longest(spark):
    df = spark.createDataFrame([("1", "Earnings beat the street; AI chip said"), ("2", "nothing here")], "doc_id string, text string")
    rows = {(r["doc_id"], r["category"]): r for r in keywords.keyword_stats(df, DICTIONARY, "text").collect()}
    # "earnings beat" swallows the start of "beat the street"; "ai" also sits inside "said".
    assert rows["1", "A"]["occurrences"] == 1 and rows["1", "N"]["occurrences"] == 2
    assert {k[0] for k in rows} == {"1"}


def test_keyword_score_range_and_first_category(spark):
    rng = random.Random(3)
    docs = [(str(i), " ".join(rng.choices(WORDS, k=30))) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    scores = keywords.keyword_scores(df, DICTIONARY, "text").collect()
    assert all(0 <= r["score"] <= 1 for r in scores)
    first = dict(df.select("doc_id", keywords.first_category(F.col("text"), DICTIONARY)).collect())
    for i, text in docs:
        assert first[i] == min(keyword_score(text), default="J")


@pytest.mark.parametrize("piece", [4096, 7])
def test_a_dictionary_table_matches_like_patterns(spark, monkeypatch, piece):
    monkeypatch.setattr(word_filter, "PIECE", piece)
    rng = random.Random(10)
    rows = [(c, "".join(rng.choices("abÉ ", k=rng.randint(1, 6)))) for c in "ABC" for _ in range(12)] + [("A", ""), ("B", "😀b")]
    texts = ["".join(rng.choices("abcé \nÉ", k=rng.randint(0, 80))) for _ in range(120)] + [None, "", "a😀ba😀bb"]
    table = spark.createDataFrame(rows, "category string, keyword string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r["doc_id"], r["category"]): r["matches"] for r in keywords.table_hits(df, table, "text").collect()}
    want = {}
    for i, text in enumerate(texts):
        for c in "ABC":
            words = sorted({w.lower() for k, w in rows if k == c and w}, key=lambda w: (-len(w), w))
            found = re.findall("|".join(map(re.escape, words)), (text or "").lower())
            if found:
                want[i, c] = found
    assert got == want
    assert keywords.table_hits(df, table.limit(0), "text").collect() == []
    stats = keywords.table_keyword_stats(df, table, "text").where("category = 'A'").collect()
    assert all(r["occurrences"] == len(want[r["doc_id"], "A"]) and r["unique_matches"] == len(set(want[r["doc_id"], "A"])) for r in stats)


def test_matches_equal_one_pattern_per_category(spark):
    rng = random.Random(9)
    own = {c: list({"".join(rng.choices("ab ", k=rng.randint(1, 4))).strip() or "a" for _ in range(6)}) for c in "ABCDEFG"}
    texts = ["".join(rng.choices("ab c\n", k=rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    match = keywords.match_keywords(df, own, "text")
    for r in match.df.collect():
        for c, column in match.columns.items():
            flat = "|".join(re.escape(w) for w in sorted(set(own[c]), key=lambda w: (-len(w), w)))
            assert r[column] == re.findall(flat, texts[r["i"]]), (own[c], texts[r["i"]])


def test_needs_model_leaves_out_decided_and_short_texts(spark):
    df = spark.createDataFrame([("1", "upgrade rating upgrade"), ("2", "ten chars!"), ("3", "a deal in the making")], "doc_id string, text string")
    assert [r["doc_id"] for r in classify.needs_model(df, DICTIONARY).collect()] == ["3"]


def test_dictionary_upkeep(spark):
    existing = spark.createDataFrame([("A", "eps"), ("A", "EBITDA"), ("B", "rating")], "category string, keyword string")
    new = spark.createDataFrame([("A", "Eps"), ("A", "profit"), ("C", "deal"), ("C", "deal")], "category string, keyword string")
    report = {r["category"]: tuple(r)[1:] for r in keywords.merge_keywords(existing, new).collect()}
    assert report == {"A": (2, 1, 1), "C": (0, 1, 0)}
    merged = {tuple(r) for r in keywords.merge_keywords(existing, new, dry_run=False).collect()}
    assert merged == {("A", "eps"), ("A", "EBITDA"), ("B", "rating"), ("A", "profit"), ("C", "deal")}
    assert dict(keywords.keyword_counts(existing).collect()) == {"A": 2, "B": 1, None: 3}
    assert keywords.to_dictionary(existing) == {"A": ["EBITDA", "eps"], "B": ["rating"]}


def fuse(a, ac, m, mc):
    if a is not None and m is not None:
        if a * m >= 0 and abs(a - m) < 0.5:
            wa, wm = ac or 0.5, mc or 0.5
            return (a * wa + m * wm) / (wa + wm), (wa + wm) / 2, "HYBRID_AGREEMENT"
        return (m, mc, "FINBERT_DOMINANT") if (mc or 0) > (ac or 0) else (a, ac, "MARKETAUX_DOMINANT")
    if a is not None:
        return a, ac, "MARKETAUX_ONLY"
    return (m, mc, "FINBERT_FALLBACK") if m is not None else (None, None, "NO_SENTIMENT")


def test_fusion(spark):
    values, confs = [None, -0.8, -0.2, 0.0, 0.3, 0.8], [None, 0.0, 0.4, 0.9, 45.0]
    rows = [(a, ac, m, mc) for a in values for ac in confs for m in values for mc in confs[:4]]
    df = spark.createDataFrame(rows, "a double, ac double, m double, mc double")
    fused = fuse_sentiment(F.col("a"), F.col("ac"), F.col("m"), F.col("mc"))
    for row, got in zip(rows, [r[0] for r in df.coalesce(1).select(fused).collect()]):
        s, c, name = fuse(*row)
        assert got["sentiment_source"] == name
        assert got["sentiment"] == (None if s is None else pytest.approx(s))
        assert got["confidence"] == (None if c is None else pytest.approx(c))
        if row[0] is not None and row[2] is not None:
            assert min(row[0], row[2]) - 1e-9 <= got["sentiment"] <= max(row[0], row[2]) + 1e-9


def test_fusion_may_rescale_the_vendor_confidence(spark):
    df = spark.createDataFrame([(0.9, 60.0, -0.9, 0.8)], "a double, ac double, m double, mc double")
    cols = [F.col(c) for c in df.columns]
    raw, scaled = df.select(fuse_sentiment(*cols), fuse_sentiment(*cols, rescale_first=True)).first()
    assert (raw["sentiment_source"], raw["confidence"]) == ("MARKETAUX_DOMINANT", 60.0)
    assert (scaled["sentiment_source"], scaled["confidence"]) == ("FINBERT_DOMINANT", 0.8)


def test_texts_that_go_to_the_model_are_scanned_once(spark, monkeypatch):
    from catalogue import classification
    from tapewire.operators import classify as operators

    scans, scan = [], operators.with_keyword_stats
    monkeypatch.setattr(operators, "with_keyword_stats", lambda *a: scans.append(a[2]) or scan(*a))
    rows = [(1, 0.9, "oil price", "oil", "the oil price of today"), (1, 0.9, "oil price", None, None), (None, None, "", "", "")]
    messages = spark.createDataFrame(rows, "doc_id bigint, confidence double, title string, description string, content string")
    monkeypatch.setattr(classification.tables, "messages", lambda *_: messages)
    found = classification.classify_with_model_hook(spark, "nowhere")
    assert scans == ["text"] and {r.doc_id for r in found.collect()} == {1, None}


def test_scores_made_before_decide_alike(spark):
    from tapewire.operators import classify as operators

    rows = [(1, "oil oil price", 0.9), (2, "bank loan and merger talks", 0.5), (2, "", None), (None, None, 0.4), (3, "nothing at all in this text", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, confidence double")
    words = {"A": ["oil", "price"], "B": ["bank", "merger"]}
    scored = operators.with_keyword_scores(df, words)
    for make in (operators.classify, operators.needs_model):
        want, got = make(df, words), make(scored, words, scores="keyword_scores")
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
