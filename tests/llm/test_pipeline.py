import random

import corpus_pipeline
from tapewire.llm import common, near_dedup, packing, suffix_dedup, toxicity
from tests.llm.conftest import prose


def test_stages_against_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    clean = [prose(rng, 150) for _ in range(40)]
    passage = prose(rng, 80)
    rows, labels = [], []
    for i, text in enumerate(clean):
        rows.append((i, text))
    near = clean[3].split()
    near[70] = "other"
    rows += [(100, clean[0]), (101, clean[1].replace(" ", "\n")), (102, " ".join(near)), (103, passage + " " + prose(rng, 100)), (104, prose(rng, 100) + " " + passage)]
    for i in range(200, 260):
        words = prose(rng, 100).split()
        toxic = i % 2
        for k in range(4 * toxic):
            words[20 * k] = "gribblesnark"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    rows += [(300, None), (301, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    toxic, exact, close, last = kept
    assert not any(200 < i < 300 and i % 2 for i in toxic) and {i for i in toxic if 200 <= i < 260} == set(range(200, 260, 2))
    assert toxic - exact == {100, 101, 301} and exact - close == {102} and last == close
    texts = {r.doc_id: r for r in docs.collect()}
    assert passage in texts[103].text and passage not in texts[104].text and texts[104].n_chars == len(texts[104].text)
    assert all(texts[i].text == clean[i] for i in range(40))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == close
    assert len(corpus_pipeline.STAGES) == 5


def test_passages_are_cut_from_each_text_of_an_id(spark, tmp_path):
    rng = random.Random(9)
    passage, own, other = prose(rng, 80), prose(rng, 60), prose(rng, 60)
    rows = [(1, passage + " " + prose(rng, 50)), (5, own + " " + passage), (5, other), (5, None), (None, own)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    got = corpus_pipeline.repeated_passages(spark, docs, str(tmp_path)).collect()
    five = [r.text for r in got if r.doc_id == 5]
    assert len(got) == 5 and other in five and None in five
    cut = [t for t in five if t not in (other, None)]
    assert len(cut) == 1 and cut[0].startswith(own[:50]) and passage not in cut[0]


def test_python_gets_documents_in_small_batches(spark, tmp_path):
    """A batch is held whole by the executor and by Python."""
    key, rng = "spark.sql.execution.arrow.maxRecordsPerBatch", random.Random(10)
    docs = spark.createDataFrame([(i, prose(rng, 30), 0) for i in range(20)], "doc_id bigint, text string, n_chars bigint")
    try:
        for before, after in (("10000", "2000"), ("0", "2000"), ("7", "7")):
            spark.conf.set(key, before)
            out = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
            assert spark.conf.get(key) == after
            assert sorted(r.doc_id for r in out.collect()) == list(range(20))
            assert out.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset(key)


def test_a_worker_remembers_one_operator_at_a_time(vocabulary):
    """Workers serve all stages; what each remembers must not add up."""
    common.taking_over("nothing")
    near_dedup.remembering_words()
    near_dedup.shingles("some words here", 2)
    assert near_dedup._words
    packing._encoder(vocabulary("word_bpe_49k.json")).encode("some words")
    assert not near_dedup._words and packing.word_ids.cache_info().currsize == 1
    model = toxicity.Model(toxicity.letter_model({}), {})
    first = toxicity._scorer(toxicity.pickle.dumps(model))
    assert toxicity._scorer(toxicity.pickle.dumps(model)) is first and packing.word_ids.cache_info().currsize == 0
    assert list(suffix_dedup._rows(iter([]))) == [] and toxicity._loaded.cache_info().currsize == 0
