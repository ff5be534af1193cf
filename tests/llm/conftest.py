import random

import pytest

LONG = "long words in a very long text, " * 40_000  # 1.3 million characters


def prose(rng, n):
    return " ".join("".join(rng.choice(("on", "ti", "er", "the", "sh", "ré", "a")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=120, seed=1):
    """Texts with exact and near copies, shared passages, blanks, nulls and one very long one."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 200)) for _ in range(n // 3)]
    passage = prose(rng, 60)
    texts = list(base)
    for t in base:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(rng.choice((t, t.replace(" ", "  "), t + " " + passage, passage + t)))
    return [*texts, "", None, " \n\t", "a", "a", LONG, LONG[:-3], "é" * 300, "x y " * 300]


def table(spark, texts, ids=None):
    """Documents with extra columns named like those the operators add, a repeated row and a null id."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None, f"k{i}", "part", 1) for i, t in zip(ids, texts)]
    rows += [rows[0], (None, texts[0], "en", None, "null", "part", 1)] if rows else []
    kind = "doc_id bigint, text string, lang string, source string, keep_id string, digest string, n_tokens int"
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture
def docs(spark, texts):
    return table(spark, texts)


@pytest.fixture
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path
