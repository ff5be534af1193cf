import pytest

from tapewire.llm.token_counts import count_tokens, lengths
from tests.llm.conftest import LONG


def test_counts_are_the_library_s(spark, docs, nothing, vocabulary):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = count_tokens(docs, path, piece_bytes=64, batch_bytes=256)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    by_id = {r.doc_id: r for r in got.collect()}
    for d in docs.collect():
        text = d.text or ""
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (by_id[d.doc_id].n_tokens, by_id[d.doc_id].n_bytes) == (want, len(text.encode()))
    assert got.count() == docs.count()
    assert count_tokens(nothing, path).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("text", [
    "it's a  test \n\n of <|endoftext|> things\t 12345 -- éa ", "   lead", "trail   ", "a " * 500, LONG[:5000], "é日本 " * 50, "x y  z",
])
def test_cut_texts_have_the_tokens_of_whole_ones(vocabulary, name, text):
    model = lengths(vocabulary(name))
    parts = list(model.pieces(text, 7))
    if name.endswith(".json"):
        assert "".join(parts) == text
    assert sum(model.batch(parts)) == sum(model.batch([text]))
