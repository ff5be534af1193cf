import random

import pytest

from tapewire.llm.sentence_pieces import DoubleArray, _fields, decode, encode, pieces

SAMPLES = ["Hello world", "a  b   c", " lead", "trail ", "naïve café 日本語 🙂", "x\ny\tz", "", "  ", "Unbelievable!? 12345", "▁odd▁marks", "́e"]


def as_unigram(path, target):
    """The same model file with its type set to unigram, for the library to encode with."""
    def field(number, value):
        out = bytes([number << 3 | 2])
        n = len(value)
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n]) + value

    def varint(message):
        out = b""
        for number, value in _fields(message):
            if number == 3 and isinstance(value, int):
                value = 1
            if isinstance(value, int):
                tag, n = number << 3, value
                out += bytes([tag & 127 | 128, tag >> 7]) if tag > 127 else bytes([tag])
                while n > 127:
                    out, n = out + bytes([n & 127 | 128]), n >> 7
                out += bytes([n])
        return out

    with open(path, "rb") as file:
        proto = file.read()
    parts = []
    for number, value in _fields(proto):
        parts.append(field(number, varint(value) if number == 2 else value))
    with open(target, "wb") as file:
        file.write(b"".join(parts))


def test_viterbi_is_the_library_s_unigram(tmp_path, vocabulary, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = vocabulary("piece_bpe_32k.model")
    as_unigram(path, str(tmp_path / "unigram.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "unigram.model"))
    model = pieces(path)
    score = lambda ids: sum(model.unknown_score if i in model.byte_ids else model.scores[i] for i in ids)
    rng = random.Random(1)
    words = [w for t in texts if t for w in t[:2000].split()]
    # One word at a time, as the library adds single precision scores, and by its lattice: its
    # shortcut for the best path alone misses better sums ("the": -13 for one piece, -8 for two).
    for text in [*rng.sample(words, 150), *(w for s in SAMPLES for w in s.split())]:
        ours, theirs = model.encode(text).tolist(), library.nbest_encode_as_ids(text, 2)[0]
        assert ours == theirs or score(ours) == score(theirs), text


def test_best_path_against_all_paths(vocabulary):
    model = pieces(vocabulary("piece_bpe_32k.model"))
    known = {}
    for i in range(len(model.scores)):
        if i not in model.byte_ids and i > 2:
            known[model.surface[i].decode().replace(" ", "▁")] = model.scores[i]

    def best(part):
        table = [0.0] + [None] * len(part)
        for end in range(1, len(part) + 1):
            options = [table[a] + known[part[a:end]] for a in range(end) if part[a:end] in known]
            if part[end - 1] not in known:
                options.append(table[end - 1] + model.unknown_score)
            table[end] = max(options)
        return table[-1]

    for text in ("▁unbelievable", "▁therhanthe", "▁日本x", "▁▁▁a", "ouandtion.,!"):
        ids = model.viterbi(text)
        plain = [i for i in ids if i not in model.byte_ids]
        unknown = sum(len(c.encode()) and c not in known for c in text)
        assert sum(model.scores[i] for i in plain) + unknown * model.unknown_score == pytest.approx(best(text))


def test_cutting_changes_nothing(vocabulary):
    model = pieces(vocabulary("piece_bpe_32k.model"))
    for text in SAMPLES:
        whole = model.normalized(text)
        ids = model.encode(text).tolist()
        both = [sum(model.unknown_score if i in model.byte_ids else model.scores[i] for i in x) for x in (ids, model.viterbi(whole))]
        assert both[0] == pytest.approx(both[1])


def test_double_array_against_a_dictionary():
    rng = random.Random(2)
    keys = sorted({bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randint(1, 6))) for _ in range(500)})
    trie = DoubleArray(zip(keys, range(len(keys))))
    for _ in range(500):
        text = bytes(rng.choice(b"abc\xff\x00") for _ in range(8))
        assert trie.prefixes(text) == [(n, keys.index(text[:n])) for n in range(1, 9) if text[:n] in keys]


def test_round_trip(spark, docs, nothing, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    got = encode(docs, path)
    assert got.count() == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    back = {r.doc_id: r.text for r in decode(got, path).collect()}
    for r in got.collect():
        assert r.n_pieces == len(r.ids) and r.round_trip and back[r.doc_id] == (texts[r.doc_id] or "")
    assert encode(nothing, path).collect() == [] and decode(encode(nothing, path), path).collect() == []
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6, -1, None])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in decode(odd, path).collect()} == {1: None, 2: "", 3: ""}
