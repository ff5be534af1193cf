"""Toxicity of texts that hide their words.

The writer meant plain words; the channel replaced letters by look-alikes, repeated letters or
put separators between them.  A character language model, counted over all documents, says
which plain word is likely: Viterbi runs over the lattice of readings, plain ones among them, of
every span that may be disguised.
The restored text is scored by words and word parts whose share of toxic documents was learned
from labelled rows.  There is no bar for a part: its log odds are shrunk by how often dealing out
the labels by chance gives parts as one-sided, which follows the size of the table.  A logistic
curve is fitted to the same rows, each held against evidence of the other folds.
"""

from __future__ import annotations

import functools
import hashlib
import math
import os
import pickle
import re
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import compress, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.llm.common import saved, taking_over
from tapewire.llm.near_dedup import _mixed, remembering_words, shingles

#: Labelled rows used at most: a uniform sample beyond that.  Word parts kept at most, the strongest.
MAX_LABELLED, MAX_PARTS = 40_000, 200_000
#: Folds of the labelled rows, and times that labels are dealt out by chance.
FOLDS, DEALS = 5, 8
#: Classes of log-likelihood ratios, classes on either side that are judged together, and bits of a
#: count (three in a long).
RATIOS, NEAR, BITS = np.arange(0, 60, 0.25), 4, 20
#: Word parts are whole words and their runs of this many characters, edges included.
PART_LENGTHS = (4, 5, 6)
#: Words a task remembers, of so many characters at most; characters of texts that are scored together.
WORDS, REMEMBERED, TOGETHER = 300_000, 64, 1 << 21

# Signs and the letters they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
SEPARATORS = " .-_*~"
#: Marks that often stand beside a word as themselves.
MARKS = "!|+(*"
#: Log costs of the channel: a look-alike (of marks only, and not between letters), a letter said
#: again, separators inside a word or between words, another look-alike that is no letter.
SWAP, AGAIN, APART, SPLIT, PLAIN = math.log(0.05), math.log(0.05), math.log(0.3), math.log(0.05), math.log(0.001)

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 28  # letters, other letters, word edge
_EDGE, _OTHER = 27, 26
_CODE = {c: i for i, c in enumerate(_LETTERS)}
_READS = {c: [(_CODE[r], r) for r in letters] for c, letters in LOOKALIKES.items()}
_CLASS = np.full(256, _EDGE, np.int64)
for _b in range(256):
    if chr(_b).lower() in _CODE and _b < 128:
        _CLASS[_b] = _CODE[chr(_b).lower()]
    elif _b >= 128:
        _CLASS[_b] = _OTHER

_SIGN = re.escape("".join(LOOKALIKES))
_APART = re.escape(SEPARATORS)
#: Spans that are read by themselves: single letters kept apart, and runs of letters, digits and signs.
_KEPT_APART = re.compile(rf"(?<!\w)[a-z{_SIGN}](?<!\*(?![{_APART}]{{1,4}}[a-z]))(?:[{_APART}]++[a-z{_SIGN}]){{2,}}(?!\w)")
DISGUISED = re.compile(rf"{_KEPT_APART.pattern}|[\w{_SIGN}]++")
#: What a disguised span holds: signs, doubled letters, or what keeps letters apart.  The letter
#: model chooses between the plain and the restored reading.
_SUSPECT = re.compile(rf"[{_SIGN} .~-]|([a-z])\1|^.(?:_+.){{2,}}$")
_SPAN = re.Match.group
#: How letters kept apart end: a text without it holds none.
_LONELY = re.compile(rf"[{_APART}][a-z{_SIGN}][{_APART}]++[a-z{_SIGN}](?!\w)")
#: Runs of letters, digits and signs are what stays of UTF-8 between spaces, once what is neither and not ASCII is gone.
_STRANGE = re.compile(r"[^\x00-\x7F\w]+")
_RUNS = bytes(b if b >= 128 or re.match(rf"[\w{_SIGN}]", chr(b)) else 32 for b in range(256))
_CLASSES = bytes(_CLASS.tolist())
#: Marks a letter that is said more than twice.
_MORE = "\0"
_WORD = re.compile(r"[^\W\d_]+")


# --- the language model -----------------------------------------------------------------------


def letter_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each run of three symbols (``code``) stands in all texts: ``n``.

    Symbols are the letters a to z whatever their case, any byte of another letter, and the edge
    of a word, so there are at most SYMBOLS ** 3 codes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**3, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(0):
                s = _CLASS[np.frombuffer(f"  {text.as_py()} ".encode(), np.uint8)]
                s = s[np.append(True, (s[1:] != _EDGE) | (s[:-1] != _EDGE))]  # one edge between words
                s = np.append(_EDGE, s)
                held.append((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])
                size += len(held[-1])
                if size >= TOGETHER:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
        counts += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=len(counts))
        codes = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts[codes])], names=["code", "n"])

    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def letter_model(counts: dict[int, int]) -> np.ndarray:
    """log P(c | a, b), smoothed by the pair and the single symbol."""
    tri = np.zeros(SYMBOLS**3)
    tri[list(counts)] = list(counts.values())
    tri = tri.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = tri.sum((0, 1)) + 1
    one /= one.sum()
    pair = tri.sum(0)
    two = (pair + 5 * one) / (pair.sum(1, keepdims=True) + 5)
    return np.log((tri + 5 * two) / (tri.sum(2, keepdims=True) + 5))


def decode(span: str, model: np.ndarray | list[float], known: dict[tuple[int, str], str] | None = None) -> str:
    """The likeliest plain words behind what may be a disguised span (lower case).

    A state is the last two symbols.  A letter is itself or the letter before said again; a sign
    is read as a letter, or stands for itself between words; a separator is passed over or parts
    words.  What all paths have in common is settled as they go, so spans may have any length.
    Up to the first sign or doubled letter there is one path, and what follows depends on its state
    alone: ``known`` remembers that.
    """
    at, state = 0, _EDGE * SYMBOLS + _EDGE
    for c, behind in zip(span, span[1:] + " "):
        if not c.isalpha() or (c == behind and c in _CODE):
            break
        at += 1
    for c in span[max(0, at - 2) : at]:
        for _ in c.encode():
            state = state % SYMBOLS * SYMBOLS + _CODE.get(c, _OTHER)
    key = state, span[at:]
    rest = known.get(key) if known is not None else None
    if rest is None:
        rest = _behind(*key, span[:at][-1:], model if isinstance(model, list) else np.ravel(model).tolist())
        if known is not None and len(span) <= REMEMBERED:
            if len(known) >= WORDS // 3:
                known.clear()
            known[key] = rest
    return (span[:at] + rest).strip()


def _behind(state: int, span: str, ahead: str, flat: list[float]) -> str:
    """The likeliest words of what follows ``state`` and its last letter, ``ahead``."""
    beams: dict[int, tuple[float, str]] = {state: (0.0, "")}
    settled: list[str] = []
    for i, c in enumerate(span):
        own, after = _CODE.get(c), {}
        if own is not None:
            for state, (score, read) in beams.items():
                last = state % SYMBOLS
                to, value = last * SYMBOLS + own, score + flat[state * SYMBOLS + own]
                if to not in after or value > after[to][0]:
                    after[to] = value, read + c
                if own == last and (state not in after or score + AGAIN > after[state][0]):
                    after[state] = score + AGAIN, read
        else:
            before, behind = span[i - 1] if i else ahead, span[i + 1 : i + 2]
            inside = behind in _CODE and before != "" and before not in SEPARATORS
            swap = SWAP if c in MARKS and not inside else 0.0
            reads = _READS.get(c, [])
            other = len(c.encode()) if c.isalpha() else 0  # a letter that is not a to z
            passed = (0.0 if before and before in SEPARATORS else APART) if c in SEPARATORS or not (reads or other) else None
            again = AGAIN + SWAP  # two signs are rather two letters
            plain = SPLIT if c in SEPARATORS else 0.0 if c in MARKS else PLAIN
            for state, (score, read) in beams.items():
                last = state % SYMBOLS
                ways = [(last * SYMBOLS + s, score + swap + flat[state * SYMBOLS + s], read + r) for s, r in reads]
                ways += [(state, score + swap + again, read) for s, _ in reads if s == last]
                if other:
                    to, value = state, score
                    for _ in range(other):
                        value += flat[to * SYMBOLS + _OTHER]
                        to = to % SYMBOLS * SYMBOLS + _OTHER
                    ways.append((to, value, read + c))
                else:
                    if passed is not None:
                        ways.append((state, score + passed, read))
                    if last != _EDGE:
                        ways.append((last * SYMBOLS + _EDGE, score + plain + flat[state * SYMBOLS + _EDGE], read + " "))
                    else:
                        ways.append((state, score + (0.0 if c in SEPARATORS else plain), read))
                for to, value, text in ways:
                    if to not in after or value > after[to][0]:
                        after[to] = value, text
        beams = after
        if i % 64 == 63:
            same = os.path.commonprefix([read for _, read in beams.values()])
            settled.append(same)
            beams = {state: (score, read[len(same) :]) for state, (score, read) in beams.items()}
    _, best = max((score + (flat[state * SYMBOLS + _EDGE] if state % SYMBOLS != _EDGE else 0.0), read) for state, (score, read) in beams.items())
    return "".join([*settled, best])


class Restorer:
    """Reads texts in lower case, every span that may be disguised by `decode`."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.ravel().tolist()
        every = np.arange(SYMBOLS)
        # Between letters x and e, a letter that is said twice is likelier meant once: by x, letter, e.
        kept = model[:, every, every][:, :, None] + model[every, every, :][None]
        self.once = AGAIN + model > kept
        self.known: dict[tuple[int, str], str] = {}  # of `decode`

    def _read(self, span: str) -> str:
        if any(x in _CODE for x in span) and _SUSPECT.search(span):
            return f" {decode(span, self.model, self.known)} "
        return span

    def _of_letters(self, spans: Iterable[str]) -> list[str]:
        """What `decode` finds in spans of letters: the two paths of a letter said twice meet at the
        next letter, so its neighbours settle it.  Spans with a letter said more often are marked."""
        text = f" {' '.join(spans)} ".encode()
        letters = np.frombuffer(text.translate(_CLASSES), np.uint8)
        again = np.flatnonzero((letters[1:] == letters[:-1]) & (letters[1:] < _OTHER)) + 1
        read, stays = np.frombuffer(text, np.uint8).copy(), np.ones(len(text), bool)
        stays[again] = ~self.once[letters[again - 2], letters[again], letters[again + 1]]
        more = again[1:][np.diff(again) == 1]
        read[more], stays[more] = ord(_MORE), True
        return read[stays].tobytes().decode().split()

    def _of_spans(self, spans: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, and where those of each span begin and how many there are."""
        of_letters = np.fromiter(map(str.isalpha, spans), bool, len(spans))
        words = self._of_letters(compress(spans, of_letters.tolist()))
        first, sizes = np.zeros(len(spans), np.int64), np.ones(len(spans), np.int64)
        first[of_letters] = np.arange(len(words))
        marked = np.flatnonzero(of_letters)[[k for k, word in enumerate(words) if _MORE in word]]
        for k in [*np.flatnonzero(~of_letters).tolist(), *marked.tolist()]:
            found = _WORD.findall(self._read(spans[k]))
            first[k], sizes[k] = len(words), len(found)
            words += found
        return words, first, sizes

    def together(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, all those of the restored texts among them; the numbers of each text's, each
        once, text by text; and where those of a text end, after a 0.  A span is read once for all texts."""
        runs: list[bytes] = []
        sets: list[set[str]] = []  # spans of texts that are not split with the others
        owners: list[int] = []
        for k, text in enumerate(texts):
            text = text.lower()
            # Only letters that are kept apart reach over more than a run.
            if _LONELY.search(text) and _KEPT_APART.search(text):
                owners.append(k)
                sets.append(set(map(_SPAN, DISGUISED.finditer(text))))
                text = ""
            elif not text.isascii():
                text = _STRANGE.sub(" ", text)
            run = text.encode().translate(_RUNS)
            if len(run) > TOGETHER:
                owners.append(k)
                sets.append(set().union(*(_numbered(_split(pa.array([p], pa.binary()))[0])[0] for p in _pieces(run))))
                run = b""
            runs.append(run)
        spans, of = _split(pa.array(runs, pa.binary()))
        if sets:
            spans = pa.concat_arrays([spans, pa.array([s for some in sets for s in some], pa.string())])
            of = np.concatenate([of, np.repeat(owners, list(map(len, sets)))])
        spans, place = _numbered(spans)
        words, first, sizes = self._of_spans(spans)
        words, numbers = _numbered(pa.array(words, pa.string()))
        n = sizes[place]
        its = np.repeat(first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = np.sort(np.repeat(of, n) * max(1, len(words)) + numbers[its])
        of, found = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], max(1, len(words)))
        return words, found, np.searchsorted(of, np.arange(len(texts) + 1))

    def each(self, texts: list[str]) -> Iterator[list[str]]:
        """The distinct words of each restored text, in order."""
        words, found, ends = self.together(texts)
        return (sorted(map(words.__getitem__, found[a:b].tolist())) for a, b in pairwise(ends.tolist()))

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text."""
        return set(next(self.each([text])))

    def __call__(self, text: str) -> str:
        """The restored text."""
        return DISGUISED.sub(lambda m: self._read(m.group()), text.lower())


# --- words and their parts ----------------------------------------------------------------------


def part_hashes(words: Collection[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of their parts, and whose they are (numbers of words)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le"), "<u4").astype(np.uint64)
    ends, own = np.repeat(np.cumsum(lengths), lengths), np.repeat(np.arange(len(words)), lengths)
    # A word as long as a part is that part.
    whole = ~np.isin(lengths, PART_LENGTHS)
    of = [np.flatnonzero(whole)]
    found = [np.fromiter(map(xxhash.xxh3_64_intdigest, compress(words, whole.tolist())), np.uint64, len(of[0]))]
    total = np.zeros(len(codes), np.uint64)
    for n in range(1, min(max(PART_LENGTHS), len(codes)) + 1):
        size = len(codes) - n + 1
        total = _mixed(total[:size] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :])
        if n in PART_LENGTHS:
            inside = np.flatnonzero(np.arange(n, size + n) <= ends[:size])
            found.append(_mixed(total[inside] + np.uint64(n)))
            of.append(own[inside])
    return np.concatenate(found).view(np.int64), np.concatenate(of)


def parts(word: str) -> set[int]:
    """Hashes of a word and of its parts."""
    return set(part_hashes([word])[0].tolist())


class _Evidence:
    """The strongest evidence of the parts of words, by column of ``weights``; a word met before is
    not looked up again."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.low = (1 << max(10, (8 * len(keys)).bit_length())) - 1
        self.place = np.full(self.low + 1, -1, np.int32)  # by the low bits of the keys: few other parts have them
        self.place[self.keys & self.low] = np.arange(len(keys))
        self.behind = np.flatnonzero(self.place[self.keys & self.low] != np.arange(len(keys)))  # another key has their place
        self.known: dict[str, int] = {}  # rows of found
        self.found = np.zeros((0, *weights.shape[1:]))

    def _look_up(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), *self.weights.shape[1:]))
        hashes, of = part_hashes(words)
        at = self.place[hashes & self.low]
        some = np.flatnonzero(at >= 0)
        hashes, of, at = hashes[some], of[some], at[some]
        hit = self.keys[at] == hashes
        np.maximum.at(out, of[hit], self.weights[at[hit]])
        if len(self.behind):
            hashes, of, keys = hashes[~hit], of[~hit], self.keys[self.behind]
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[at] == hashes
            np.maximum.at(out, of[hit], self.weights[self.behind[at[hit]]])
        return out

    def of(self, words: list[str]) -> np.ndarray:
        """The evidence of distinct words, a row a word."""
        if not len(self.keys):
            return np.zeros((len(words), *self.weights.shape[1:]))
        known = self.known
        rows = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = [words[k] for k in np.flatnonzero(rows < 0).tolist()]
        if len(self.found) and len(self.found) + len(new) > WORDS:
            known.clear()
            self.found, new, rows[:] = self.found[:0], words, -1
        blocks = [self._look_up(new[at : at + WORDS_AT_ONCE]) for at in range(0, len(new), WORDS_AT_ONCE)]
        number = len(self.found)
        rows[rows < 0] = np.arange(number, number + len(new))
        known.update(zip(new, range(number, number + len(new))))
        self.found = np.concatenate([self.found, *blocks])
        out = self.found[rows]
        for word in [w for w in new if len(w) > REMEMBERED]:
            del known[word]
        return out


def _summed(values: list[float]) -> tuple[float, float, float]:
    """Of the evidence of distinct words: the strongest, all of it, and their number, dampened.

    The sum is exact, so it does not depend on the order of the words.
    """
    return max(values, default=0.0), math.log1p(math.fsum(values)), math.log1p(len(values))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What stands between white space in UTF-8, and the numbers of the texts it is of."""
    lists = pc.ascii_split_whitespace(texts.view(pa.string()))
    found, of = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(found), 0)  # also before the first and behind the last space
    return found.filter(some), of[some.to_numpy(zero_copy_only=False)]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about TOGETHER bytes, cut before spaces."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + TOGETHER)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _numbered(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct words, and the number of each."""
    coded = words.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


def _together(texts: Iterable[str]) -> Iterator[list[str]]:
    """Consecutive texts of about TOGETHER characters in all, or one that is longer."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Model:
    """What scoring needs: the letters, the parts' evidence, and the curve."""

    letters: np.ndarray
    evidence: dict[int, float]
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.restore, self.curve = Restorer(model.letters), model.curve
        n = len(model.evidence)
        self.evidence = _Evidence(np.fromiter(model.evidence, np.int64, n), np.fromiter(model.evidence.values(), float, n))

    def features(self, text: str) -> tuple[float, float, float]:
        """The strongest evidence of any word, that of all distinct words, and their number, dampened."""
        return next(self._features([text]))

    def _features(self, texts: list[str]) -> Iterator[tuple[float, float, float]]:
        words, found, ends = self.restore.together(texts)
        values = self.evidence.of(words)[found]
        return (_summed(values[a:b].tolist()) for a, b in pairwise(ends.tolist()))

    def score(self, text: str) -> float:
        return self.scores([text])[0]

    def scores(self, texts: Iterable[str]) -> list[float]:
        """Scores of texts; those that stand together share the look-up of their words."""
        z = [float(self.curve @ (1.0, *found)) for some in _together(texts) for found in self._features(some)]
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, v)))) for v in z]


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, slightly shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = (x * (p * (1 - p))[:, None]).T @ x + shrink + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


# --- learning and scoring -------------------------------------------------------------------------


def _labelled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: str) -> DataFrame:
    """``_text``, ``_y`` to learn from: all labelled rows, or a uniform sample of MAX_LABELLED.

    Of rows of one label that hold the same five-word shingles the smallest text counts, once.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = saved(known.where(F.expr(train.format(id="_id"))).groupBy("_id").agg(F.max("_y").alias("_y")), "labels", labels.count())
    n = known.count()
    if n > MAX_LABELLED:
        share = int(MAX_LABELLED / n * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) < share)
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering_words()
        for batch in batches:
            sets = [hashlib.blake2b(shingles(t.as_py(), 5).tobytes(), digest_size=16).digest() for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *(batch.column(c) for c in ("_text", "_y"))], names=["_set", "_text", "_y"])

    rows = texts.join(F.broadcast(known), "_id").select("_text", "_y")  # about MAX_LABELLED ids at most
    # Copies would count as evidence many times over: of those with the same set of shingles, one.
    one = rows.mapInArrow(described, "_set binary, _text string, _y int").groupBy("_set", "_y").agg(F.min("_text").alias("_text"))
    return one.select("_text", "_y").repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: str = "true",
) -> Model:
    """Learns from the documents that have a label and satisfy ``rows``, SQL with ``{id}`` for the id.

    The letter model counts all documents.  Without labels of both kinds every score is the share
    of toxic labels (0 without any).
    """
    counts = {r["code"]: r["n"] for r in letter_counts(df, text_col).collect()}  # SYMBOLS ** 3 at most
    letters = letter_model(counts)
    learn = saved(_labelled(df, labels, id_col, text_col, label_col, rows), "labelled")
    total = dict(learn.groupBy("_y").count().collect())
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return Model(letters, {}, np.array([-500.0 if not bad else 500.0, 0, 0, 0]))

    share = bad / (bad + good)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(letters)
        for batch in batches:
            texts, ys = batch.column("_text").to_pylist(), batch.column("_y").to_pylist()
            adds = np.array([_adds(t, y, share) for t, y in zip(texts, ys)], np.int64).reshape(-1, _LONGS)
            words = [" ".join(w) for some in _together(texts) for w in restore.each(some)]
            arrays = [pa.array(words, pa.string()), pa.array(map(_fold, texts), pa.int32())]
            arrays += [batch.column("_y"), *(pa.array(adds[:, k]) for k in range(_LONGS))]
            yield pa.RecordBatch.from_arrays(arrays, names=["words", "fold", "y", *_ADDS])

    counts_kind = ", ".join(f"{c} bigint" for c in _ADDS)
    learn = saved(learn.select("_text", "_y").mapInArrow(read, f"words string, fold int, y int, {counts_kind}"), "read")
    found = learn.select("words", *_ADDS).mapInArrow(_count_parts, f"part bigint, {counts_kind}")
    found = saved(found.groupBy("part").agg(*(F.sum(c).alias(c) for c in _ADDS)), "parts")
    sizes = learn.groupBy("fold", "y").count().collect()
    docs = np.zeros((2, FOLDS + 1))  # all and toxic documents, in all and without each fold
    docs[:, 0] = bad + good, bad
    docs[:, 1:] = docs[:, :1]
    for r in sizes:
        docs[:, 1 + r["fold"]] -= r["count"], r["count"] * r["y"]
    chance = _chance(found, docs[1, 0] / docs[0, 0])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _evidence(batch, docs, chance)
            keep = pa.array((e > 0).any(axis=1))
            arrays = [batch.column("part"), *(pa.array(e[:, k], pa.float64()) for k in range(FOLDS + 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", *(f"e{k}" for k in range(FOLDS + 1))]).filter(keep)

    strong = found.mapInArrow(weigh, "part bigint, " + ", ".join(f"e{k} double" for k in range(FOLDS + 1)))
    names = [f"e{k}" for k in range(FOLDS + 1)]
    top = strong.orderBy(F.desc(F.greatest(*names)), "part").limit(MAX_PARTS).toArrow()
    of = [top.column(c).to_numpy() for c in ("part", *names)]

    weights = np.column_stack(of[2:])  # of the documents outside each fold

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = _Evidence(of[0], weights)
        for batch in batches:
            folds = iter(batch.column("fold").to_pylist())
            values = []
            for some in _together(batch.column("words").to_pylist()):
                words, owners = _split(pa.array(some, pa.string()))
                words, place = _numbered(words)
                found = evidence.of(words)
                ends = np.searchsorted(owners, np.arange(len(some) + 1)).tolist()
                values += [_summed(found[place[a:b], next(folds)].tolist()) for a, b in pairwise(ends)]
            arrays = [pa.array([v[k] for v in values], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("y")], names=["best", "total", "words", "y"])

    kind = "best double, total double, words double, y int"
    measured = learn.select("words", "fold", "y").mapInArrow(features, kind).toPandas()  # MAX_LABELLED rows
    measured = measured.sort_values(list(measured.columns))  # the same sums in every run
    some = of[1] > 0
    model = Model(letters, dict(zip(of[0][some].tolist(), of[1][some].tolist())))
    model.curve = _fit(measured[["best", "total", "words"]].to_numpy(), measured["y"].to_numpy())
    return model


# Counts of a part: documents of each fold, toxic ones of each fold, toxic ones of each deal.
_COUNTS = 2 * FOLDS + DEALS
_LONGS = -(-_COUNTS // 3)
_ADDS = [f"c{k}" for k in range(_LONGS)]
#: Parts of the distinct words that a task gathers before it adds them up, and words of a text whose parts are
#: gathered at once; parts that a task counts until it ends, those it meets first.
GATHERED, WORDS_AT_ONCE, COUNTED = 300_000, 20_000, 200_000


def _fold(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) % FOLDS


def _adds(text: str, y: int, share: float) -> list[int]:
    """What a document adds to the counts of its parts, three counts in a long."""
    k = _fold(text)
    ones = [k] + [FOLDS + k] * y
    ones += [2 * FOLDS + d for d in range(DEALS) if xxhash.xxh3_64_intdigest(text, seed=1 + d) < share * 2**64]
    out = [0] * _LONGS
    for at in ones:
        out[at // 3] |= 1 << at % 3 * BITS
    return out


def _lists(column: pa.Array) -> Iterator[list[str]]:
    """The words of each row, held as a list or in one string."""
    return (row.as_py().split() if pa.types.is_string(row.type) else row.as_py() for row in column)


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of parts, added up over the documents that are gathered at once; those of the first
    COUNTED parts, most of the frequent ones among them, over all documents."""
    held: dict[str, int] = {}  # distinct words of the documents gathered, numbered
    rows: list[tuple[np.ndarray, list[int]]] = []
    size = 0
    counted, totals = np.zeros(0, np.int64), np.zeros((0, _LONGS), np.int64)  # by part, ascending

    def batch_of(part: np.ndarray, sums: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part), *map(pa.array, sums)], names=["part", *_ADDS])

    def added() -> pa.RecordBatch:
        nonlocal counted, totals
        hashes, owners = part_hashes(held)
        part, place = np.unique(hashes, return_inverse=True)
        order = np.argsort(owners, kind="stable")
        place, starts = place[order], np.searchsorted(owners[order], np.arange(len(held) + 1))
        sums, last = np.zeros((len(part), _LONGS), np.int64), np.zeros(len(part), np.int64)
        for words, add in rows:
            first, n = starts[words], starts[words + 1] - starts[words]
            number = np.arange(n.sum())
            its = place[np.repeat(first - np.cumsum(n) + n, n) + number]
            last[its] = number
            sums[its[last[its] == number]] += add  # a part counts once a document
        held.clear()
        rows.clear()
        at = np.searchsorted(counted, part)
        other = (np.append(counted, 0)[at] != part) | (at == len(counted))
        totals[at[~other]] += sums[~other]
        more = np.flatnonzero(other)[: COUNTED - len(counted)]
        counted, totals = np.insert(counted, at[more], part[more]), np.insert(totals, at[more], sums[more], axis=0)
        other[more] = False
        return batch_of(part[other], list(sums[other].T))

    for batch in batches:
        adds = zip(*(batch.column(c).to_pylist() for c in _ADDS))
        for words, add in zip(_lists(batch.column("words")), adds):
            new = [w for w in words if w not in held]
            size += sum(map(len, new)) * len(PART_LENGTHS)
            if size >= GATHERED or len(words) > WORDS_AT_ONCE:
                if rows:
                    yield added()
                new, size = words, sum(map(len, words)) * len(PART_LENGTHS)
            if size < GATHERED and len(words) <= WORDS_AT_ONCE:
                if words:
                    held.update(zip(new, range(len(held), len(held) + len(new))))
                    rows.append((np.fromiter(map(held.__getitem__, words), np.int64, len(words)), add))
                continue
            # One of very many words gathers its parts by classes of their hash.
            size, classes = 0, -(-len(words) // WORDS_AT_ONCE)
            for c in range(classes):
                some = (part_hashes(words[at : at + WORDS_AT_ONCE])[0] for at in range(0, len(words), WORDS_AT_ONCE))
                found = np.unique(np.concatenate([h if classes == 1 else h[h % classes == c] for h in some]))
                yield batch_of(found, [np.full(len(found), n, np.int64) for n in add])
    if rows:
        yield added()
    yield batch_of(counted, list(totals.T))


def _counts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and toxic documents of parts by fold, toxic ones by deal."""
    longs = np.column_stack([batch.column(c).to_numpy() for c in _ADDS])
    all_ = np.stack([longs >> k * BITS & (1 << BITS) - 1 for k in range(3)], axis=2).reshape(len(longs), -1)
    return all_[:, :FOLDS], all_[:, FOLDS : 2 * FOLDS], all_[:, 2 * FOLDS : _COUNTS]


def _ratio(n: np.ndarray, yes: np.ndarray, share: float) -> np.ndarray:
    """Class of the log-likelihood ratio of parts that lean to toxic documents, 1 of all others."""
    no = n - yes
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(yes > 0, yes * np.log(yes / n / share), 0) + np.where(no > 0, no * np.log(no / n / (1 - share)), 0)
    return np.digitize(np.where(yes > share * n, np.maximum(np.nan_to_num(ratio), 0), 0), RATIOS)


def _chance(found: DataFrame, share: float) -> np.ndarray:
    """Of the parts of about a ratio, the share that chance gives, by class of the ratio; falls with it."""
    wide = len(RATIOS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        real, dealt = np.zeros(wide, np.int64), np.zeros(wide, np.int64)
        for batch in batches:
            n, yes, deals = _counts(batch)
            real += np.bincount(_ratio(n.sum(1), yes.sum(1), share), minlength=wide)
            for d in range(DEALS):
                dealt += np.bincount(_ratio(n.sum(1), deals[:, d], share), minlength=wide)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide)), pa.array(real), pa.array(dealt)], names=["class", "n", "dealt"])

    rows = found.mapInArrow(run, "class bigint, n bigint, dealt bigint").groupBy("class").agg(F.sum("n"), F.sum("dealt")).collect()
    real, dealt = np.zeros(wide), np.zeros(wide)
    for k, n, d in rows:
        real[k], dealt[k] = n, d
    # Not of all above: a few strong words must not carry chance parts below them.
    near = np.ones(2 * NEAR + 1)
    real, dealt = np.convolve(real, near)[NEAR:-NEAR], np.convolve(dealt, near)[NEAR:-NEAR]
    return np.minimum.accumulate(np.minimum(1, (dealt + 1) / DEALS / np.maximum(real, 1)))


def _evidence(batch: pa.RecordBatch, docs: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Log odds of parts against the label's share, shrunk by chance: of all documents, and without each fold."""
    n, yes, _ = _counts(batch)
    out = np.zeros((len(n), FOLDS + 1))
    for k in range(FOLDS + 1):
        total, bad = docs[:, k]
        if not 0 < bad < total:
            continue
        m = n.sum(1) - (n[:, k - 1] if k else 0)
        b = yes.sum(1) - (yes[:, k - 1] if k else 0)
        odds = np.log((b + 0.5) / (m - b + 0.5)) - math.log(bad / (total - bad))
        out[:, k] = np.where(b > 0, np.maximum(odds, 0) * (1 - chance[_ratio(m, b, bad / total)]) ** 2, 0)
    return out


def _scorer(pickled: bytes) -> Scorer:
    taking_over("toxicity", _loaded.cache_clear)
    return _loaded(pickled)


@functools.lru_cache(maxsize=1)
def _loaded(pickled: bytes) -> Scorer:
    return Scorer(pickle.loads(pickled))


def score(spark: SparkSession, df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``score`` (0 to 1, higher: likelier toxic) of every row.

    Null and empty texts are scored as texts without evidence.  Repeated rows and null ids are
    answered row by row.  Other columns are ignored, whatever their names.
    """
    sent = spark.sparkContext.broadcast(pickle.dumps(model))  # MAX_PARTS parts, SYMBOLS ** 3 numbers
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for batch in batches:
            scores = scorer.scores(t.as_py() for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
