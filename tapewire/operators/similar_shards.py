"""Questions asked of one shard of articles at a time: postings lie in arrays, the best are kept.

A task reads the articles of a shard, then their postings, then all questions in a stream.  It holds the
shard and a batch of questions, however many there are, and gives back no more than the best few of
each question.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Kinds of rows, in the order in which a shard gets them.
ARTICLE, POSTING, QUESTION = 0, 1, 2
#: Columns of all kinds: ``id`` is the article; ``number`` its place in the order of ids, or the question's;
#: ``name`` the article's or the question's category, or the term; ``at`` the time of publication.
ROWS = (
    "shard int, kind tinyint, id string, number bigint, name string, at bigint, field tinyint, tf bigint, dl int,"
    " terms array<string>, times array<bigint>, weights array<array<double>>"
)
FOUND = "gid bigint, number bigint, score double, publishedAt bigint"


#: Terms of a question up to which it is answered by its parts, and postings of parts that are remembered.
MOST_TERMS, MOST_HELD = 4, 2_000_000


class Part(NamedTuple):
    """Articles that have all of some terms in a field, with their sums, the best of them, and the best of categories."""

    doc: np.ndarray
    sums: np.ndarray
    best: tuple[np.ndarray, np.ndarray]
    of: dict[int, tuple[np.ndarray, np.ndarray]]


class Shard:
    """Articles in the order of results of equal score, and their postings by term and field."""

    def __init__(self, means: list[float | None], k1: float, b: float, most: int, bonus: float):
        self.means, self.k1, self.b, self.most, self.bonus = means, k1, b, most, bonus
        self.articles: list[pa.Table] = []
        self.place: dict[str, int] | None = None
        self.terms: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.weights: dict[int, list[float | None]] = {}
        self.held: dict[tuple[int, tuple[int, ...]], Part] = {}
        self.size, self.sorted = 0, False

    def add_articles(self, batch: pa.RecordBatch) -> None:
        self.articles.append(batch.select(["id", "number", "name", "at"]))

    def _order(self) -> None:
        rows = pa.Table.from_batches(self.articles) if self.articles else pa.table({"id": pa.array([], pa.string()), "number": pa.array([], pa.int64()), "name": pa.array([], pa.string()), "at": pa.array([], pa.int64())})
        number = rows["number"].to_numpy()
        known = ~np.asarray(rows["at"].is_null())
        at = rows["at"].fill_null(0).to_numpy()
        order = np.lexsort((number, -at, ~known))  # newest first, those without a time last
        ids, names = rows["id"].to_pylist(), rows["name"].to_pylist()
        self.place, self.codes, numbers, ats, knowns, code, self.more = {}, {}, [], [], [], [], {}
        for i in order.tolist():
            own = -1 if names[i] is None else self.codes.setdefault(names[i], len(self.codes))
            p = self.place.setdefault(ids[i], len(self.place))
            if p < len(code):  # another row of the same id
                if own != code[p]:
                    self.more.setdefault(own, []).append(p)
                continue
            numbers.append(number[i])
            ats.append(at[i])
            knowns.append(known[i])
            code.append(own)
        self.numbers, self.code = np.array(numbers, np.int64), np.array(code, np.int64)
        self.ats, self.known = np.array(ats, np.int64), np.array(knowns, bool)
        self.newest = {}
        for c in self.codes.values():
            own = np.flatnonzero(self.code == c)[: self.most]
            self.newest[c] = np.unique(np.concatenate((own, np.array(sorted(self.more.get(c, [])), np.int64))))[: self.most]
        self.articles = []

    def add_postings(self, batch: pa.RecordBatch) -> None:
        if self.place is None:
            self._order()
        doc = self._coded(batch.column("id"), lambda x: self.place.get(x, -1))
        term = self._coded(batch.column("name"), lambda x: self.terms.setdefault(x, len(self.terms)))
        field, tf, dl = (batch.column(c).to_numpy() for c in ("field", "tf", "dl"))
        mean = np.array([np.nan if m is None else m for m in self.means])[field]
        kept = doc >= 0
        share = tf / (tf + self.k1 * (1 - self.b + self.b * dl / mean))
        place = (term * len(self.means) + field) << 32 | doc  # of a term and field, then of an article
        self.parts.append((place[kept], share[kept]))

    @staticmethod
    def _coded(column: pa.Array, code) -> np.ndarray:
        found = column.dictionary_encode()
        codes = np.array([code(x) for x in found.dictionary.to_pylist()], np.int64)
        return codes[found.indices.to_numpy()]

    def _sort(self) -> None:
        if self.place is None:
            self._order()
        fields = len(self.means)
        place, share = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0))
        self.parts = []
        order = np.argsort(place, kind="stable")
        place, share = place[order], share[order]
        del order
        if len(place):  # postings of one id and term are added up
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            place, share = place[first], np.add.reduceat(share, first)
        list_of, doc = place >> 32, (place & 0xFFFFFFFF).astype(np.int32)
        del place
        self.doc, self.share = doc, share
        self.starts = np.searchsorted(list_of, np.arange(len(self.terms) * fields + 1))
        self.lengths = np.diff(self.starts).reshape(-1, fields).sum(axis=1)
        self.sums = np.zeros((fields, len(self.code)))
        self.sorted = True

    def best(self, category: str | None, terms: list[str], times: list[int], weights: list[list[float | None]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best articles, in order."""
        code = self.codes.get(category, -1) if category is not None else -1
        known = []
        for t, k, own in zip(terms, times, weights):
            number = self.terms.get(t)
            if number is not None:
                self.weights[number] = own
                known.append((number, k))
        if len(known) > MOST_TERMS or any(k > 1 for _, k in known):
            docs, scores = self._every(known)
        else:
            docs, scores = self._parts([number for number, _ in known], code)
        if code >= 0:
            docs.append(self.newest[code])
            scores.append(np.zeros(len(self.newest[code])))
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0)
        doc, score = np.concatenate(docs), np.concatenate(scores)
        if code >= 0:
            score += self._in(code, doc) * self.bonus
        order = np.lexsort((doc, -score))
        doc, score = doc[order], score[order]
        first = np.unique(doc, return_index=True)[1]
        first.sort()
        first = first[: self.most]
        first = first[score[first] > 0]
        return doc[first], score[first]

    def _list(self, number: int, f: int) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.starts[number * len(self.means) + f], self.starts[number * len(self.means) + f + 1]
        weight = self.weights[number][f]
        return (self.doc[a:z], weight * self.share[a:z]) if z > a and weight is not None else (self.doc[:0], self.share[:0])

    def _every(self, known: list[tuple[int, int]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """All articles with any of the terms, scored."""
        touched = []
        for number, k in known:
            for f in range(len(self.means)):
                doc, part = self._list(number, f)
                self.sums[f, doc] += k * part
                touched.append(doc)
        if not touched:
            return [], []
        doc = np.unique(np.concatenate(touched))
        score = np.round(self.sums[:, doc].max(axis=0), 6)
        self.sums[:, doc] = 0.0
        return [doc], [score]

    def _in(self, code: int, doc: np.ndarray) -> np.ndarray:
        same = self.code[doc] == code
        return same | np.isin(doc, self.more[code]) if code in self.more else same

    def _parts(self, numbers: list[int], code: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The best of the articles that have all terms of a part of the question in a field, part by part.

        An article is among the best of the part that it has, or as many as wanted are better there, and
        for them all of it counts that counts here.  Parts recur in many questions, and are answered once.
        """
        docs, scores = [], []
        numbers = sorted(numbers, key=lambda x: (self.lengths[x], x))
        for f in range(len(self.means)):
            found: list[tuple[int, ...]] = [()]
            for number in numbers:
                if not len(self._part(f, (number,)).doc):
                    continue
                for part in list(found):
                    own = self._part(f, (*part, number))
                    if len(own.doc):
                        found.append((*part, number))
                        docs.append(own.best[0])
                        scores.append(own.best[1])
                        if code >= 0 and len(own.doc) > self.most:
                            if code not in own.of:
                                mine = self._in(code, own.doc).nonzero()[0]
                                own.of[code] = self._top(own.doc[mine], own.sums[mine])
                            docs.append(own.of[code][0])
                            scores.append(own.of[code][1])
        return docs, scores

    def _part(self, f: int, numbers: tuple[int, ...]) -> Part:
        held = self.held.get((f, numbers))
        if held is None:
            doc, sums = self._list(numbers[-1], f) if len(numbers) == 1 else self._both(self._part(f, numbers[:-1]), self._part(f, numbers[-1:]))
            held = Part(doc, sums, self._top(doc, sums), {})
            self.size += len(doc) + 50
            if self.size > MOST_HELD:
                self.held, self.size = {}, len(doc) + 50
            self.held[f, numbers] = held
        return held

    @staticmethod
    def _both(a: Part, b: Part) -> tuple[np.ndarray, np.ndarray]:
        few, many = (a, b) if len(a.doc) < len(b.doc) else (b, a)
        if not len(few.doc):
            return few.doc, few.sums
        at = many.doc.searchsorted(few.doc)
        at[at == len(many.doc)] = 0
        same = (many.doc[at] == few.doc).nonzero()[0]
        return few.doc[same], few.sums[same] + many.sums[at[same]]

    def _top(self, doc: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest rounded scores, of equal ones the articles that come first; ``doc`` is in order."""
        score = sums.round(6)  # sums arrive in any order; without the last digits equal articles score equally
        if len(doc) > self.most:
            parted = score.copy()
            parted.partition(len(score) - self.most)
            bar = parted[-self.most]
            high = (score > bar).nonzero()[0]
            high = np.concatenate((high, (score == bar).nonzero()[0][: self.most - len(high)]))
            doc, score = doc[high], score[high]
        return doc, score

    def answers(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if not self.sorted:
            self._sort()
        gids, docs, scores = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("number", "name", "terms", "times", "weights")]
        for gid, category, terms, times, weights in zip(*columns):
            doc, score = self.best(category, terms or [], times or [], weights or [])
            gids.append(np.full(len(doc), gid, np.int64))
            docs.append(doc)
            scores.append(score)
        doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        at = pa.array(self.ats[doc], mask=~self.known[doc]) if len(doc) else pa.array([], pa.int64())
        gid = np.concatenate(gids) if gids else np.zeros(0, np.int64)
        score = np.concatenate(scores) if scores else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(self.numbers[doc] if len(doc) else [], pa.int64()), pa.array(score, pa.float64()), at], ["gid", "number", "score", "publishedAt"])


def ask(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Rows of ROWS, by shard and kind, to rows of FOUND; ``make`` gives an empty shard."""
    number, shard = None, None
    for batch in batches:
        key = batch.column("shard").to_numpy().astype(np.int64) * 4 + batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)]):
            part, kind = batch.slice(a, z - a), int(key[a] % 4)
            if number != key[a] // 4:
                number, shard = key[a] // 4, make()
            if kind == ARTICLE:
                shard.add_articles(part)
            elif kind == POSTING:
                shard.add_postings(part)
            else:
                yield shard.answers(part)
