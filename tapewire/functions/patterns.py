"""Regular expressions for word lists.

A list is written as one prefix tree, ``ac(?:quisition|t)``, and wide forks of the
tree are halved by a look at the next letter.  At each text position the matcher then
makes a few comparisons instead of trying every word, which is about five times
faster than a flat alternation of a hundred words.  The longest word that starts at a
position wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = r"[^\s\S]"
MAX_FORK = 6


def quote(text: str) -> str:
    """Escape everything but letters, digits, blanks and the underscore."""
    return "".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in text)


def word_pattern(words: Iterable[str]) -> str:
    """Pattern matching the longest of the lower-cased ``words`` at a position."""
    root: dict = {}
    for word in {w.lower() for w in words if w}:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def fork(node: dict, letters: list[str]) -> str:
        if len(letters) <= MAX_FORK:
            return "|".join(quote(ch) + render(node[ch]) for ch in letters)
        half = len(letters) // 2
        sides = (letters[:half], letters[half:])
        return "|".join(f"(?=[{''.join(map(quote, side))}])(?:{fork(node, side)})" for side in sides)

    def render(node: dict) -> str:
        letters = sorted(ch for ch in node if ch)
        if not letters:
            return ""
        if len(letters) == 1 and "" not in node:
            return fork(node, letters)
        return f"(?:{fork(node, letters)})" + ("?" if "" in node else "")

    return render(root) if root else NEVER


def collisions(words: Iterable[str]) -> set[str]:
    """The shortest texts in which one word begins inside another: ``net income`` for the
    words ``net income`` and ``income``, ``dealing`` for ``deal`` and ``aling``."""
    words = set(words)
    beginnings: dict[str, list[str]] = {}
    for word in words:
        for n in range(1, len(word) + 1):
            beginnings.setdefault(word[:n], []).append(word)
    found = set()
    for word in words:
        for k in range(1, len(word)):
            tail = word[k:]
            found.update(word[:k] + other for other in beginnings.get(tail, ()))
            if any(tail[:n] in words for n in range(1, len(tail))):
                found.add(word)
    return found


def keyword_flag(words: Iterable[str], *cols: Column) -> Column:
    """True when any word occurs as a substring of any lower-cased column."""
    pattern = word_pattern(words)
    flag = None
    for c in cols:
        hit = F.lower(c).rlike(pattern)
        flag = hit if flag is None else (flag | hit)
    return flag


def token_pattern(terms: Iterable[str]) -> str:
    """Pattern matching any of the terms as a whole token, ignoring case; group 1 is the hit."""
    return r"(?iu)(?<![\p{L}\p{N}])(" + word_pattern(terms) + r")(?![\p{L}\p{N}])"


def once(c: Column) -> Column:
    """The same value, computed exactly once per row.

    A filter on a derived column is normally moved below the projection that makes it,
    with the whole expression copied into the filter.  For text scans that repeats the
    expensive part, so they are made dependent on the partition number, which keeps
    such filters above.  An unused column is still pruned.
    """
    return F.when(F.spark_partition_id() >= 0, c)
