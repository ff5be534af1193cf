"""Token counts: Arrow batches of texts in, lengths out.

Texts longer than ``piece_bytes`` are cut where no token can cross, pieces are gathered into
batches of about ``batch_bytes``, and only the number of ids leaves the function.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A single space between two characters that are not white space: a word with its space begins here.
WORD_START = re.compile(r"(?<=\S) (?=\S)")
MARKER = "▁"


class Lengths:
    """Lengths of batches of texts for one vocabulary file.

    ``tokenizers`` reads ``.json``, ``sentencepiece`` reads ``.model``.  ``cut`` is the number of
    characters dropped at a cut (sentencepiece puts the word marker there by itself), or None
    where no place is known to be safe; such texts stay whole.
    """

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch: Callable[[list[str]], list[int]] = lambda texts: [
                len(ids) for ids in model.encode(texts, num_threads=1)
            ]
            inner = any(MARKER in model.id_to_piece(i).lstrip(MARKER) for i in range(model.get_piece_size()))
            prefixed = model.encode("a", out_type=str)[0].startswith(MARKER)
            self.cut = 1 if prefixed and not inner else None
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.batch = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            # Both kinds of pattern end a match before a space that follows a character, and decide
            # what follows without looking back.
            kinds = str(tokenizer.pre_tokenizer)
            self.cut = 0 if "ByteLevel" in kinds and "add_prefix_space=False" in kinds else None

    def pieces(self, text: str, size: int) -> Iterator[str]:
        """Parts of ``text``, each of ``size`` characters and the rest of a word, that tokenise alone."""
        at = 0
        while self.cut is not None and len(text) - at > size:
            found = WORD_START.search(text, at + size)
            if found is None:
                break
            yield text[at : found.start()]
            at = found.start() + self.cut
        yield text[at:] if at else text


@functools.cache
def lengths(path: str) -> Lengths:
    return Lengths(path)


def _counts(texts: list[str], path: str, piece: int, limit: int) -> np.ndarray:
    model = lengths(path)
    counts = np.zeros(len(texts), np.int64)
    rows: list[int] = []
    batch: list[str] = []
    held = 0

    def flush() -> None:
        nonlocal held
        np.add.at(counts, rows, model.batch(batch))
        rows.clear(), batch.clear()
        held = 0

    for row, text in enumerate(texts):
        for part in model.pieces(text, piece):
            if batch and held + len(part) > limit:
                flush()
            rows.append(row)
            batch.append(part)
            held += len(part)
    if batch:
        flush()
    return counts


def count_tokens(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece_bytes: int = 1 << 15,
    batch_bytes: int = 1 << 19,
) -> DataFrame:
    """The id, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row.

    Tokens are those of the library without added special tokens; special strings inside a text
    count as the library's default has it.  Null and empty texts have 0.  Every row is answered
    for itself, so repeated rows repeat and a null id stays null.  ``path`` is a vocabulary file
    present on every executor.  Other columns are ignored, whatever their names.
    """
    kind = df.schema[id_col].dataType
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in _slices(rows, batch_bytes * 8):
                values = part.column("text")
                counts = _counts(values.to_pylist(), path, piece_bytes, batch_bytes)
                sizes = pa.compute.binary_length(values.cast(pa.binary())).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, pa.array(counts)], names=["id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401  for pa.compute in the tasks

    out = texts.mapInArrow(run, f"id {kind.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)


def _slices(rows: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of text, so that few texts are Python strings at once."""
    start = held = 0
    for i, n in enumerate(rows.column("text").to_pandas().str.len().to_numpy() if rows.num_rows else []):
        held += int(n)
        if held >= size:
            yield rows.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < rows.num_rows:
        yield rows.slice(start)
