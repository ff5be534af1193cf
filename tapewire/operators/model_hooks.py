"""The one place where Python runs in the data path: calling a model on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_with(df: DataFrame, factory: Callable[[], Scorer], out_schema: str) -> DataFrame:
    """Runs a model over all rows in Arrow batches.

    ``factory`` is called once per task and returns the scorer, so a model is loaded
    once for many batches.  The scorer takes a batch as a pandas frame and returns one
    with the columns of ``out_schema``; it may return any number of rows.  Prepare the
    text with `functions.text.model_input` first, and send only rows that need the
    model (`operators.classify.needs_model`).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for batch in batches:
            if scorer is None:
                scorer = factory()
            yield scorer(batch)

    return df.mapInPandas(run, out_schema)
