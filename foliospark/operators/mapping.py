"""Columns of an imported list to the fields that they hold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def propose(pairs: DataFrame, batch: str, column: str, target: str, score: str) -> DataFrame:
    """A one-to-one choice within each ``batch``: the best score first, each column and each target once.

    Ties go to the smaller column, then the smaller target. A batch is one list, whose number of columns bounds the
    group; batches are dealt over all tasks. Returns batch, column, target, score.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        columns, targets, chosen = set(), set(), []
        for row in pdf.sort_values([score, column, target], ascending=[False, True, True]).itertuples(index=False):
            if getattr(row, column) in columns or getattr(row, target) in targets:
                continue
            columns.add(getattr(row, column))
            targets.add(getattr(row, target))
            chosen.append(row)
        return pd.DataFrame(chosen, columns=pdf.columns)

    own = pairs.select(batch, column, target, score)
    return own.groupBy(batch).applyInPandas(walk, own.schema)
