"""Folds over each key's ordered rows, in slices of bounded size.

A key's rows are a sequence by definition, so they pass through one task, sorted, batch by batch, with the state that the batch before
left; the task never holds more than a batch of them. Keys go on in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

#: Rows of a key in one frame.
SLICE = 50_000

Fold = Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]]


def _stepwise(fold: Fold, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    out = []
    for at in range(0, len(rows), SLICE):
        state, part = fold(state, rows.iloc[at : at + SLICE])
        out.append(part)
    return state, pd.concat(out, ignore_index=True) if out else pd.DataFrame()


def folded(df: DataFrame, key: str, order: list[str], values: list[str], fold: Fold, start: tuple, schema: str) -> DataFrame:
    """key, ``order`` and what ``fold`` gives for each row. ``fold(state, rows)`` returns the next state and a frame of ``schema``.

    Rows of a key arrive sorted, in Arrow batches, so that a key of any length passes through a worker slice by slice.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    columns = [key, *order]

    def run(batches):  # noqa: ANN001, ANN202
        current, state, seen = None, start, False
        for pdf in batches:
            out = []
            changes = pdf[key].ne(pdf[key].shift()).cumsum() if len(pdf) else []
            for _, rows in pdf.groupby(changes, sort=False) if len(pdf) else ():
                k = rows[key].iloc[0]
                if not seen or not (k == current or (pd.isna(k) and pd.isna(current))):
                    current, state, seen = k, start, True
                state, part = _stepwise(fold, state, rows)
                part.index = rows.index
                out.append(pd.concat([rows[columns], part[names]], axis=1))
            if out:
                yield pd.concat(out)

    sorted_rows = df.select(*columns, *[v for v in values if v not in columns]).repartition(key).sortWithinPartitions(*columns)
    return sorted_rows.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), schema]))


def folded_stream(df: DataFrame, key: str, order: list[str], values: list[str], fold: Fold, start: tuple, schema: str, state_schema: str) -> DataFrame:
    """``folded`` on a stream: the state is kept between batches."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    columns = [key, *order]

    def run(_, batches, state):  # noqa: ANN001, ANN202
        rows = pd.concat(list(batches)).sort_values(order).reset_index(drop=True)
        after, out = _stepwise(fold, tuple(state.get) if state.exists else start, rows)
        state.update(after)
        yield pd.concat([rows[columns], out[names]], axis=1)

    narrow = df.select(*columns, *[v for v in values if v not in columns])
    return narrow.groupBy(key).applyInPandasWithState(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), schema]), state_schema, "append", GroupStateTimeout.NoTimeout)
