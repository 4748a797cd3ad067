"""Folds over each key's rows in order, for rules in which a row's outcome depends on earlier outcomes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_in_order(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]], columns: list[str], result: str) -> DataFrame:
    """Adds what ``step(state, row)`` returns to each row, row by row within its key.

    One shuffle on the keys and a sort that may spill; a task holds one Arrow batch and one key's
    state, so a key of any size needs no more memory than a small one. ``step`` sees ``columns``.
    """
    names = [x.split()[0] for x in result.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {result}"

    def run(batches):
        last, state = None, None
        for batch in batches:
            out = []
            same = list(zip(*[batch[k] for k in keys]))
            for key, row in zip(same, zip(*[batch[c] for c in columns])):
                key = tuple(None if pd.isna(k) else k for k in key)  # null keys are one key
                if key != last:
                    last, state = key, start()
                state, told = step(state, row)
                out.append(told)
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *map(F.asc, order)).mapInPandas(run, schema)
