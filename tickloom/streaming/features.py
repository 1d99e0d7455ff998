"""Registered features over a stream of candles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions import registry

#: The time of rows that have none, and of symbols without rows.
NEVER = -(2**63)


def updates(candles: DataFrame, definitions: Sequence[tuple | registry.Chosen]) -> DataFrame:
    """symbol, timestamp, late, and the features' columns: one row for each candle of the stream.

    A symbol's state is its newest time and what each feature holds, whatever the history. Candles have passed the checks
    (`quality.clean`). Within a batch they are taken in order of time; one that is not newer than all that were taken,
    or has no time, is late: it changes nothing and has no values. A checkpoint belongs to its features and their order.

    A symbol's candles of one batch meet in one task, in order; the source's limit of files or rows bounds a batch. For
    a long history take `registry.compute`.
    """
    picked = registry.chosen(definitions)
    unable = [one.definition.name for one in picked if one.definition.step is None or one.definition.columns is None]
    if unable:
        raise ValueError(f"no step or columns for a stream: {', '.join(unable)}")
    names = [to for one in picked for to in one.columns.values()]
    parts = [(one.definition.step, one.parameters, one.definition.start, len(one.columns)) for one in picked]
    fields = [T.StructField("newest", T.LongType())]
    for k, one in enumerate(picked):
        held = T.StructType.fromDDL(one.definition.state).fields if one.definition.state else []
        fields += [T.StructField(f"f{k}_{f.name}", f.dataType) for f in held]
    made = ["symbol", "timestamp", "late", *names]
    schema = T.StructType([candles.schema["symbol"], candles.schema["timestamp"], T.StructField("late", T.BooleanType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat = list(state.get) if state.exists else [NEVER, *(x for _, _, start, _ in parts for x in start)]
        newest, at, held = flat[0], 1, []
        for _, _, start, _ in parts:
            held.append(tuple(flat[at : at + len(start)]))
            at += len(start)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["at_micros", "close_price"], kind="stable")
        out = []
        for candle in rows.itertuples(index=False):
            late = candle.at_micros <= newest
            values = []
            for k, (step, parameters, _, width) in enumerate(parts):
                if late:
                    values += [None] * width
                else:
                    held[k], own = step(parameters, held[k], candle)
                    values += own
            newest = max(newest, candle.at_micros)
            out.append((key[0], candle.timestamp, late, *values))
        state.update((int(newest), *(x for one in held for x in one)))
        yield pd.DataFrame(out, columns=made)

    timed = candles.withColumn("at_micros", F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(NEVER)))
    return timed.groupBy("symbol").applyInPandasWithState(run, schema, T.StructType(fields), "append", GroupStateTimeout.NoTimeout)
