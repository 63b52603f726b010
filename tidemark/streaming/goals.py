"""Score goals followed over a stream of scores: state for each path, kept by Spark between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(scores: DataFrame, drop: float = 2.0) -> DataFrame:
    """(path, score, previous, status): failed once a score falls by more than drop below the one before it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, failed = state.get if state.exists else (None, False)
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "score"]).itertuples(index=False):
            failed = failed or (last is not None and last - row.score > drop)
            out.append((key[0], row.ts, float(row.score), last, "failed" if failed else "active"))
            last = float(row.score)
        state.update((last, failed))
        yield pd.DataFrame(out, columns=["path", "ts", "score", "previous", "status"])

    return scores.select("path", "ts", "score").groupBy("path").applyInPandasWithState(step, "path string, ts timestamp, score double, previous double, status string", "last double, failed boolean", "append", GroupStateTimeout.NoTimeout)


def follow_batch(scores: DataFrame, path: str = "path", ts: str = "ts", score: str = "score", drop: float = 2.0) -> DataFrame:
    """The same over a table: lag gives the score before, and a running maximum of the drops keeps a failure."""
    w = Window.partitionBy(path).orderBy(ts, score)
    before = F.lag(score).over(w)
    out = scores.select(path, ts, score, before.alias("previous"))
    fell = F.coalesce((F.col("previous") - F.col(score) > drop).cast("int"), F.lit(0))
    return out.withColumn("status", F.when(F.max(fell).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1, "failed").otherwise("active"))
