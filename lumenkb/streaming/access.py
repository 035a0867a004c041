"""Continuous forms of stateful operators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from lumenkb.operators.sync import apply_changes, changes
from lumenkb.session import ship_code


def access_counts(events: DataFrame, key: str, gap: int = 60) -> DataFrame:
    """``key``, access_count, last_access of a stream of ``key`` and ts (seconds), updated with each batch.

    Events that come before the last one counted, also late ones, are not counted, as in a batch over their arrival.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        for t in sorted(int(x) for pdf in batches for x in pdf["ts"]):
            if last is None or t - last >= gap:
                n, last = n + 1, t
        state.update((n, last))
        yield pd.DataFrame({key: [k[0]], "access_count": [n], "last_access": [last]})

    ship_code(events.sparkSession)
    kind = dict(events.dtypes)[key]
    return events.select(key, "ts").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, access_count long, last_access long", "n long, last long", "update", GroupStateTimeout.NoTimeout)


def snapshot_writer(target: str, key: str = "path"):
    """For ``foreachBatch``: each batch is a whole state (key, content_hash, mtime, more); what changed is merged into a new snapshot folder.

    Snapshots are numbered by batch and written whole before the next one reads them, so a batch that is run again
    after a failure overwrites its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            batch.write.mode("overwrite").parquet(f"{target}/{number}")
            return
        old = spark.read.parquet(f"{target}/{number - 1}")
        state = changes(old, batch, key)
        new = batch.join(state.where("state in ('added', 'modified')").select(key), key, "left_semi")
        apply_changes(old, new, key, state.where("state = 'deleted'")).write.mode("overwrite").parquet(f"{target}/{number}")

    return write
