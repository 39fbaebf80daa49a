"""The trailing count as a stream: per entity, rows of the last hour, with late rows cut by a watermark.

Structured Streaming counterparts of the batch features that an online gate needs first: tumbling and sliding counts per
entity (native, with watermark), and the exact trailing count per row (state: the times of the last hour, per entity).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, entity: str = "client_id", time: str = "date", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows and amounts per entity and window; rows later than the watermark are dropped by the engine."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, late).groupBy(entity, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return out.select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "amount")


def _advance(seconds: int, late: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = np.array(state.get[0] if state.exists else [], np.int64)
        rows = pd.concat(list(batches)).sort_values(["tsec", "id"])
        t = rows["tsec"].to_numpy(np.int64)
        before = np.searchsorted(kept, t, "right") - np.searchsorted(kept, t - seconds)
        now = np.arange(1, len(t) + 1) - np.searchsorted(t, t - seconds)
        times = np.sort(np.concatenate([kept, t]))
        last = int(times[-1])
        state.update((times[times >= last - seconds - late].tolist(),))
        state.setTimeoutTimestamp(max((last + seconds + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": rows["id"], "entity": key[0], "trailing": before + now})

    return run


def trailing_counts(events: DataFrame, entity: str = "client_id", seconds: int = 3600, late: int = 600) -> DataFrame:
    """``id, entity, trailing`` of each new row (``id``, ``tsec`` and the entity: long).

    Rows may come up to ``late`` seconds behind the newest row of the stream; the engine drops later ones, by the watermark
    that it had a batch before, so a row may still be counted in the batch after. A late row counts
    the rows up to its own time; counts given before aren't revised. State holds ``seconds + late`` seconds of times per entity
    and goes when the watermark has passed an entity's last row by ``seconds``, as no later row can count it any more.
    """
    return (
        events.select(F.col(entity).alias("entity"), "id", "tsec", F.timestamp_seconds("tsec").alias("at"))
        .withWatermark("at", f"{late} seconds")
        .groupBy("entity")
        .applyInPandasWithState(_advance(seconds, late), "id long, entity long, trailing long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    )
