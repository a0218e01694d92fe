"""Tables that are asked for more than once: computed once, without the plan that made them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The table, computed now: checkpointed where the session names a checkpoint folder, which cuts its plan and survives lost executors, else cached."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    out = df.persist()
    out.count()
    return out


def released(*frames: DataFrame | None) -> None:
    """Frees tables that nothing reads any more."""
    for df in frames:
        if df is not None:
            df.unpersist()
