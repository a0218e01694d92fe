"""A stream of generator insertions and removals that keeps a mesh up to date.

The stream has (op, id, coords): op is ``insert`` or ``remove``. Each micro-batch is
one transaction: removals first, then insertions. With a store, the mesh after each
batch is written as a version of the batch's number, and a query that starts again
begins from the latest one: batches that it holds are left out, others are applied,
whatever the checkpoint says. Without, the mesh lives in the driver only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import VoronoiMesh
from ..operators.state import settled
from ..sources import store

SCHEMA = "op STRING, id BIGINT, coords ARRAY<DOUBLE>"


def apply_batch(mesh: VoronoiMesh, batch: DataFrame) -> None:
    batch = settled(batch)
    gone = batch.filter("op = 'remove'").select("id").distinct()
    if not gone.isEmpty():
        mesh.remove(gone)
    new = batch.filter("op = 'insert'").dropDuplicates(["id"])
    if not new.isEmpty():
        missing = [c for c in mesh.nodes.columns if c not in ("id", "coords")]
        kinds = dict(mesh.nodes.dtypes)
        fill = {"active": F.lit(True), "kind": F.lit("visible")}
        mesh.refine(new.select("id", "coords", *[fill.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in missing]))


class Followed:
    """A mesh that a stream moves; ``mesh`` is its state after the batches so far."""

    def __init__(self, mesh: VoronoiMesh, path: str | None = None):
        self.mesh, self.path, self.last = mesh, path, -1
        spark = mesh.nodes.sparkSession
        if path is not None and store.versions(spark, path):
            self.last, self.mesh = store.read_mesh(spark, path)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        apply_batch(self.mesh, batch)
        if self.path is not None:
            spark = batch.sparkSession
            store.write_mesh(self.mesh, self.path, batch_id)
            # The next batch starts from the written tables, so plans don't grow.
            _, self.mesh = store.read_mesh(spark, self.path, batch_id)
            store.drop_before(spark, self.path, batch_id - 1)
        self.last = batch_id


def follow(mesh: VoronoiMesh, stream: DataFrame, checkpoint: str, path: str | None = None) -> StreamingQuery:
    """Starts the query. Without a store path ``mesh`` itself is moved; with one, query.followed.mesh is the mesh."""
    state = Followed(mesh, path)
    query = stream.writeStream.foreachBatch(state.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.followed = state
    return query
