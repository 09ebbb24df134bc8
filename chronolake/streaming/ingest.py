from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reads
from ..shared import scratch
from ..sources.files import Files
from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, order: str = "op_order") -> StreamingQuery:
    """Every micro-batch of (user_key, type, value, order) becomes one atomic batch, in the given order, which must be total in a batch.

    The commit itself names the stream, by the id that its checkpoint keeps, and the micro-batch: one that was committed before a failure
    is not applied again, and streams with checkpoints of their own do not meet.
    """
    place = Files(stream.sparkSession, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        name = json.loads(place.read("metadata").decode())["id"]
        store.refresh()
        if number <= store.streams.get(name, -1):
            return
        with scratch(batch.sparkSession):
            ops = reads.positions(batch.select("user_key", "type", "value", F.col(order).alias("_order")), [F.col("_order")])
            store.write_ops(ops.select((F.col("pos") - 1).alias("op_idx"), "user_key", "type", "value"), streams={name: number})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def latest_view(stream: DataFrame) -> DataFrame:
    """The newest version of each key, in update mode: late operations with older numbers never win."""
    return stream.groupBy("user_key").agg(F.max_by(F.struct("seq", "type", "value"), "seq").alias("v")).select("user_key", "v.seq", "v.type", "v.value")
