"""Contiguous shards of nearly equal bytes, from prefix sums.

Narrow rows (key, size, checksum; never the text) are put in key order by range partitions.  Each partition numbers its
rows and sums their sizes as they stream by; the partitions' totals (one row each) give every partition its start, and a
row falls into the shard in whose equal share of all bytes its first byte lies.

Order: doc_id (null first), then checksum and size; rows that agree in all three are alike and may change places.  Law:
"bytes", so grown_shard is null.  A null text has 0 bytes and the checksum 0 of no bytes.  An empty table gives no rows.
With fewer rows than shards, or one row larger than a share, some shards stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

SHARDS, ROW_BYTES = 40, 16


def numbered(rows: DataFrame) -> DataFrame:
    """rows with part, in_part and bytes_before: their partition, place in it, and the sum of `size` before them in it."""
    from pyspark import TaskContext

    def run(batches):
        part, at, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if n:
                sizes = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(sizes) + total
                more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(ends - sizes)]
                at, total = at + n, int(ends[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "in_part", "bytes_before"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, part int, in_part bigint, bytes_before bigint")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each document."""
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(row_bytes)).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    # `place` splits a key that a large part of the rows has over several ranges
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_crc32", "size", "place"]
    rows = written(rows)
    placed = written(numbered(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("place")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    starts = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_bytes"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_rows"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    # one row for each range partition, as many as spark.sql.shuffle.partitions
    cut = (
        placed.join(F.broadcast(starts), "part")
        .withColumn("at", F.col("part_rows") + F.col("in_part"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast(((part_bytes + bytes_before) * {shards}) div all_bytes as int)")))
    )
    firsts = cut.groupBy("shard").agg(F.min("at").alias("first_at"))  # one row for each shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first_at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
