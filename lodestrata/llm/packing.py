"""Packing token runs into sequences by minimum bin slack.

A document of n tokens gives n // capacity whole sequences and one rest.  Only the rests need packing, and they have at
most capacity - 1 different lengths, so the packer works on a histogram of lengths, whose size does not grow with the
data.  For each window it takes the longest rest that remains and lets a bitset subset-sum over the other remaining
lengths (with their counts, in powers of two) find the multiset that fills the window closest to its capacity; the counts
are read back through the saved bitsets.  One such multiset is used as often as the counts allow, so the number of
windows solved is bounded by the number of lengths.  Documents are then dealt to the slots of their length by rank: the
rank is a running number inside the input partition plus the total of the partitions before it, so no key is gathered.

Cases: a null or empty text is one token (the closing id); repeated rows and equal ids are packed as rows of their own.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import ending, local_table, pick, written

CAPACITY, CLOSING_ID = 2048, 1
#: Runs of which a worker keeps the ids; others are looked up anew for every few MB of texts.
KEPT_RUNS = 200_000
_TOKENISED = "doc_id {kind}, part int, full_before bigint, doc_tokens bigint, rest int, rest_rank bigint, crcs array<bigint>"


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths that fills capacity most, given how many of each length remain; it has the longest one."""
    first = max(counts)
    target = capacity - first
    steps, masks, mask = [], [1], 1
    limit = (1 << (target + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), target // length)
        times = 1
        while left > 0:
            take = min(times, left)
            new = (mask | mask << (length * take)) & limit
            if new != mask:
                steps.append((length, take))
                masks.append(new)
                mask = new
            left -= take
            times *= 2
        if mask >> target & 1:
            break
    at = mask.bit_length() - 1
    used = {first: 1}
    for (length, take), before in zip(reversed(steps), reversed(masks[:-1])):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, how many sequences use it), until every length of the histogram is used up."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while counts:
        used = fill_window(counts, capacity)
        repeats = min(counts[k] // n for k, n in used.items())
        out.append((used, repeats))
        for k, n in used.items():
            counts[k] -= n * repeats
            if not counts[k]:
                del counts[k]
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> tuple[list[tuple], int]:
    """(length, first rank, last rank, first sequence, uses in a sequence, first offset) for each use, and sequences."""
    rows, ranks, sequence = [], {}, 0
    for used, repeats in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            n, low = used[length], ranks.get(length, 0)
            rows.append((length, low, low + n * repeats - 1, sequence, n, offset))
            ranks[length] = low + n * repeats
            offset += n * length
        sequence += repeats
    return rows, sequence


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """A row for each document: its tokens, the crc32 of each piece, and its running numbers inside its partition."""
    from pyspark import TaskContext

    docs = pick(docs, "doc_id", "text")
    schema = _TOKENISED.format(kind=docs.schema["doc_id"].dataType.simpleString())
    closing, step = closing_id.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        e, part, full, ranks = encoder(path, cache_entries=KEPT_RUNS, half=0), TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            rows = []
            for packed in e.encode_many(batch.column(1)):
                ids = packed + closing
                n = len(ids) // 4
                rest = n % capacity
                rank = ranks.get(rest, 0)
                ranks[rest] = rank + 1
                rows.append((full, n, rest, rank, [zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)]))
                full += n // capacity
            if rows:
                cols = list(zip(*rows))
                kinds = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())
                arrays = [batch.column(0), pa.array([part] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(cols, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "full_before", "doc_tokens", "rest", "rest_rank", "crcs"])

    return docs.mapInArrow(ending(run), schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of each document."""
    spark = docs.sparkSession
    base = written(tokenised(docs, path, capacity, closing_id))
    # at most `capacity` lengths come to the driver, however many documents there are
    histogram = {r["rest"]: r["n"] for r in base.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    rows, sequences = slots(plan_windows(histogram, capacity))
    table = local_table(spark, rows, "rest int, low bigint, high bigint, first_sequence bigint, uses bigint, first_offset bigint")
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_rest = (
        base.where("rest > 0").groupBy("rest", "part").agg(F.count("*").alias("n"))
        .select("rest", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
    )
    rest = (
        base.where("rest > 0").join(by_rest, ["rest", "part"])
        .withColumn("rank", F.col("rank_before") + F.col("rest_rank"))
        .join(F.broadcast(table.withColumnRenamed("rest", "r")), (F.col("rest") == F.col("r")) & F.col("rank").between(F.col("low"), F.col("high")))
        .withColumn("x", F.col("rank") - F.col("low"))
        .select(
            "doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").cast("bigint").alias("length"),
            F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens",
            (F.col("first_sequence") + F.floor(F.col("x") / F.col("uses"))).cast("bigint").alias("sequence_id"),
            (F.col("first_offset") + F.pmod("x", "uses") * F.col("rest")).cast("bigint").alias("offset"),
        )
    )
    # one row a partition: as many as the input has partitions
    totals = base.where(F.col("doc_tokens") >= capacity).groupBy("part").agg(F.sum(F.floor(F.col("doc_tokens") / capacity)).alias("n"))
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = totals.select("part", F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("full_part"))
    full = (
        base.where(F.col("doc_tokens") >= capacity).join(F.broadcast(by_part), "part")
        .select("doc_id", "doc_tokens", "full_part", "full_before", F.posexplode(F.slice("crcs", F.lit(1), F.floor(F.col("doc_tokens") / capacity).cast("int"))).alias("i", "ids_crc32"))
        .select(
            "doc_id", (F.col("i") * F.lit(capacity)).cast("bigint").alias("start"), F.lit(capacity).cast("bigint").alias("length"), "ids_crc32", "doc_tokens",
            (F.lit(sequences) + F.col("full_part") + F.col("full_before") + F.col("i")).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        )
    )
    return rest.unionByName(full)
