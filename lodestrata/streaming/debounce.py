"""Debounced batches of file events, in batch and as a stream.

A batch closes when nothing has happened for `gap`; a gap that is exactly that long closes it too.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

EVENT = "ts timestamp, path string, event_type string, is_directory boolean"
DEFAULT_GAP, DEFAULT_INTERVAL = 2.0, 1.0


def wanted(events: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Events of files that a watch is about."""
    own = F.array(F.lit(".git"), F.lit(".lodestrata"))
    inside = F.arrays_overlap(paths.parts(F.col("path")), own)
    return events.where(~F.col("is_directory") & ~inside & ~paths.matches(F.col("path"), exclude) & paths.matches(F.col("path"), include))


def batches(events: DataFrame, gap_seconds: float, key: str | None = None, item: str = "path") -> DataFrame:
    """key, batch_start, batch_end, n_events, n_items of bounded events; without a key all form one sequence.

    A single sequence is put in time order by one task; give a key where events are many.
    """
    own = events.withColumn("_k", F.col(key) if key else F.lit(0))
    w = Window.partitionBy("_k").orderBy("ts")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    numbered = own.withColumn("_f", F.when(gap < int(gap_seconds * 1e6), 0).otherwise(1))
    numbered = numbered.withColumn("_b", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("_k", "_b").agg(F.min("ts").alias("batch_start"), F.max("ts").alias("batch_end"), F.count("*").alias("n_events"), F.countDistinct(item).alias("n_items"))
    return out.select(*([F.col("_k").alias(key)] if key else []), "batch_start", "batch_end", "n_events", "n_items")


class Pending:
    """Changed paths that wait until nothing has changed for `gap` seconds, for a watch that looks at names and times.

    Paths stay pending until done() is told of them, so a batch whose action fails is due again, and what changes meanwhile
    is kept for the next batch.
    """

    def __init__(self, gap: float = DEFAULT_GAP, include: list[str] | None = None, exclude: list[str] | None = None):
        self.gap, self.paths, self.last = gap, set(), None
        self.include, self.exclude = ([re.compile(paths.glob(p)) for p in own or []] for own in (include, exclude))
        self.every = include is None

    def is_wanted(self, path: str) -> bool:
        if {".git", ".lodestrata"} & set(path.split("/")):
            return False
        return not any(p.search(path) for p in self.exclude) and (self.every or any(p.search(path) for p in self.include))

    def changed(self, changed_paths, now: float) -> None:
        own = {p for p in changed_paths if self.is_wanted(p)}
        if own:
            self.paths |= own
            self.last = now

    def due(self, now: float) -> list[str]:
        """The paths of the batch that is due, none while changes go on."""
        return sorted(self.paths) if self.paths and now - self.last >= self.gap else []

    def done(self, done_paths) -> None:
        self.paths -= set(done_paths)

    def again(self, now: float) -> None:
        """The batch that was due has failed; it is due after another gap."""
        self.last = now


def stream(events: DataFrame, gap_seconds: float = DEFAULT_GAP, late_seconds: float = 0.0) -> DataFrame:
    """batch_start, paths of a stream of events; a batch comes out once the watermark has passed its end.

    Spark joins events that are exactly a gap apart, so the gap is a microsecond shorter.
    """
    # sessions of a stream need a key; this one is the same for all, in a way that the optimizer does not see
    everything = F.length(F.substr("path", F.lit(1), F.lit(0)))
    session = F.session_window("ts", f"{int(gap_seconds * 1e6) - 1} microseconds")
    return (
        events.withWatermark("ts", f"{int(late_seconds * 1e6)} microseconds").groupBy(everything, session).agg(F.array_sort(F.collect_set("path")).alias("paths"))
        .select(F.col("session_window.start").alias("batch_start"), "paths")
    )


def watch(events: DataFrame, action: Callable[[list[str]], None], checkpoint: str, gap_seconds: float = DEFAULT_GAP, interval_seconds: float = DEFAULT_INTERVAL):
    """Start a query that calls action with the paths of each batch; what fails is tried again from the checkpoint."""

    def each(df: DataFrame, _: int) -> None:
        for r in df.orderBy("batch_start").toLocalIterator():
            action(list(r["paths"]))

    return (
        stream(events, gap_seconds).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{interval_seconds} seconds").foreachBatch(each).start()
    )
