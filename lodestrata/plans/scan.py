"""A whole scan: listing, hashes, differences, parsing of what changed, categories and the import graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, paths
from ..operators import definitions, graph, snapshot
from ..operators.graph import cut
from ..sources import state, tree
from ..sources.config import Config


@dataclass
class Scan:
    changes: DataFrame  # a row for each path in either snapshot
    files: DataFrame  # the new snapshot
    edges: DataFrame
    summary: DataFrame


def scan(spark: SparkSession, root: str, old: DataFrame | None = None, settings: Config | None = None) -> Scan:
    """What root holds now, compared with the snapshot `old`.  Only added and modified files are parsed."""
    settings = settings or Config()
    listed = tree.listing(spark, root).where(settings.scanned(F.col("path")))
    return scan_files(tree.contents(tree.source_files(listed).repartition("path"), root), old, settings)


def scan_files(raw: DataFrame, old: DataFrame | None = None, settings: Config | None = None) -> Scan:
    """The same from files (path, content); those with null content are there but can't be read."""
    settings = settings or Config()
    parsing, graphing = settings.ast_parsing, settings.dependency_analysis
    old = raw.sparkSession.createDataFrame([], state.SNAPSHOT) if old is None else old
    raw = raw.select("path", paths.parts(F.col("path")).alias("path_parts"), paths.language(F.col("path")).alias("language"), "content")
    raw = raw.withColumn("hash", snapshot.content_hash(F.col("content")))
    before = old.select("path", *(F.col(c).alias(f"old_{c}") for c in ("hash", "language", "ast_hash", "definitions", "imports", "semantic_category")))
    met = raw.join(before, "path", "full_outer")
    # a file that is there but can't be read is neither deleted nor kept
    met = met.where(F.col("path_parts").isNull() | F.col("content").isNotNull())
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("hash").isNull(), "deleted").when(F.col("hash") != F.col("old_hash"), "modified").otherwise("unchanged")
    met = met.withColumn("change_type", kind)
    again = met.withColumn("content", F.when(F.col("change_type").isin("added", "modified") & settings.parsed(F.col("path"), F.col("language")), F.col("content")))
    full = cut(parse.parsed(again, "content", parsing.strict).drop("content"))
    kept = F.col("change_type") == "unchanged"
    new = lambda c: F.when(kept, F.col(f"old_{c}")).otherwise(F.col(c))
    rows = full.select(
        "path", F.coalesce("language", "old_language").alias("language"), "change_type", F.coalesce("hash", "old_hash", F.lit("")).alias("hash"), new("ast_hash").alias("ast_hash"),
        new("definitions").alias("definitions"), new("imports").alias("imports"), "old_ast_hash", "old_definitions", "old_semantic_category",
    )
    judged = rows.where(
        (F.col("change_type").isin("added", "modified") & F.col("ast_hash").isNotNull()) | ((F.col("change_type") == "deleted") & (F.size("old_definitions") > 0))
    ).where(F.lit(settings.semantic_analysis.enabled and settings.semantic_analysis.classify_changes)).select(
        "path", (F.col("change_type") != "added").alias("old_exists"), (F.col("change_type") != "deleted").alias("new_exists"), "old_ast_hash", F.col("ast_hash").alias("new_ast_hash"),
        "old_definitions", F.col("definitions").alias("new_definitions"),
    )
    told = definitions.classify(judged).select("path", F.col("category").alias("semantic_category"), "description")
    changes = rows.join(told, "path", "left").select("path", "language", "hash", "ast_hash", "definitions", "imports", "change_type", "semantic_category", "description")
    changes = cut(changes.withColumn("last_modified", F.current_timestamp()))
    files = snapshot.apply(changes)
    nodes = files.where(F.lit(graphing.enabled)).select("path", F.coalesce("imports", F.array().cast("array<string>")).alias("imports"), "language")
    edges = graph.edges_of(graph.resolve(nodes, graphing.ordered))
    return Scan(changes, files, cut(edges), snapshot.summary(changes))
