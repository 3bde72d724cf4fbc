"""What changed in a file's definitions, and what that means for those who use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_default, parameter_name, parameter_type

DEFINITION = "struct<name: string, type: string, line: int, is_public: boolean, parameters: array<string>, return_type: string>"
CALLABLE = "function", "method"
CATEGORIES = "breaking", "additive", "internal", "docs-only", "unknown"


def _parameters(d: Column) -> Column:
    return F.coalesce(d["parameters"], F.array().cast("array<string>"))


def is_modified(old: Column, new: Column) -> Column:
    same_kind = old["type"].eqNullSafe(new["type"]) & old["is_public"].eqNullSafe(new["is_public"])
    same_signature = old["parameters"].eqNullSafe(new["parameters"]) & old["return_type"].eqNullSafe(new["return_type"])
    return ~same_kind | (old["type"].isin(*CALLABLE) & ~same_signature)


def breaks_callers(old: Column, new: Column) -> Column:
    """Whether a changed signature can break a call: a parameter without default gone, one renamed, retyped or moved, or
    another return type."""
    a, b = _parameters(old), _parameters(new)
    gone = F.exists(F.slice(a, F.size(b) + 1, F.greatest(F.size(a) - F.size(b), F.lit(0))), lambda p: ~has_default(p))
    n = F.least(F.size(a), F.size(b))
    other = lambda x, y: (parameter_name(x) != parameter_name(y)) | F.coalesce(parameter_type(x) != parameter_type(y), F.lit(False))
    moved = F.exists(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), other), lambda t: t)
    r, s = old["return_type"], new["return_type"]
    returns = ~r.eqNullSafe(s) & ((r.isNull() != s.isNull()) | ((r != "") & (s != "")))
    return old["type"].isin(*CALLABLE) & (gone | moved | F.coalesce(returns, F.lit(False)))


def changes(files: DataFrame) -> DataFrame:
    """Changed definitions of files (path, old_definitions, new_definitions).

    Both sides are exploded and meet in one shuffle by path and name; of equal names in a file the last one counts.
    """

    def side(column: str, flag: bool) -> DataFrame:
        return files.select("path", F.posexplode(column).alias("pos", "d")).select("path", F.col("d.name").alias("name"), "pos", "d", F.lit(flag).alias("is_new"))

    both = side("old_definitions", False).unionByName(side("new_definitions", True))
    pick = lambda flag: F.max_by("d", F.when(F.col("is_new") == flag, F.col("pos")))
    met = both.groupBy("path", "name").agg(
        F.when(F.bool_or(~F.col("is_new")), pick(False)).alias("old"), F.when(F.bool_or("is_new"), pick(True)).alias("new")
    )
    old, new = F.col("old"), F.col("new")
    kind = F.when(old.isNull(), "added").when(new.isNull(), "removed").when(is_modified(old, new), "modified")
    return met.withColumn("change_type", kind).where("change_type is not null").select(
        "path", "name", F.coalesce(new["type"], old["type"]).alias("definition_type"), "change_type", old["line"].alias("old_line"), new["line"].alias("new_line"),
        F.coalesce(new["is_public"], old["is_public"]).alias("is_public"),
        ((F.col("change_type") == "modified") & new["is_public"] & breaks_callers(old, new)).alias("is_breaking_signature"),
    )


def classify(files: DataFrame, signatures: bool = True) -> DataFrame:
    """path, category, has_breaking, has_additions, has_removals, description of changed files.

    files: path, old_exists, new_exists, old_ast_hash, new_ast_hash, old_definitions, new_definitions.  Only files that
    exist on both sides and whose structure changed are exploded.  signatures: whether changed signatures can break.
    """
    same = F.coalesce((F.col("old_ast_hash") == F.col("new_ast_hash")) & (F.col("old_ast_hash") != ""), F.lit(False))
    kind = (
        F.when(F.col("old_exists") & F.col("new_exists"), F.when(same, "docs").otherwise("modified"))
        .when(F.col("new_exists"), "created").when(F.col("old_exists"), "deleted").otherwise("none")
    )
    files = files.withColumn("kind", kind)
    flag = lambda t: (F.col("change_type") == t) & F.col("is_public")
    counts = changes(files.where("kind = 'modified'")).groupBy("path").agg(
        F.count_if(flag("removed")).alias("removed"), F.count_if(F.col("is_breaking_signature") & F.lit(signatures)).alias("broken"), F.count_if(flag("added")).alias("added"),
        F.count_if(flag("modified")).alias("modified"), F.count_if(~F.col("is_public")).alias("private"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    defs = lambda c: F.coalesce(F.col(c), F.array().cast(f"array<{DEFINITION}>"))
    size = lambda c: F.size(defs(c))
    public = lambda c: F.size(F.filter(defs(c), lambda d: d["is_public"]))
    part = lambda when, *text: F.when(when, F.concat(*text))
    s = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    told = F.array_compact(F.array(
        part(n("removed") > 0, s("Removed "), s(n("removed")), s(" public API(s)")),
        part(n("broken") > 0, s("Breaking signature changes in "), s(n("broken")), s(" function(s)")),
        part(n("added") > 0, s("Added "), s(n("added")), s(" public API(s)")),
        part(n("modified") > n("broken"), s("Modified "), s(n("modified") - n("broken")), s(" public API(s)")),
        part(n("private") > 0, s(n("private")), s(" internal change(s)")),
    ))
    created = F.concat(s("New file with "), s(size("new_definitions")), s(" definition(s)"), F.when(public("new_definitions") > 0, F.concat(s(" ("), s(public("new_definitions")), s(" public)"))).otherwise(""))
    gone = F.concat(
        s("File deleted with "), s(size("old_definitions")), s(" definition(s)"),
        F.when(public("old_definitions") > 0, F.concat(s(" ("), s(public("old_definitions")), s(" public - BREAKING)"))).otherwise(""),
    )
    k = F.col("kind")
    broken = F.when(k == "deleted", public("old_definitions") > 0).otherwise((k == "modified") & (n("removed") + n("broken") > 0))
    category = (
        F.when(k == "docs", "docs-only").when(k == "created", "additive").when(k == "none", "unknown").when(broken, "breaking")
        .when((k == "modified") & (n("added") > 0), "additive").otherwise("internal")
    )
    description = (
        F.when(k == "docs", "Documentation-only changes (comments, docstrings, whitespace)").when(k == "created", created).when(k == "deleted", gone)
        .when(k == "none", "Unable to classify").when(F.size(told) > 0, F.array_join(told, "; ")).otherwise("No significant changes detected")
    )
    return files.join(counts, "path", "left").select(
        "path", category.alias("category"), broken.alias("has_breaking"), ((k == "created") | (k == "modified") & (n("added") > 0)).alias("has_additions"),
        ((k == "deleted") | (k == "modified") & (n("removed") > 0)).alias("has_removals"), description.alias("description"),
    )


def breaking(changed: DataFrame) -> DataFrame:
    """Public definitions that are gone or differ."""
    return changed.where(F.col("is_public") & F.col("change_type").isin("removed", "modified"))


def additive(changed: DataFrame) -> DataFrame:
    return changed.where("change_type = 'added'")


def summarise(classified: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: files of each category, and definitions added, removed and modified."""
    files = classified.agg(F.count("*").alias("total_files"), *(F.count_if(F.col("category") == c).alias(c.replace("-", "_") + "_files") for c in CATEGORIES))
    defs = changed.agg(*(F.count_if(F.col("change_type") == t).alias(f"total_{n}") for t, n in (("added", "additions"), ("removed", "removals"), ("modified", "modifications"))))
    return files.crossJoin(defs)  # one row each


def listed(classified: DataFrame) -> DataFrame:
    """category, path of the breaking and the additive files, as rows: there may be many."""
    return classified.where(F.col("category").isin("breaking", "additive")).select("category", "path")


def import_impact(classified: DataFrame, edges: DataFrame) -> DataFrame:
    """changed, dependent, impact: what a changed file means for those that import it."""
    at, told = F.col("path"), F.col("description")
    text = (
        F.when(F.col("category") == "breaking", F.concat(F.lit("May be broken by changes in "), at, F.lit(": "), told))
        .when(F.col("category") == "additive", F.concat(F.lit("New APIs available from "), at, F.lit(": "), told))
        .when(F.col("category") == "internal", F.concat(F.lit("Internal changes in "), at, F.lit(" (no API impact expected)")))
        .when(F.col("category") == "docs-only", F.concat(F.lit("Documentation updated in "), at, F.lit(" (no code impact)")))
    )
    return classified.join(edges, classified.path == edges.dst).select(at.alias("changed"), F.col("src").alias("dependent"), text.alias("impact")).where("impact is not null")
