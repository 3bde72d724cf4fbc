"""Commit history: parsing logs, statistics of contributions, and ranked bullets about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as txt

# Words that make a commit a feature, and those that do not.
FEATURE = r"(?i)\badd(ed|s)?\b|\bimplement(ed|s)?\b|\bcreate(d|s)?\b|\bbuild(s)?\b|\bdevelop(ed)?\b|\bintroduc(e|ed)\b|\bfeature\b|\bnew\b"
NO_FEATURE = r"(?i)\bfix(ed|es)?\b|\brefactor(ed)?\b|\bdocs?\b|\btypo\b|\bupdate\b|\bcleanup\b"
BULLET = "gen_ord int, text string, impact_score double, category string, evidence array<string>"


def _lines(logs: DataFrame) -> DataFrame:
    """repo, pos, line, head, breaks, at: the lines of logs; at: the place of the last line that ended a block, and whether it
    began one."""
    lines = logs.select("repo", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"\r$", "")))
    bar = F.instr("line", "|") > 0
    lines = lines.withColumn("head", bar & (F.size(F.split("line", r"\|", 4)) == 4)).withColumn("breaks", bar | (F.col("line") == ""))
    so_far = Window.partitionBy("repo").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("at", F.last(F.when(F.col("breaks"), F.struct("pos", "head")), ignorenulls=True).over(so_far))


def _head() -> list[Column]:
    fields = F.split("line", r"\|", 4)
    return [F.substr(fields[0], F.lit(1), F.lit(8)).alias("hash"), fields[1].alias("author"), F.timestamp_seconds(fields[2].try_cast("bigint")).alias("date"), fields[3].alias("message")]


def _numstat() -> tuple[Column, list[Column]]:
    """Whether a line is one of numstat, and its insertions and deletions."""
    cells = F.split("line", "\t")
    number = lambda i: F.when(cells[i] == "-", F.lit(0).cast("bigint")).otherwise(cells[i].try_cast("bigint"))
    own = F.col("at.head") & ~F.col("breaks") & (F.size(cells) >= 3)
    return own, [F.coalesce(number(0), F.lit(0)).alias("insertions"), F.coalesce(F.when(number(0).isNotNull(), number(1)), F.lit(0)).alias("deletions")]


def parse_log(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commits (repo, ord, hash, author, date, message, insertions, deletions) and commit_files (repo, ord, hash, pos, path,
    insertions, deletions) from logs (repo, text) of `hash|author|epoch|subject` lines, each with its numstat lines.

    A line with a bar ends the block before it; so does a blank one.
    """
    lines = _lines(logs)
    own, counts = _numstat()
    stats = lines.where(own).select("repo", F.col("at.pos").alias("ord"), (F.col("pos") - F.col("at.pos") - 1).cast("int").alias("pos"), F.split("line", "\t")[2].alias("path"), *counts)
    heads = lines.where("head").select("repo", F.col("pos").alias("ord"), *_head())
    files = stats.join(heads.select("repo", "ord", "hash"), ["repo", "ord"]).select("repo", "ord", "hash", "pos", "path", "insertions", "deletions")
    return counted_commits(logs).drop("n_files"), files


def counted_commits(logs: DataFrame) -> DataFrame:
    """The commits of parse_log(), with n_files: the lines of a commit are counted where they are read, in one pass."""
    own, (insertions, deletions) = _numstat()
    rows = _lines(logs).where(F.col("head") | own).select(
        "repo", F.col("at.pos").alias("ord"), F.when(F.col("head"), F.struct(*_head())).alias("h"), F.when(own, insertions).alias("i"), F.when(own, deletions).alias("d"),
    )
    none = F.lit(0).cast("bigint")
    sums = rows.groupBy("repo", "ord").agg(
        F.first("h", ignorenulls=True).alias("h"), F.coalesce(F.sum("i"), none).alias("insertions"), F.coalesce(F.sum("d"), none).alias("deletions"), F.count("i").alias("n_files"),
    )
    return sums.select("repo", "ord", "h.*", "insertions", "deletions", "n_files")


def newest(commits: DataFrame, most: int) -> DataFrame:
    return commits.orderBy(F.desc("date"), "ord").limit(most)


def by_author(commits: DataFrame, part: str | None) -> DataFrame:
    return commits.where(F.contains(F.lower("author"), F.lit(part.lower()))) if part else commits


def with_files(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    n = commit_files.groupBy("ord").agg(F.count("*").alias("n_files"))
    return commits.join(n, "ord", "left").fillna(0, ["n_files"])


def is_feature(message: Column, n_files: Column, insertions: Column) -> Column:
    return (message.rlike(FEATURE) & ~message.rlike(NO_FEATURE)) | ((n_files >= 5) & (insertions >= 50))


def is_good_message(message: Column) -> Column:
    return (F.length(message) >= 20) & message.rlike(r"^\p{Lu}")


def stats(commits: DataFrame, commit_files: DataFrame, files: DataFrame, author: str | None = None) -> DataFrame:
    """One row of contribution statistics; the categories are those of the whole snapshot (path, language, semantic_category)."""
    own = by_author(commits, author)
    touched = commit_files.join(own.select("ord"), "ord", "left_semi").select("path").distinct()
    sums = own.agg(
        F.count("*").alias("total_commits"), F.coalesce(F.sum("insertions"), F.lit(0)).alias("total_insertions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("total_deletions")
    )
    langs = touched.join(files.select("path", "language"), "path", "left").agg(
        F.count("*").alias("files_touched"), F.array_sort(F.collect_set("language")).alias("languages_used")
    )
    cats = files.agg(*(F.count_if(F.col("semantic_category") == c).alias(n) for c, n in (("breaking", "breaking_changes"), ("additive", "additive_changes"), ("internal", "internal_changes"), ("docs-only", "docs_changes"))))
    return sums.crossJoin(langs).crossJoin(cats)  # one row each


def bullets(of: DataFrame, commits: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Ranked bullets (gen_ord, text, impact_score, category, evidence).

    of: the one row of stats(); commits: with n_files, in the order of `ord`; files: the snapshot.
    """
    counted = commits.agg(F.count("*").alias("n_commits"), F.count_if(is_good_message(F.col("message"))).alias("good"), F.coalesce(F.avg("insertions"), F.lit(0.0)).alias("mean"))
    trees = files.agg(F.count("*").alias("n_files"), F.count_if(F.contains(F.lower("path"), F.lit("test"))).alias("n_tests"))
    row = of.crossJoin(counted).crossJoin(trees)  # one row each
    c, s = F.col, lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    say = lambda *x: F.concat(*map(s, x))
    langs, n_langs = F.array_join(F.slice("languages_used", 1, 3), ", "), F.size("languages_used")
    design = F.array_join(F.array_compact(F.array(
        F.when(c("additive_changes") > 0, say(c("additive_changes"), " new features")), F.when(c("breaking_changes") > 0, say(c("breaking_changes"), " API redesigns")),
    )), ", ")
    rules = [
        (0, n_langs > 0, say("Developed ", name, ", a ", langs, F.when(n_langs > 3, say(" and ", n_langs - 3, " more")).otherwise(""), " project with ", c("files_touched"), " source files and ", txt.thousands(c("total_insertions")), " lines of code"),
         8.0, "technical", [say(c("n_commits"), " commits"), say(c("files_touched"), " files")]),
        (1, (c("breaking_changes") > 0) | (c("additive_changes") > 5), say("Architected and implemented ", design, ", demonstrating strong software design and API development skills"),
         7.5, "technical", [say(c("additive_changes"), " additive changes"), say(c("breaking_changes"), " breaking changes")]),
        (2, c("internal_changes") > 10, say("Improved code quality through ", c("internal_changes"), " internal refactorings, maintaining clean architecture without breaking public APIs"),
         6.5, "technical", [say(c("internal_changes"), " internal changes")]),
        (10, c("total_commits") >= 10, say("Contributed ", c("total_commits"), " commits totaling ", txt.thousands(c("total_insertions")), " additions and ", txt.thousands(c("total_deletions")), " deletions across ", c("files_touched"), " files"),
         6.0, "impact", [say(c("total_commits"), " commits")]),
        (11, c("n_files") >= 20, say("Built comprehensive codebase with ", c("n_files"), " modules demonstrating full-stack development capabilities"), 7.0, "impact", [say(c("n_files"), " files total")]),
        (12, c("n_tests") >= 5, say("Established robust testing practices with ", c("n_tests"), " test files ensuring code quality and reliability"), 6.5, "impact", [say(c("n_tests"), " test files")]),
        (13, c("docs_changes") >= 5, say("Maintained comprehensive documentation with ", c("docs_changes"), " documentation updates improving code maintainability"),
         5.5, "impact", [say(c("docs_changes"), " doc changes")]),
        (20, c("good") >= c("n_commits") * 0.7, F.lit("Followed best practices with clear, descriptive commit messages and structured version control workflow"),
         5.0, "collaboration", [say(c("good"), "/", c("n_commits"), " quality commit messages")]),
        (21, (c("mean") < 100) & (c("n_commits") >= 20), say("Practiced iterative development with ", c("n_commits"), " incremental commits, enabling easy code review and collaboration"),
         5.5, "collaboration", [say("Average ", F.floor("mean"), " LOC per commit")]),
    ]
    made = F.array_compact(F.array(*(
        F.when(test, F.struct(F.lit(i).alias("gen_ord"), words.alias("text"), F.lit(score).alias("impact_score"), F.lit(kind).alias("category"), F.array(*seen).alias("evidence")))
        for i, test, words, score, kind, seen in rules
    )))
    from_stats = row.where("n_commits > 0").select(F.explode(made).alias("b")).select("b.*")
    features = commits.where(is_feature(c("message"), c("n_files"), c("insertions"))).orderBy("ord").limit(3)
    numbered = features.where(F.trim("message") != "").select(
        (F.row_number().over(Window.orderBy("ord")) + 2).alias("gen_ord"),
        say("Implemented ", txt.capitalised(F.trim("message")), ", touching ", c("n_files"), " files with ", c("insertions"), " additions").alias("text"),
        F.lit(7.0).alias("impact_score"), F.lit("technical").alias("category"), F.array("hash").alias("evidence"),
    )
    return from_stats.unionByName(numbered).orderBy(F.desc("impact_score"), "gen_ord")


def formatted(ranked: DataFrame, style: str = "standard", most: int = 5) -> DataFrame:
    """gen_ord, impact_score, text of the first bullets in a style; an unknown style gives no rows."""
    top = ranked.orderBy(F.desc("impact_score"), "gen_ord").limit(most)
    mark = F.lit("• ")
    shown = {
        "standard": F.concat(mark, F.col("text")),
        "concise": F.concat(mark, txt.clipped(F.col("text"))),
        "detailed": F.concat(
            mark, F.col("text"), F.lit("\n  Category: "), F.col("category"), F.lit(" | Impact: "), F.format_string("%.1f", "impact_score"), F.lit("/10"),
            F.when(F.size("evidence") > 0, F.concat(F.lit("\n  Evidence: "), F.array_join(F.slice("evidence", 1, 3), ", "))).otherwise(""), F.lit("\n"),
        ),
    }
    return top.select("gen_ord", "impact_score", shown[style].alias("text")) if style in shown else top.select("gen_ord", "impact_score", "text").limit(0)


def categories(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("category").agg(F.count("*").alias("n"))


def exported(ranked: DataFrame) -> DataFrame:
    """One row: all bullets as a JSON document."""
    whole = F.struct(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("impact_score")).alias("k"), "gen_ord", "text", "impact_score", "category", "evidence"))), lambda b: F.struct(b["text"].alias("text"), b["impact_score"].alias("impact_score"), b["category"].alias("category"), b["evidence"].alias("evidence"))).alias("bullets"),
        F.count("*").alias("total_bullets"), F.array_sort(F.collect_set("category")).alias("categories"),
    )
    return ranked.agg(F.to_json(whole).alias("json"))
