"""Columns for phrases, parameters and Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phrase(items: Column) -> Column:
    """`a`, `a and b`, `a, b, and c` from an array; empty for an empty one."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(items, F.lit(-1))
    return F.when(n == 0, F.lit("")).when(n == 1, last).when(n == 2, F.array_join(items, " and ")).otherwise(F.concat(head, F.lit(", and "), last))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def capitalised(text: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def clipped(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most - 3)), F.lit("..."))).otherwise(text)


def parameter_name(p: Column) -> Column:
    """Name of a parameter like `x?: T = v`."""
    return F.regexp_replace(F.trim(F.substring_index(F.substring_index(p, ":", 1), "=", 1)), r"\?+$", "")


def parameter_type(p: Column) -> Column:
    """Type of a parameter, null without one."""
    return F.when(F.instr(p, ":") > 0, F.trim(F.substring_index(F.regexp_replace(p, "^[^:]*:", ""), "=", 1)))


def has_default(p: Column) -> Column:
    return F.instr(p, "=") > 0


def sections(text: Column) -> Column:
    """array<struct<ord, title, content>> of a Markdown text, cut at its level-two headings.

    What stands before the first heading is `_preamble`, left out if blank unless there is no heading; of equal titles the
    last one counts, at the first one's place.
    """
    mark = "\u0001"
    cut = F.split(F.regexp_replace(text, r"(?m)^## (?=.)", mark), mark)
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    made = F.transform(
        cut,
        lambda x, i: F.when(
            i > 0, F.struct(i.alias("ord"), trim(F.substring_index(x, "\n", 1)).alias("title"), F.when(F.instr(x, "\n") > 0, trim(F.regexp_replace(x, r"^[^\n]*\n", ""))).otherwise(F.lit("")).alias("content"))
        ).otherwise(F.struct(i.alias("ord"), F.lit("_preamble").alias("title"), trim(x).alias("content"))),
    )
    filled = F.filter(made, lambda s: (s["title"] != "_preamble") | (s["content"] != "") | (F.size(cut) == 1))
    first = lambda s: F.array_min(F.transform(F.filter(filled, lambda o: o["title"] == s["title"]), lambda o: o["ord"]))
    last = F.filter(filled, lambda s: ~F.exists(filled, lambda o: (o["title"] == s["title"]) & (o["ord"] > s["ord"])))
    return F.array_sort(F.transform(last, lambda s: F.struct(first(s).alias("ord"), s["title"].alias("title"), s["content"].alias("content"))))


def rendered(title: Column, content: Column) -> Column:
    return F.concat(F.lit("## "), title, F.lit("\n\n"), content, F.lit("\n"))
