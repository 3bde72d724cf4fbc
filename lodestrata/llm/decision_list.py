"""Quality rules as a learned decision list.

Statistics of whole texts are computed once.  Sequential covering learns, from labelled rows, an ordered list of
conjunctions of thresholds on ratios of these statistics: each rule is grown on two thirds of the rows that no earlier rule
covers (the condition with the best information gain is added while false alarms remain), pruned on the other third by
dropping final conditions, and kept only while it is precise enough there.  The list comes out as one ordered Spark
conditional expression, so applying it needs no Python.

Bound: the rules are learned from about MAX_LABELLED labelled rows at most, drawn by hashed keys, so only these reach the
driver; the statistics and the verdicts cover every row.

Cases: a null text has no words, and so fails the base rules, as an empty one does; without labels of both kinds there are
no learned rules and the base rules alone decide; rows that repeat get the same verdict, and are learned from once.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn, forget, kept, pick, written

MAX_LABELLED, WINDOW, MIN_WORDS, LONG_WORDS = 20_000, 8, 20, 200_000
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_adjacent", "n_upper", "n_digits", "n_bangs"]


def repeated_words(words: list) -> int:
    """Words that lie in a window of WINDOW words which the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) > LONG_WORDS:
        twice = _windows_of_long(words)
    else:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) == n:
            return 0
        count = Counter(windows)
        twice = np.fromiter((count[w] > 1 for w in windows), bool, n)
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + WINDOW, -1)
    return int((np.cumsum(steps) > 0).sum())


def _windows_of_long(words: list) -> np.ndarray:
    """Whether each window occurs twice or more, by ranks of 1, 2, 4 and 8 words: a few arrays as long as the text."""
    number: dict = {}
    ranks = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = 1
    while size < WINDOW:
        pairs = ranks[:-size] * (int(ranks.max()) + 1) + ranks[size:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        size *= 2
    return np.bincount(ranks)[ranks] > 1


def statistics(text: str | None) -> tuple:
    """STATS of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words), len(text or "") - without(BLANKS), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        len(set(words)), sum(map(operator.eq, words, words[1:])), without(UPPER), without(DIGITS), raw.count(b"!"),
    )


def statistics_column(text: Column) -> Column:
    """struct of STATS, all bigint."""
    fields = [pa.field(x, pa.int64()) for x in STATS]

    def run(texts: pa.Array) -> pa.Array:
        kept("quality")
        cols = list(zip(*(statistics(x.as_py()) for x in texts))) or [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=fields)

    return F.arrow_udf(run, f"struct<{', '.join(f'{x}: bigint' for x in STATS)}>")(text)


def ratios(of=F.col) -> dict[str, Column]:
    """What conditions are about, from columns of STATS."""
    words, chars, lines = (F.greatest(of(x), F.lit(1)) for x in ("n_words", "word_chars", "n_lines"))
    return {
        "symbols_a_word": of("n_symbols") / words, "chars_a_word": of("word_chars") / words, "dup_lines": of("n_dup_lines") / lines,
        "repeated_words": of("n_repeat_words") / words, "distinct_words": of("n_distinct") / words, "adjacent_words": of("n_adjacent") / words,
        "upper_chars": of("n_upper") / chars, "digit_chars": of("n_digits") / chars, "bangs_a_word": of("n_bangs") / words, "words_a_line": of("n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return columns[self.name] > self.threshold if self.above else columns[self.name] <= self.threshold

    def expression(self, columns: dict[str, Column]) -> Column:
        return columns[self.name] > F.lit(self.threshold) if self.above else columns[self.name] <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


def covers(rule: list[Condition], columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(columns)
    return out


def _grow(columns: dict, bad: np.ndarray, candidates: list[Condition], most: int) -> list[Condition]:
    rule, inside = [], np.ones(len(bad), bool)
    held = [(c, c.holds(columns)) for c in candidates]
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain, mask = None, 1e-9, inside
        for c, h in held:
            now = inside & h
            p = (now & bad).sum()
            if p:
                n = (now & ~bad).sum()
                g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                if g > gain:
                    best, gain, mask = c, g, now
        if best is None:
            break
        rule.append(best)
        inside = mask
    return rule


def learn(columns: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 3, most: int = 4, cuts: int = 48, rules: int = 24) -> list[list[Condition]]:
    """Ordered rules for bad rows."""
    n = len(bad)
    out: list[list[Condition]] = []
    left = np.ones(n, bool)
    fold = np.arange(n) * 2654435761 % 4294967296 % 3
    while len(out) < rules and (left & bad).any() and (left & ~bad).any():
        candidates = []
        for name, x in columns.items():
            own = np.unique(np.concatenate([np.quantile(x[left & (bad == k)], np.linspace(0, 1, cuts)) for k in (True, False)]))
            for t in (own[:-1] + own[1:]) / 2:
                candidates += [Condition(name, True, float(t)), Condition(name, False, float(t))]
        grow, prune = left & (fold > 0), left & (fold == 0)
        pick_rows = lambda m: {k: v[m] for k, v in columns.items()}
        if not (grow & bad).any():
            break
        rule = _grow(pick_rows(grow), bad[grow], candidates, most)
        if not rule:
            break
        held, held_bad = pick_rows(prune), bad[prune]

        def worth(k: int) -> float:
            c = covers(rule[:k], held, len(held_bad))
            p, m = (c & held_bad).sum(), (c & ~held_bad).sum()
            return (p - m) / (p + m) if p + m else -1.0

        rule = rule[: max(range(len(rule), 0, -1), key=worth)]
        c = covers(rule, held, len(held_bad))
        p, m = (c & held_bad).sum(), (c & ~held_bad).sum()
        inside = covers(rule, columns, n) & left
        hit = (inside & bad).sum()
        # too few rows to judge on the third that was held back: judge on all
        precise = p >= precision * (p + m) if p + m >= least else hit >= precision * inside.sum()
        if hit < least or not precise or hit < precision * inside.sum():
            break
        out.append(rule)
        left &= ~inside
    return out


def expression(rules: list[list[Condition]], columns: dict[str, Column] | None = None) -> Column:
    """The number of the first rule that covers a row, from 1; 0: none does."""
    columns = columns or ratios()
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].expression(columns)
        for c in rule[1:]:
            test = test & c.expression(columns)
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learn_from(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[list[Condition]]:
    """Rules for the documents that labels (doc_id, quality) marks 0, from about `most` labelled rows at most."""
    marked = pick(labels, "doc_id", "quality").where("quality is not null and doc_id is not null").distinct()
    marked = drawn(marked, most, marked.count())
    # about `most` narrow rows; only their documents are read into words
    own = pick(docs, "doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "quality", statistics_column(F.col("text")).alias("s"))
    found = written(own.select("doc_id", "quality", "s.*").distinct())
    columns = ratios()
    rows = drawn(found, most, found.count()).select(F.col("quality").alias("_quality"), *(c.alias(k) for k, c in columns.items())).collect()
    forget(found)
    rows.sort()  # the order in which rows arrive must not matter
    bad = np.array([r["_quality"] == 0 for r in rows], bool)
    return learn({k: np.array([r[k] for r in rows], float) for k in columns}, bad)


def base_failed(of=F.col) -> Column:
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > 30 * of("n_words"))


def judge(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and rule (0: none): one row for each document."""
    rule = expression(learn_from(docs, labels, most))
    stats = pick(docs, "doc_id", "text").select("doc_id", statistics_column(F.col("text")).alias("s")).select("doc_id", "s.*")
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rule.cast("int")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
