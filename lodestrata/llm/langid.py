"""Language ID by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lowered and counted in hashed 1- to 3-grams of characters.  In how many of the training rows each occurs is
counted over all of them.  Weights are trained on a bounded sample with the follow-the-regularised-leader proximal update
for every coordinate and an elastic net (L1 gives exact zeros, L2 shrinks the rest); one temperature, fitted on sampled rows
that were not trained on, calibrates the scores.

Bound: about SAMPLE rows in all, the same share of it for each language, drawn by hashed keys and texts; each has at most
BUCKETS numbers.  With more than SAMPLE languages only the SAMPLE most frequent ones are learned; rows that repeat are drawn
once.  Only rows with a key, a text and a lang for which `learn` holds give anything to the model.  What texts are familiar
is told by all labelled rows of these languages: their gram counts, and the bounds that their scores set, are sums over all.

Cases: null texts and those without a letter are `und` with score 0; without training rows everything is; with a single
language that language is predicted with score 1.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ending, kept, key_crc, local_table, pick
from .counts import hashed_counts, inverse_frequency, rows_with, weighted

BUCKETS, ORDERS, SAMPLE, EPOCHS = 4096, range(1, 4), 4000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
_LETTER, _NOT_LETTERS = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")
#: Rows from which a language's own bound is read, the share of them under the bound's quantile, and the errors of the
#: mean that a short text is allowed.
LEAST_ROWS, TAIL, ERRORS = 20, 0.01, 3.0
#: Scores are rounded to one over this, so that their numbers can be added up; languages whose sums a task holds at a time.
STEPS, HELD = 4096, 256


def count_grams(text: str | None) -> np.ndarray:
    return hashed_counts(np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32), ORDERS, BUCKETS)


def count_letter_grams(text: str | None) -> np.ndarray:
    """count_grams of the words alone: marks and digits tell nothing about a language."""
    return count_grams(_NOT_LETTERS.sub(" ", text or ""))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Weights of a multinomial logistic regression, one proximal update for each example."""

    def __init__(self, features: int, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the labels are likeliest."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(scores / t)[np.arange(len(labels)), labels] + 1e-12).mean()
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 61))
    return float(min(grid, key=loss))


def train(rows: list[tuple[int, np.ndarray, np.ndarray, bool]], classes: int, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights (features x classes) and temperature from rows of label, buckets, values, and whether it only calibrates."""
    model = Ftrl(BUCKETS, classes)
    own = [r for r in rows if not r[3]] or rows
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(own)):
            model.learn(own[i][1], own[i][2], own[i][0])
    w = model.weights()
    held = [r for r in rows if r[3]]
    scores = np.array([x @ w[at] for _, at, x, _ in held]).reshape(len(held), classes)
    return w, temperature(scores, np.array([r[0] for r in held], int))


def languages(train_docs: DataFrame, sample: int) -> tuple[list[str], dict[str, int]]:
    """The languages that are learned, sorted, and their numbers of rows: at most `sample`, the most frequent ones."""
    totals = train_docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    return sorted(r["lang"] for r in totals), {r["lang"]: r["n"] for r in totals}


def gather(train_docs: DataFrame, sample: int) -> tuple[list[str], list]:
    """Languages, and (language, buckets, counts, calibrates) of the sampled rows."""
    names, rows_of = languages(train_docs, sample)
    if not names:
        return [], []
    share = max(1, sample // len(names))
    rates = local_table(train_docs.sparkSession, [(x, min(1.0, share / rows_of[x]), i) for i, x in enumerate(names)], "lang string, rate double, label int")
    # at most `sample` languages
    drawn = train_docs.join(F.broadcast(rates), "lang").where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0) < F.col("rate"))
    chosen = drawn.dropDuplicates(["label", "doc_id", "text"]).select("label", "text", (F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(5)) == 0).alias("held"))

    def run(batches):
        for batch in batches:
            out = []
            for label, text, held in zip(*(batch.column(i) for i in range(3))):
                c = count_grams(text.as_py())
                at = np.flatnonzero(c)
                out.append((label.as_py(), at.astype(np.uint16).tobytes(), c[at].astype(np.uint32).tobytes(), held.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.bool_()))], ["label", "at", "n", "held"])

    got = chosen.mapInArrow(ending(run), "label int, at binary, n binary, held boolean").collect()
    rows = [(r["label"], np.frombuffer(bytes(r["at"]), np.uint16).astype(np.int64), np.frombuffer(bytes(r["n"]), np.uint32), r["held"]) for r in got]
    # the order in which rows arrive must not matter
    return names, sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the rows that have all three."""
    return pick(docs, "doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null")


def model_of(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE):
    """(languages, idf, weights, temperature) from the rows of docs (doc_id, text, lang) for which learn holds."""
    own = labelled(docs).where((F.lit(True) if learn is None else learn))
    names, rows = gather(own, sample)
    if not rows:
        return [], None, None, 1.0
    n, seen = rows_with(own.select("text"), count_grams, BUCKETS)
    idf = inverse_frequency(n, seen)
    ready = [(label, at, v, held) for label, at, c, held in rows if len(at) for v in [_values(at, c, idf)]]
    w, t = train(ready, len(names))
    return names, idf, w.astype(np.float32), t


def _values(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float64)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def likelihoods(totals: np.ndarray) -> np.ndarray:
    """Log likelihood of each bucket when every language is as frequent as the others, from its counts (languages x buckets)."""
    n = totals.sum(axis=1, keepdims=True)
    return np.log(((totals + 0.5) / (n + 0.5 * totals.shape[1])).mean(axis=0))


def quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """The quantile of values of which there are counts each, as of the values repeated so often."""
    order = np.argsort(values)
    ends = np.cumsum(counts[order])
    at = q * (ends[-1] - 1)
    low, high = (values[order][np.searchsorted(ends, k, "right")] for k in (np.floor(at), np.ceil(at)))
    return float(low + (high - low) * (at - np.floor(at)))


def bounds_of(scores: np.ndarray, labels: np.ndarray, classes: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The least score of each language's texts: as far under a low quantile of its rows as that is under their median.

    A language of few rows takes its least row, and the width of all rows together if that is wider; nothing is rejected
    (-inf) when there are few rows in all.  counts: rows of each score, one if not given.
    """
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    if counts.sum() < LEAST_ROWS:
        return np.full(classes, -np.inf)
    whole = quantile(scores, counts, 0.5) - quantile(scores, counts, TAIL)
    out = np.full(classes, -np.inf)
    order = np.argsort(labels, kind="stable")
    cuts = np.searchsorted(labels[order], np.arange(classes + 1))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        own, n = scores[order[a:b]], counts[order[a:b]]
        if len(own):
            many = n.sum() >= LEAST_ROWS
            low = quantile(own, n, TAIL) if many else own.min()
            out[i] = low - max(quantile(own, n, 0.5) - low, 0.0 if many else whole)
    return out


def gram_totals(rows: DataFrame, classes: int) -> np.ndarray:
    """How often each language's rows (label, text) have each bucket's letter grams, languages x buckets; every row counts."""

    def summed(triples, most: int):
        held: dict[int, np.ndarray] = {}
        for label, c in triples:
            if label in held:
                held[label] += c
                continue
            if len(held) == most:
                yield held
                held = {}
            held[label] = c.copy()
        if held:
            yield held

    def packed(tables):
        for held in tables:
            at = [np.flatnonzero(c).astype(np.uint16) for c in held.values()]
            columns = list(held), [x.tobytes() for x in at], [c[x].tobytes() for x, c in zip(at, held.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["label", "at", "n"])

    def dense(at: bytes, n: bytes) -> np.ndarray:
        c = np.zeros(BUCKETS, np.int64)
        c[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.int64)
        return c

    def count(batches):
        yield from packed(summed(((label.as_py(), count_letter_grams(text.as_py())) for b in batches for label, text in zip(b.column("label"), b.column("text"))), HELD))

    def add(batches):
        # all rows of a language are in one task, next to each other
        yield from packed(summed(((label.as_py(), dense(at.as_py(), n.as_py())) for b in batches for label, at, n in zip(*(b.column(x) for x in ("label", "at", "n")))), 1))

    kinds = "label int, at binary, n binary"
    parts = rows.select("label", "text").mapInArrow(ending(count), kinds)
    out = np.zeros((classes, BUCKETS), np.int64)
    for r in parts.repartition("label").sortWithinPartitions("label").mapInArrow(ending(add), kinds).collect():  # as many as languages
        out[r["label"]] = dense(bytes(r["at"]), bytes(r["n"]))
    return out


def score_counts(rows: DataFrame, totals: np.ndarray, variance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores in 1/STEPS with their allowance, labels, and how many of rows (label, text) have both.  Each row is scored by
    what the others hold, so all of them are held back once."""
    sizes = totals.sum(axis=1)
    rates = ((totals + 0.5) / (sizes[:, None] + 0.5 * BUCKETS)).sum(axis=0)
    shared = rows.sparkSession.sparkContext.broadcast((totals, sizes, rates))

    def run(batches):
        totals, sizes, rates = shared.value
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            for label, text in zip(batch.column("label"), batch.column("text")):
                i, c = label.as_py(), count_letter_grams(text.as_py())
                at = np.flatnonzero(c)
                if not len(at):
                    continue
                c, n = c[at], c.sum()
                own = totals[i, at]
                without = rates[at] - (own + 0.5) / (sizes[i] + 0.5 * BUCKETS) + (own - c + 0.5) / (sizes[i] - n + 0.5 * BUCKETS)
                score = np.log(without / len(totals)) @ c / n + allowance(n, variance)
                key = i, int(np.rint(score * STEPS))
                found[key] = found.get(key, 0) + 1
        if found:
            columns = *zip(*found), tuple(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], ["label", "score", "n"])

    # as many rows as languages have different rounded scores
    got = rows.select("label", "text").mapInArrow(ending(run), "label int, score int, n bigint").groupBy("label", "score").agg(F.sum("n").alias("n")).toArrow()
    score, label, n = (got.column(x).to_numpy() for x in ("score", "label", "n"))
    return score / STEPS, label, n


def familiar_of(docs: DataFrame, sample: int = SAMPLE):
    """(log likelihoods of the buckets, their variance, least score of each language) from all labelled rows of docs, None
    without any; sample: so many languages at most, as of model_of."""
    own = labelled(docs)
    names, _ = languages(own, sample)
    if not names:
        return None
    numbers = local_table(docs.sparkSession, [(x, i) for i, x in enumerate(names)], "lang string, label int")
    rows = own.join(F.broadcast(numbers), "lang").select("label", "text")
    totals = gram_totals(rows, len(names))
    if not totals.any():
        return None
    table = likelihoods(totals)
    share = totals.sum(axis=0) / totals.sum()
    variance = float(share @ table**2 - (share @ table) ** 2)
    scores, labels, counts = score_counts(rows, totals, variance)
    return table.astype(np.float32), variance, bounds_of(scores, labels, len(names), counts)


def allowance(n, variance: float):
    """What the mean over n grams may be under its expectation by chance: a letter gives a gram of each order."""
    return ERRORS * np.sqrt(len(ORDERS) * variance / np.maximum(n, 1))


def language_of(text: str | None, model) -> tuple[int, float]:
    """Position of the likeliest language and its score; -1 without a model or a letter."""
    names, idf, w, t = model
    if not names or not has_letter(text):
        return -1, 0.0
    p = softmax((weighted(count_grams(text), idf) @ w).astype(np.float64) / t)
    i = int(p.argmax())
    return i, float(min(1.0, p[i]))


def known_column(text: Column, model, familiar) -> Column:
    """Whether each whole text reads like the labelled rows of its likeliest language; true if there are none.

    The score is the mean log likelihood of its letter grams under all languages together, so a text in several of them is
    not the less familiar; how many languages there are moves the scores and the bounds alike.
    """

    def run(texts: pa.Array) -> pa.Array:
        kept("languages")
        if not model.value[0] or familiar.value is None:
            return pa.array([True] * len(texts), pa.bool_())
        table, variance, bounds = familiar.value
        out = []
        for x in texts:
            x = x.as_py()
            i, _ = language_of(x, model.value)
            if i < 0:
                out.append(False)
                continue
            c = count_letter_grams(x)
            n = int(c.sum())
            out.append(bool(c @ table / n + allowance(n, variance) >= bounds[i]))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")(text)


def predict_column(text: Column, model) -> Column:
    """struct<lang_pred, score> of each whole text."""
    fields = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]

    def run(texts: pa.Array) -> pa.Array:
        kept("languages")
        langs, scores = [], []
        for x in texts:
            i, score = language_of(x.as_py(), model.value)
            langs.append(UNKNOWN if i < 0 else model.value[0][i])
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=fields)

    return F.arrow_udf(run, "struct<lang_pred: string, score: double>")(text)


def held_out() -> Column:
    """Rows from which nothing is learned."""
    return F.coalesce(F.pmod(key_crc("doc_id"), F.lit(4)) == 2, F.lit(True))


def identify(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang_pred, score: one row for each document."""
    model = docs.sparkSession.sparkContext.broadcast(model_of(docs, learn, sample))
    return pick(docs, "doc_id", "text").select("doc_id", predict_column(F.col("text"), model).alias("p")).select("doc_id", "p.*")
