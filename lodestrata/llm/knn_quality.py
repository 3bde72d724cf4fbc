"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become TF-IDF vectors of hashed byte sequences and a few signs of repetition.  In how many documents each occurs is
counted over all documents.  A truncated singular value decomposition of a bounded sample of labelled rows gives the latent
space; the sample's own latent vectors and labels, a fixed number at most, go to every executor, which multiplies them in
blocks with the vectors of all documents: exact cosines, no index.  The NEIGHBOURS most similar ones vote with weights that
grow with similarity.

Bound: about PER_LABEL labelled rows of each label at most, drawn by hashed keys, are sampled; each has at most BUCKETS
numbers.  Only rows for which `learn` holds give labels.

Cases: null and empty texts, which are similar to nothing, get the share of label 1 among the labels; without labels every
score is 0.5; equal texts get equal scores; of rows that repeat a doc_id one is learned from.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn, key_crc, pick
from .counts import hashed_counts, inverse_frequency, rows_with, weighted

BUCKETS, ORDERS, PER_LABEL, DIMENSIONS, NEIGHBOURS, POWER, BLOCK = 4096, range(1, 4), 1500, 64, 25, 8, 128
RESERVED = 8


def count_terms(text: str | None) -> np.ndarray:
    """Counts of a whole text's byte sequences and of what it says again."""
    raw = (text or "").encode("utf-8", "replace")
    out = hashed_counts(np.frombuffer(raw, np.uint8).astype(np.uint32), ORDERS, BUCKETS, RESERVED)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    again = sum(map(operator.eq, words, words[1:]))
    out[-1] = again
    out[-2] = again if 10 * again > len(words) else 0
    out[-3] = len(lines) - len(set(lines))
    out[-4] = len(words) if len(words) < 20 else 0
    return out


def latent(sample: np.ndarray, dimensions: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors (columns) of sample, by a randomised range finder with power steps."""
    k = min(dimensions, *sample.shape)
    y = sample @ np.random.default_rng(seed).standard_normal((sample.shape[1], min(k + 16, min(sample.shape)))).astype(np.float32)
    for _ in range(3):
        y = sample @ (sample.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    return np.linalg.svd(q.T @ sample, full_matrices=False)[2][:k].T.astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-12)


def vote(cosines: np.ndarray, labels: np.ndarray, prior: float, k: int = NEIGHBOURS) -> np.ndarray:
    """Scores of rows from their cosines with every labelled vector."""
    k = min(k, cosines.shape[1])
    top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    w = np.clip(np.take_along_axis(cosines, top, 1), 0, 1).astype(np.float64) ** POWER
    total = w.sum(axis=1)
    return np.where(total > 1e-12, (w * labels[top]).sum(axis=1) / np.where(total > 1e-12, total, 1), prior).clip(0, 1)


def gather(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int) -> tuple[list, dict]:
    """(label, buckets, counts) of the sampled rows, and how many labelled rows each label has."""
    marked = pick(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learn).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rows = None
    for q in sorted(totals):
        own = drawn(marked.where(F.col("quality") == q), per_label, totals[q])
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return [], {}
    # about 2 * per_label narrow rows
    chosen = docs.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("quality", "text")

    def run(batches):
        for batch in batches:
            out = []
            for q, text in zip(batch.column(0), batch.column(1)):
                c = count_terms(text.as_py())
                at = np.flatnonzero(c)
                out.append((q.as_py(), at.astype(np.uint16).tobytes(), c[at].astype(np.uint32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["q", "at", "n"])

    got = chosen.mapInArrow(run, "q int, at binary, n binary").collect()
    # the order in which rows arrive must not matter
    got = sorted((r["q"], bytes(r["at"]), bytes(r["n"])) for r in got)
    return [(q, np.frombuffer(at, np.uint16), np.frombuffer(n, np.uint32)) for q, at, n in got], totals


def score(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, score: one row for each document."""
    docs = pick(docs, "doc_id", "text")
    sample, totals = gather(docs, labels, F.lit(True) if learn is None else learn, per_label)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not sample:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    n, seen = rows_with(docs.select("text"), count_terms, BUCKETS)
    idf = inverse_frequency(n, seen)
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for row, (_, at, c) in zip(x, sample):
        row[at] = c
    x = weighted(x, idf)
    axes = latent(x, DIMENSIONS)
    own, marks = unit(x @ axes), np.array([s[0] for s in sample], float)
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    model = docs.sparkSession.sparkContext.broadcast((idf, axes, own.T.copy(), marks, prior))

    def run(batches):
        idf, axes, own, marks, prior = model.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for a in range(0, batch.num_rows, BLOCK):
                texts = batch.column(1).slice(a, BLOCK)
                block = np.stack([count_terms(t.as_py()) for t in texts])
                scores[a : a + BLOCK] = vote(unit(weighted(block, idf) @ axes) @ own, marks, prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {kind}, score double")


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(key_crc("doc_id"), F.lit(5)) == 0, F.lit(True))
