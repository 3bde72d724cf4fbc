"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Words are runs without ASCII white space; a text's shingles are its distinct windows of five words (a shorter text is one
shingle).  Texts with the same shingles form a class and are joined as one.  Each class has TREES signatures of DEPTH
minimum hashes: its paths in TREES prefix tries of DEPTH levels.  Matching starts with whole paths.  At each level every
class tries the centre of one of its trie nodes (the member that meets most others), and the exact similarity of the two
decides.  From the similarities of the links found, the share of all links that meet in some trie at this level is
estimated (each link stands for one over its own chance to meet); while it is under the target, prefixes are shortened by a
level.  The last level is the one at which even a pair exactly at the threshold meets with the target chance.

Links join classes to groups.  Trie nodes of the level reached that still hold several groups are then searched whole: they
are split into blocks of bounded size, and a task compares the members of two blocks that are of different groups and meet
in no earlier trie.  Only what joins groups leaves a task, so a group of n near copies makes of the order of n rows, not n
squared; n texts that meet but are not similar enough have to be compared, and are copied once for each block pair.
Numbers of links, where they are asked for, are counted afterwards inside the groups, by pairs of blocks; that compares all
of a group's classes, and copies each as often as the group has blocks.

Result: one row for each document with class_id (the least doc_id of its group of texts linked directly or through others),
n_links (other documents with similarity of at least the threshold, copies included) and levels (of prefixes reached).

Cases: null and empty texts, and those of blanks only, have no shingles; they count as copies of each other.  Repeated rows
are copies.  A null doc_id takes part but is never a class_id unless all of a group are null.  An empty table gives no rows.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ending, forget, kept, pick, written

SHINGLE, THRESHOLD, TREES, DEPTH, TARGET = 5, 0.8, 24, 8, 0.9999
BLOCK_ROWS, BLOCK_SHINGLES = 600, 600_000
#: Rows of keys, of some 60 bytes each, that may be sent to every executor; more of them are joined by a shuffle.
BROADCAST_ROWS = 300_000
WORDS = 200_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M[1]
    x = (x ^ x >> np.uint64(27)) * _M[2]
    return x ^ x >> np.uint64(31)


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """The shortest prefix that may be needed: the longest with which a pair at the threshold meets in some trie with
    probability target."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < target:
        k -= 1
    return k


@dataclass(frozen=True)
class Forest:
    """Tries of `depth` levels; the first `shortest` levels of a path are one key, the others are in its tail."""

    threshold: float = THRESHOLD
    trees: int = TREES
    depth: int = DEPTH
    target: float = TARGET

    @property
    def shortest(self) -> int:
        return prefix_depth(self.threshold, self.trees, self.depth, self.target)

    @property
    def bits(self) -> int:
        """Bits of each level in a tail."""
        return min(16, 62 // max(1, self.depth - self.shortest))

    def shift(self, level: int) -> int:
        """What a tail is shifted by to be cut to a level."""
        return self.bits * (self.depth - level)

    def paths(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and tail of each trie's path, from a text's shingles."""
        mins = np.empty(self.trees * self.depth, np.uint64)
        factors = multipliers(self.trees, self.depth)
        step = max(1, 4_000_000 // max(1, len(own)))
        for a in range(0, len(mins), step):
            mins[a : a + step] = (own[None, :] * factors[a : a + step, None]).min(axis=1)
        mins = mins.reshape(self.trees, self.depth)
        key = np.arange(self.trees, dtype=np.uint64) + np.uint64(self.shortest)
        tail = np.zeros(self.trees, np.uint64)
        for i in range(self.depth):
            if i < self.shortest:
                key = _mix(key * _M[0] + mins[:, i])
            else:
                tail = tail << np.uint64(self.bits) | _mix(mins[:, i] * _M[0]) >> np.uint64(64 - self.bits)
        return key.view(np.int64), tail.view(np.int64)

    def meets(self, similarity: Column, level: int) -> Column:
        """The chance of a pair to meet in some trie at a level."""
        return 1 - F.pow(1 - F.pow(similarity, F.lit(float(level))), F.lit(float(self.trees)))

    def recall(self, links: int, weight: float, level: int) -> float:
        """The share of links that meet at a level, from how many were found and the sum of one over their chances; one
        more link exactly at the threshold stands for those not seen."""
        least = 1 - (1 - self.threshold**level) ** self.trees
        return (links + 1) / (weight + 1 / least)


class _Hashes(dict):
    """Word -> 64-bit hash, kept for the first WORDS short words."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < WORDS and len(word) < 64:
            self[word] = h
        return h


def shingles(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the windows of SHINGLE words."""
    words = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")).split()
    if not words:
        return np.empty(0, np.uint64)
    own = kept("jaccard").setdefault("words", _Hashes())
    h = np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * _M[0] + h[i : len(h) - n + 1 + i])
    return np.unique(out)


@functools.cache
def multipliers(trees: int, depth: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, trees * depth, np.uint64) | np.uint64(1)


_SIGNED = "uid bigint, doc_id {kind}, sha binary, digest binary, n_shingles int, keys array<bigint>, tails array<bigint>"


def signed(docs: DataFrame, forest: Forest) -> DataFrame:
    """uid, doc_id, sha (of the text), digest (of its shingles), n_shingles, and the keys and tails of its paths."""
    from pyspark import TaskContext

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        uid, last = TaskContext.get().partitionId() << 33, {}
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = text.as_buffer()
                raw = b"" if raw is None else raw.to_pybytes()
                sha = hashlib.sha1(raw).digest()
                made = last.get(sha)
                if made is None:
                    own = shingles(raw)
                    made = hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own), *(forest.paths(own) if len(own) else ([], []))
                    if len(last) < 5000:
                        last[sha] = made
                rows.append((uid, sha, *made))
                uid += 1
            if rows:
                u, s, d, n, k, t = zip(*rows)
                paths = pa.list_(pa.int64())
                arrays = [pa.array(u, pa.int64()), batch.column(0), pa.array(s, pa.binary()), pa.array(d, pa.binary()), pa.array(n, pa.int32()), pa.array(k, paths), pa.array(t, paths)]
                yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "sha", "digest", "n_shingles", "keys", "tails"])

    return docs.mapInArrow(ending(run), _SIGNED.format(kind=kind))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: for each node of the undirected edges, the least node that it is connected with.

    Each round takes the least label among neighbours and then the label of that label; rounds end when none changes.
    """
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).where("x <> y").distinct())
    labels = written(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("root").alias("m"))
        least = labels.join(near, labels.node == near.x).select("node", "root", F.least("root", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("root").alias("r2"))
        new = written(least.join(jump, "m", "left").select("node", F.least("m", F.coalesce("r2", "m")).alias("new"), "root"))
        done = new.where("new <> root").isEmpty()
        forget(labels)
        labels = new.select("node", F.col("new").alias("root"))
        labels._shared_path = new._shared_path
        if done:
            forget(both)
            return labels


def similar(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def intersections(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, by blocked products of the shingles that several sets have."""
    if len(pairs) < 64:
        return np.array([similar(sets[i], sets[j]) for i, j in pairs], np.int64)
    n = len(sets)
    ids, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    width = int(shared.sum())
    if n * n * width / 4e9 > len(pairs) * (2e-5 + sum(map(len, sets)) / n * 3e-8):
        return np.array([similar(sets[i], sets[j]) for i, j in pairs], np.int64)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    keep = shared[inverse]
    row, col = row[keep], number[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((n, n), np.float32)
    step = max(256, 8_000_000 // n)
    for a in range(0, width, step):
        lo, hi = np.searchsorted(col, [a, a + step])
        part = np.zeros((n, min(step, width - a)), np.float32)
        part[row[lo:hi], col[lo:hi] - a] = 1
        total += part @ part.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def linked(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the pairs whose similarity is at least the threshold."""
    if not len(pairs):
        return pairs
    both, sizes = intersections(sets, pairs), np.array([len(x) for x in sets])
    return pairs[both >= threshold * (sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - both) - 1e-9]


def roots_of(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n rows the least that it is connected with."""
    root = np.arange(n)
    while True:  # by the same rule as components()
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], root[pairs[:, 0]])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def in_groups(df: DataFrame, key: list[str], others: list[str], found, kinds: str) -> DataFrame:
    """found(key, {column: values}) of the rows that share a key, as rows of whole numbers; a task holds one key's rows.

    others come as lists, array columns as NumPy arrays.
    """
    names = [*key, *others]

    def run(batches):
        out_names = [x.split()[0] for x in kinds.split(", ")]
        at, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(lists(batch.column(x)) for x in names)):
                if row[: len(key)] != at:
                    if len(held) > 1:
                        out += found(at, dict(zip(others, zip(*held))))
                    at, held = row[: len(key)], []
                held.append(row[len(key) :])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], out_names)
        if len(held) > 1 and (out := found(at, dict(zip(others, zip(*held))))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], out_names)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*names).repartition(n, *key).sortWithinPartitions(*key, "node").mapInArrow(ending(run), kinds)


def lists(column: pa.Array) -> list:
    """Python values; those of array columns as NumPy arrays without copies."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b].view(np.uint64) for a, b in zip(at, at[1:])]


def distinct_nodes(node: tuple) -> np.ndarray:
    """Places of the first row of each node: rows that repeat a key and a text repeat a class."""
    return np.unique(np.array(node, np.int64), return_index=True)[1]


class Search:
    """The groups of near duplicates among docs (doc_id, text)."""

    def __init__(self, docs: DataFrame, forest: Forest):
        self.docs, self.forest = docs, forest
        self.rows = written(signed(docs, forest))
        grouped = self.rows.groupBy("digest").agg(F.min("uid").alias("node"), F.min("doc_id").alias("first_doc"), F.count("*").alias("w"))
        self.classes = written(grouped)
        self.members = self._members()
        self.sets = self._sets()
        links, self.level = self._stars()
        self.labels = self._searched(components(links, "node", "centre"))

    def _members(self) -> DataFrame:
        """tree, key, tail, node, n_shingles and score of the classes that share a trie node of the shortest prefix; score:
        how many others a class meets there."""
        firsts = self.rows.join(self.classes.select(F.col("node").alias("uid"), "w"), "uid").where("n_shingles > 0")
        paths = firsts.select(F.col("uid").alias("node"), "n_shingles", F.posexplode(F.arrays_zip("keys", "tails")).alias("tree", "path")).select("tree", "path.keys", "path.tails", "node", "n_shingles")
        paths = written(paths.toDF("tree", "key", "tail", "node", "n_shingles"))
        shared = paths.groupBy("tree", "key").agg(F.count("*").alias("n")).where("n > 1")
        met = written(paths.join(shared, ["tree", "key"]))
        forget(paths)
        out = written(met.drop("n").join(met.groupBy("node").agg(F.sum("n").alias("score")), "node"))
        forget(met)
        return out

    def _sets(self) -> DataFrame:
        """node, keys, tails, own (shingles) of the classes that share a trie node."""
        wanted = self.members.select(F.col("node").alias("uid")).distinct()
        wanted = written(self.rows.join(wanted, "uid").select(F.col("uid").alias("node"), F.col("doc_id").alias("d"), "sha", "keys", "tails"))
        keys = wanted.select("node", "d", "sha")
        if wanted.count() <= BROADCAST_ROWS:
            keys = F.broadcast(keys)
        texts = self.docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("s", F.unhex(F.sha1(F.col("text").cast("binary"))))
        found = texts.join(keys, texts.doc_id.eqNullSafe(keys.d) & (texts.s == keys.sha)).select("node", "text")

        def run(batches):
            for batch in batches:
                own = [shingles(x.as_buffer().to_pybytes()).view(np.int64) for x in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], ["node", "own"])

        # rows that repeat a doc_id and a text are one class
        made = found.mapInArrow(ending(run), "node bigint, own array<bigint>").dropDuplicates(["node"])
        out = written(made.join(wanted.select("node", "keys", "tails"), "node"))
        forget(wanted)
        return out

    def _stars(self) -> tuple[DataFrame, int]:
        """Links (node, centre) found level by level, and the level reached; classes that have a link try no further centre."""
        forest = self.forest
        tried, links = None, None
        for level in range(forest.depth, forest.shortest - 1, -1):
            at = self.members.withColumn("tail", F.shiftrightunsigned("tail", forest.shift(level)))
            centres = at.groupBy("tree", "key", "tail").agg(F.max(F.struct("score", "node")).alias("c"), F.count("*").alias("n")).where("n > 1")
            if links is not None:
                at = at.join(links.select("node").union(links.select("centre")).distinct(), "node", "left_anti")
            # of the centres of a class's trie nodes, the one that meets most
            best = at.join(centres, ["tree", "key", "tail"]).where("node <> c.node").groupBy("node").agg(F.max("c").alias("c"))
            new = best.select("node", F.col("c.node").alias("centre"))
            if tried is not None:
                new = new.join(tried.select("node", "centre"), ["node", "centre"], "left_anti")
            compared = written(self._compared(written(new)))
            tried = compared if tried is None else tried.unionByName(compared)
            links = tried.where(F.col("similarity") >= forest.threshold - 1e-9)
            n, weight = links.agg(F.count("*"), F.coalesce(F.sum(1 / forest.meets(F.col("similarity"), level)), F.lit(0.0))).first()
            if forest.recall(n, weight, level) >= forest.target:
                break
        return links, level

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """node, centre and their similarity; only the sets of classes that pairs name are moved, each to its pair."""
        if pairs.count() <= BROADCAST_ROWS:
            pairs = F.broadcast(pairs)
        own = self.sets.select("node", "own")
        both = own.toDF("node", "a").join(pairs, "node").join(own.toDF("centre", "b").join(pairs, "centre"), ["node", "centre"])
        inside = F.size(F.array_intersect("a", "b"))
        return both.select("node", "centre", (inside / (F.size("a") + F.size("b") - inside)).alias("similarity"))

    def _searched(self, labels: DataFrame) -> DataFrame:
        """node, root: labels, joined further by the links in trie nodes that still hold several groups."""
        place = ["tree", "key", "tail"]
        at = self.members.withColumn("tail", F.shiftrightunsigned("tail", self.forest.shift(self.level)))
        at = at.join(labels, "node", "left").select(*place, "node", "n_shingles", F.coalesce("root", "node").alias("label"))
        size = F.greatest(F.count("*") / F.lit(BLOCK_ROWS), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))
        held = at.groupBy(*place, "label").agg(size.alias("size"))
        mixed = held.groupBy(*place).agg(F.count("*").alias("n"), F.ceil(F.sum(F.when(F.col("size") <= 1, F.col("size")))).cast("int").alias("smalls")).where("n > 1").drop("n")
        held = written(held.join(mixed, place).withColumn("big", F.when(F.col("size") > 1, F.col("label")).otherwise(-1)))
        # blocks: parts of a large group, or several small groups together
        part = lambda what, n: F.pmod(F.xxhash64(what), n).cast("int")
        small = held.where("big = -1").select(*place, "big", part("label", F.col("smalls")).alias("part")).distinct()
        large = held.where("big <> -1").select(*place, "big", F.explode(F.sequence(F.lit(0), F.ceil("size").cast("int") - 1)).alias("part"))
        blocks = written(small.unionByName(large))
        # two blocks of one large group need no comparison
        other = blocks.select(*place, F.col("big").alias("big2"), F.col("part").alias("part2"))
        pairs = blocks.join(other, place).where("big < big2 or big = big2 and big = -1 and part <= part2")
        sides = pairs.select(*place, "big", "part", "big2", "part2", F.explode(F.expr("if(big = big2 and part = part2, array(0), array(0, 1))")).alias("side"))
        sides = sides.select(*place, "big", "part", "big2", "part2", "side", F.expr("if(side = 0, big, big2)").alias("own_big"), F.expr("if(side = 0, part, part2)").alias("own_part"))
        in_block = at.join(held.select(*place, "label", "big", "smalls", F.ceil("size").cast("int").alias("n")), [*place, "label"])
        in_block = in_block.select(*place, "node", "label", F.col("big").alias("own_big"), F.when(F.col("big") == -1, part("label", F.col("smalls"))).otherwise(part("node", F.col("n"))).alias("own_part"))
        dealt = in_block.join(sides, [*place, "own_big", "own_part"]).join(self.sets, "node")
        forest, shift = self.forest, np.uint64(self.forest.shift(self.level))

        def found(key, rows):
            first = distinct_nodes(rows["node"])
            label, side, sets = np.array(rows["label"], np.int64)[first], np.array(rows["side"])[first], [rows["own"][i] for i in first]
            keys, tails = (np.stack([rows[x][i] for i in first]) for x in ("keys", "tails"))
            wanted = np.triu(label[:, None] != label[None, :], 1)
            if (side != side[0]).any():
                wanted &= side[:, None] != side[None, :]
            for t in range(key[0]):  # a pair is compared in the first trie in which it meets
                k, rest = keys[:, t], tails[:, t] >> shift
                wanted &= (k[:, None] != k[None, :]) | (rest[:, None] != rest[None, :])
            pairs = linked(sets, np.argwhere(wanted), forest.threshold)
            _, same = np.unique(label, return_index=True)
            at_label = same[np.searchsorted(label[same], label)]
            root = roots_of(len(label), np.column_stack([at_label[pairs[:, 0]], at_label[pairs[:, 1]]]))
            return sorted({(int(label[i]), int(label[root[i]])) for i in at_label[pairs].ravel() if root[i] != i})

        edges = written(in_groups(dealt, [*place, "big", "part", "big2", "part2"], ["node", "label", "side", "own", "keys", "tails"], found, "a bigint, b bigint"))
        for x in (held, blocks):
            forget(x)
        if edges.isEmpty():
            return labels
        joined = components(edges, "a", "b").toDF("label", "least")
        # a group that is its only class so far has no label yet
        every = labels.select("node", F.col("root").alias("label")).unionByName(joined.select(F.col("label").alias("node"), "label")).distinct()
        return written(every.join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("root")))

    def groups(self) -> DataFrame:
        """digest, node, first_doc, w of each class, and root: the least class of its group."""
        return self.classes.join(self.labels, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def links(self) -> DataFrame:
        """node, links: in how many documents of other classes each class of a group of several has a link."""
        shingles_of = self.sets.select("node", F.size("own").alias("n_shingles"))
        own = self.groups().select("root", "node", "w").join(shingles_of, "node")
        # so many blocks that none has too many rows or shingles
        blocks = own.groupBy("root").agg(
            F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("g"), F.count("*").alias("n")
        ).where("n > 1")
        placed = own.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, g - 1)")))
        dealt = placed.select("root", F.least("block", "j").alias("i"), F.greatest("block", "j").alias("j"), "block", "node", "w").join(self.sets.select("node", "own"), "node")
        threshold = self.forest.threshold

        def found(key, rows):
            first = distinct_nodes(rows["node"])
            nodes, weights, block = (np.array(rows[x], np.int64)[first] for x in ("node", "w", "block"))
            across = block[:, None] != block[None, :] if key[1] != key[2] else np.ones((len(first), len(first)), bool)
            pairs = linked([rows["own"][i] for i in first], np.argwhere(np.triu(across, 1)), threshold)
            n = np.zeros(len(first), np.int64)
            np.add.at(n, pairs[:, 0], weights[pairs[:, 1]])
            np.add.at(n, pairs[:, 1], weights[pairs[:, 0]])
            at = np.flatnonzero(n)
            return list(zip(nodes[at].tolist(), n[at].tolist()))

        return in_groups(dealt, ["root", "i", "j"], ["block", "node", "w", "own"], found, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))


def join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> DataFrame:
    """doc_id, class_id, copy_of, n_links, levels: one row for each document; copy_of: the least doc_id with the same
    shingles."""
    search = Search(pick(docs, "doc_id", "text"), Forest(threshold, trees, depth, target))
    named = written(search.groups().join(search.links(), "node", "left"))
    # only groups of several classes need the least doc_id of all
    ids = named.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    by_class = named.join(ids, "root").select("digest", "class_id", F.col("first_doc").alias("copy_of"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return search.rows.select("doc_id", "digest").join(by_class, "digest").select("doc_id", "class_id", "copy_of", "n_links", F.lit(search.level).alias("levels"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, of which one for each group of near duplicates stays: that with the least doc_id, of
    equal ones the least digest of its text; rows without a doc_id come last.
    """
    search = Search(pick(docs, "doc_id", "text"), Forest(threshold))
    named = search.rows.join(search.groups().select("digest", "root"), "digest").select("root", "doc_id", "sha")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("kept_id"), F.col("sha").alias("kept_sha"))
    first = named.groupBy("root").agg(F.min(own).alias("m"), F.count("*").alias("n")).where("n > 1").select("root", "m.kept_id", "m.kept_sha")
    chosen = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    # (doc_id, text) that no group keeps, most often few
    rest = written(named.join(first, "root").groupBy("doc_id", "sha").agg(F.max(chosen).alias("kept")).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("sha").alias("_gone_sha")))
    if rest.count() <= BROADCAST_ROWS:
        rest = F.broadcast(rest)
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]  # names may clash
    doc_id, text = (F.col(plain[names.index(x)]) for x in ("doc_id", "text"))
    of_text = docs.toDF(*plain).withColumn("_sha", F.unhex(F.sha1(F.coalesce(text, F.lit("")).cast("binary"))))
    left = of_text.join(rest, doc_id.eqNullSafe(F.col("_gone")) & (F.col("_sha") == F.col("_gone_sha")), "left_anti")
    # only rows that repeat both are left to be told apart
    if not search.rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        left = left.dropDuplicates([plain[names.index("doc_id")], "_sha"])
    return left.select(*plain).toDF(*names)
