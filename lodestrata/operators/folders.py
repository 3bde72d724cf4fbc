"""Folders of an import graph that no edge leaves or enters: each is solved whole by one task.

Every edge is dealt out by the folder of its source, and one between two folders also by that of its target, so that both
know.  A task reads its folders in order, solves those without such an edge a batch at a time, and gives back the edges of the
others, and of a folder with more than MOST rows, as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: A folder with more rows is left unsolved; rows that are solved at once, when their folder has ended.
MOST, BATCH = 500_000, 50_000


def solved(edges: DataFrame, solve: Callable, fields: str) -> DataFrame:
    """src, dst of the edges of folders that are left, and fields of the solutions; the other columns of a row are null.

    An edge without dst only names a file.
    """
    near, far = paths.parent(F.col("src")), paths.parent(F.coalesce("dst", "src"))
    dealt = edges.select("src", "dst", near.alias("near"), far.alias("far"))
    crosses = F.col("near") != F.col("far")
    dealt = dealt.select("src", "dst", "near", crosses.alias("crosses"), F.explode(F.when(crosses, F.array("near", "far")).otherwise(F.array("near"))).alias("folder"))
    dealt = dealt.select("folder", "crosses", (F.col("near") == F.col("folder")).alias("own"), "src", "dst")
    # edges to other folders come first: a folder is known to have one before the rest of it is read
    dealt = dealt.repartition("folder").sortWithinPartitions("folder", F.desc("crosses"))
    return dealt.mapInArrow(_solver(solve, fields, MOST, BATCH), f"src string, dst string, {fields}")


def _solver(solve: Callable, fields: str, most: int, batch: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        names = [x.split()[0] for x in fields.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[x.split()[1]] for x in fields.split(", ")]
        schema = pa.schema([("src", pa.string()), ("dst", pa.string()), *zip(names, kinds)])

        def left(rows):
            rows = rows.filter(rows["own"])
            if rows.num_rows:
                flat = rows.select(["src", "dst"]).combine_chunks()
                yield from flat.append_column(names[0], pa.nulls(len(flat), kinds[0])).append_column(names[1], pa.nulls(len(flat), kinds[1])).cast(schema).to_batches(max_chunksize=10_000)

        def whole(rows):
            """Rows of folders that are all there."""
            place = rows["folder"].combine_chunks().dictionary_encode().indices.to_numpy()
            open_ = np.zeros(int(place.max()) + 1, bool)
            open_[place[rows["crosses"].to_numpy()]] = True
            is_left = open_[place]
            if is_left.any():
                yield from left(rows.filter(pa.array(is_left)))
                rows = rows.filter(pa.array(~is_left))
            if rows.num_rows:
                values = solve(*_numbered(rows["src"].combine_chunks(), rows["dst"].combine_chunks()))
                n = len(values[0])
                if n:
                    none = pa.nulls(n, pa.string())
                    yield from pa.table([none, none, *(v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds))], schema=schema).to_batches(max_chunksize=10_000)

        held, n, giving = [], 0, None
        for one in batches:
            rows = pa.Table.from_batches([one])
            if giving is not None:  # the rest of a folder that is too large
                same = pc.equal(rows["folder"], giving)
                yield from left(rows.filter(same))
                rows = rows.filter(pc.invert(same))
                if not rows.num_rows:
                    continue
                giving = None
            held.append(rows)
            n += rows.num_rows
            if n < batch:
                continue
            rows = pa.concat_tables(held)
            last = rows["folder"][n - 1]
            ends = pc.index(rows["folder"], last).as_py()  # sorted: the last folder begins here
            if ends:
                yield from whole(rows.slice(0, ends))
                rows = rows.slice(ends)
            if rows.num_rows > most:
                yield from left(rows)
                held, n, giving = [], 0, last
            else:
                held, n = [rows], rows.num_rows
        if n:
            yield from whole(pa.concat_tables(held))

    return run


def _numbered(src, dst):
    """Names in order, and src and dst as their numbers (-1: null)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    both = pa.chunked_array([src, dst]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    place = rank[both.indices.fill_null(len(order)).to_numpy()]
    return both.dictionary.take(pa.array(order)), place[: len(src)], place[len(src) :]


def _listed(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Where the targets of each of n files begin, and the targets, in order."""
    order = np.lexsort((dst, src))
    return np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist()


def _least(first: list[int], heads: list[int]) -> list[int]:
    """The least member of the strongly connected component of each file (Tarjan's algorithm)."""
    n = len(first) - 1
    index, low, done, least, at = [0] * n, [0] * n, [False] * n, list(range(n)), first[:n]
    stack, count = [], 0
    for root in range(n):
        if index[root]:
            continue
        count += 1
        index[root] = low[root] = count
        stack.append(root)
        way = [root]
        while way:
            v = way[-1]
            i = at[v]
            if i < first[v + 1]:
                at[v] = i + 1
                w = heads[i]
                if not index[w]:
                    count += 1
                    index[w] = low[w] = count
                    stack.append(w)
                    way.append(w)
                elif not done[w] and index[w] < low[v]:
                    low[v] = index[w]
            else:
                way.pop()
                if way and low[v] < low[way[-1]]:
                    low[way[-1]] = low[v]
                if low[v] == index[v]:
                    k = len(stack) - 1
                    while stack[k] != v:
                        k -= 1
                    m = min(stack[k:])
                    for w in stack[k:]:
                        done[w] = True
                        least[w] = m
                    del stack[k:]
    return least


def components(names, src: np.ndarray, dst: np.ndarray) -> tuple:
    """path, scc of components of more than one file."""
    import pyarrow as pa

    least = np.array(_least(*_listed(src, dst, len(names))))
    own = np.flatnonzero(np.bincount(least, minlength=len(names))[least] > 1)
    return names.take(pa.array(own)), names.take(pa.array(least[own]))


def cycles(names, src: np.ndarray, dst: np.ndarray) -> tuple:
    """scc, cycle: the shortest way from the least member of each component back to it, of equal lengths the least; and files
    that import themselves."""
    own = np.unique(src[src == dst]).tolist()
    src, dst = src[src != dst], dst[src != dst]
    n = len(names)
    least = np.array(_least(*_listed(src, dst, n)))
    inside = least[src] == least[dst]
    src, dst = src[inside], dst[inside]
    first, heads = _listed(src, dst, n)
    first_back, tails = _listed(dst, src, n)
    name = names.to_pylist()
    scc, ways = [name[v] for v in own], [[name[v], name[v]] for v in own]
    far = [-1] * n  # the length of the way to the least member
    for root in np.unique(least[src]).tolist():
        far[root], front = 0, [root]
        while front:
            more = []
            for v in front:
                for w in tails[first_back[v] : first_back[v + 1]]:
                    if far[w] < 0:
                        far[w] = far[v] + 1
                        more.append(w)
            front = more
        nearest = lambda v: min(heads[first[v] : first[v + 1]], key=far.__getitem__)  # noqa: E731  of equal ones the first, which is the least
        way = [root, nearest(root)]
        while way[-1] != root:
            way.append(nearest(way[-1]))
        scc.append(name[root])
        ways.append([name[v] for v in way])
    return scc, ways


def levels(names, src: np.ndarray, dst: np.ndarray) -> tuple:
    """path, level of files (those without dst) and of what imports them: the longest way to a file; null: it has no end."""
    import pyarrow as pa

    n = len(names)
    is_file = np.zeros(n, bool)
    is_file[src[dst < 0]] = True
    src, dst = src[dst >= 0], dst[dst >= 0]
    first_back, tails = _listed(dst, src, n)
    if is_file.all():
        reached = is_file
    else:
        seen, front = is_file.tolist(), np.flatnonzero(is_file).tolist()
        while front:
            v = front.pop()
            for w in tails[first_back[v] : first_back[v + 1]]:
                if not seen[w]:
                    seen[w] = True
                    front.append(w)
        reached = np.array(seen)
    waits = np.bincount(src[reached[dst]], minlength=n).tolist()
    level, front = [0] * n, [v for v in np.flatnonzero(reached).tolist() if not waits[v]]
    while front:
        v = front.pop()
        up = level[v] + 1
        for w in tails[first_back[v] : first_back[v + 1]]:
            if level[w] < up:
                level[w] = up
            waits[w] -= 1
            if not waits[w]:
                front.append(w)
    own = np.flatnonzero(reached)
    ends = np.array(waits)[own] == 0
    return names.take(pa.array(own)), pa.array(np.array(level, np.int32)[own], pa.int32(), mask=~ends)
