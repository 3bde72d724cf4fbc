"""The import graph: an edge table (src imports dst), resolved by joins and walked by frontier loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources import scratch
from . import folders

# Suffixes that a script import may leave out, in the order of trial.
SCRIPT_SUFFIXES = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
SCRIPTS = "javascript", "typescript", "jsx", "tsx"


#: Rounds after which a table that grows by a part each round is written anew.
ROUNDS = 16
cut = scratch.written


#: The columns that an import and a file meet by.
_MET = ["kind", "key"]


def _named(nodes: DataFrame, unique: bool) -> DataFrame:
    """src, import, kind, key, exact: what each import names, one row each.

    kind, key: the language's kind and the path without what is tried behind it; exact: nothing is tried behind it.
    """
    script = F.col("language").isin(*SCRIPTS)
    own = paths.parent(F.col("src"))
    folders = F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, "/"))
    imports = F.col("imports") if unique else F.array_distinct("imports")
    files = nodes.where((F.col("language") == "python") | script).select(F.col("path").alias("src"), script.alias("script"), "imports")
    rows = files.select("src", "script", folders.alias("folders"), F.explode(imports).alias("import"))
    imp = F.col("import")
    dots = F.when(F.startswith(imp, F.lit(".")), F.length(F.regexp_extract(imp, r"^\.*", 0))).otherwise(0)
    up = F.slice("folders", F.lit(1), F.greatest(F.size("folders") - F.greatest(F.col("dots") - 1, F.lit(0)), F.lit(0)))
    dotted = F.translate(F.substr(imp, F.col("dots") + 1), ".", "/")
    module = F.when(F.col("dots") == 0, F.translate(imp, ".", "/")).otherwise(F.array_join(F.when(dotted == "", up).otherwise(F.concat(up, F.array(dotted))), "/"))
    target = paths.normalised(F.concat("folders", F.split(imp, "/")))
    rows = rows.where(~F.col("script") | imp.rlike(r"^\.\.?/")).withColumn("dots", dots)
    rows = rows.select("src", "import", "script", F.when(F.col("script"), target).otherwise(module).alias("key"))
    exact = F.col("script") & F.col("key").rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)$")
    return rows.select("src", "import", F.when(F.col("script"), "script").otherwise("python").alias("kind"), "key", exact.alias("exact"))


def _names(files: DataFrame) -> DataFrame:
    """kind, key, tried: the files (dst) that a key could mean, each with its place (pos) in the order of trial."""
    path = F.col("path")
    without = lambda c, end: F.left(c, F.length(c) - len(end))
    name = lambda kind, key, pos: F.struct(F.lit(kind).alias("kind"), key.alias("key"), (F.lit(pos) if isinstance(pos, int) else pos).alias("pos"))
    # the package of the top folder itself has no name to put a suffix on
    python = [
        F.when(path == "..py", name("python", F.lit(""), 0)), F.when(F.endswith(path, F.lit(".py")) & (path != ".py"), name("python", without(path, ".py"), 0)),
        F.when(path == "__init__.py", name("python", F.lit(""), 1)), F.when(F.endswith(path, F.lit("/__init__.py")) & (path != "/__init__.py"), name("python", without(path, "/__init__.py"), 1)),
    ]
    script = [name("script", path, 0)]
    for i, s in enumerate(SCRIPT_SUFFIXES, 1):
        script.append(F.when(F.endswith(path, F.lit(s)), name("script", without(path, s), i)))
        script.append(F.when(F.endswith(path, F.lit(f"/index{s}")), name("script", without(path, f"/index{s}"), i + len(SCRIPT_SUFFIXES))))
    rows = files.select("path", F.explode(F.array_compact(F.array(*python, *script))).alias("n"))
    return rows.groupBy("n.kind", "n.key").agg(F.array_sort(F.collect_set(F.struct("n.pos", F.col("path").alias("dst")))).alias("tried"))


def _resolved(nodes: DataFrame, ordered: bool, unique: bool = False) -> DataFrame:
    """resolve(), with a row again for each row of nodes that repeats; unique: no list of imports has one twice."""
    own = nodes.where("language = 'python' and size(imports) > 0") if ordered else nodes
    # files are as many as rows, so never a broadcast table, however small their columns look
    met = _named(own, unique).join(_names(own.select("path")).hint("merge"), _MET)
    allowed = lambda x: (~F.col("exact") | (x["pos"] == 0)) & (paths.parts(x["dst"]) <= paths.parts(F.col("src")) if ordered else F.lit(True))
    return met.select("src", "import", F.get(F.filter("tried", allowed), F.lit(0))["dst"].alias("dst")).where("dst is not null")


def resolve(nodes: DataFrame, ordered: bool = False) -> DataFrame:
    """src, import, dst of the imports (path, imports, language) that mean a file of nodes; a path has one language.

    ordered: only files with imports are nodes, and only earlier ones (or itself) in scan order can be meant, as a single
    pass over the files would find; there are no script edges then.

    An import is one row, which meets the files by what they are called without what can be left out.
    """
    return _resolved(nodes, ordered).distinct()


def resolved_edges(nodes: DataFrame, ordered: bool = False, unique: bool = False) -> DataFrame:
    """src, dst: edges_of(resolve()), which shuffles once less."""
    return edges_of(_resolved(nodes, ordered, unique))


def edges_of(resolved: DataFrame) -> DataFrame:
    return resolved.select("src", "dst").distinct()


def unresolved(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    return nodes.select(F.col("path").alias("src"), F.explode(F.array_distinct("imports")).alias("import")).join(resolved, ["src", "import"], "left_anti")


def dependencies(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("src") == path).select(F.col("dst").alias("path"))


def dependents(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("dst") == path).select(F.col("src").alias("path"))


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("dependents"))


def fan_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("path")).agg(F.countDistinct("dst").alias("dependencies"))


def core(edges: DataFrame, least: int = 3) -> DataFrame:
    """Files with many dependents that do not look like tests."""
    return fan_in(edges).where((F.col("dependents") >= least) & ~paths.about_tests(F.col("path")))


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that nothing imports."""
    return nodes.select("path").join(edges.select(F.col("dst").alias("path")), "path", "left_anti")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that import nothing."""
    return nodes.select("path").join(edges.select(F.col("src").alias("path")), "path", "left_anti")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that import nothing and that nothing imports."""
    return nodes.select("path").join(edges.select(F.explode(F.array("src", "dst")).alias("path")), "path", "left_anti")


def replace_node(edges: DataFrame, path: str, new_out: DataFrame) -> DataFrame:
    """edges with the out-edges of path replaced."""
    return edges.where(F.col("src") != path).unionByName(new_out.select("src", "dst"))


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    own = gone.select("path")
    return edges.join(own, edges.src == own.path, "left_anti").join(own, F.col("dst") == own.path, "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """path, dependencies: sorted."""
    return edges.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))


def size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files and edges."""
    return nodes.agg(F.countDistinct("path").alias("files")).crossJoin(edges.distinct().agg(F.count("*").alias("edges")))  # one row each


def node(nodes: DataFrame, path: str) -> DataFrame:
    """The row of a file, none if the graph does not have it."""
    return nodes.where(F.col("path") == path)


def has_file(nodes: DataFrame, path: str) -> bool:
    return not node(nodes, path).isEmpty()


def closure(edges: DataFrame, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """seed, path: all that each seed (seed) reaches along edges, itself left out.

    A round writes what is new only; what was seen is the union of the rounds.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    kept = edges if hasattr(edges, "_shared_path") else cut(edges.select("src", "dst"))
    step = kept.select(F.col(a).alias("at"), F.col(b).alias("path")).where("at <> path")
    front = cut(seeds.select("seed", F.col("seed").alias("path")).distinct())
    seen, rounds = front, 0
    while True:
        new = front.withColumnRenamed("path", "at").join(step, "at").select("seed", "path").distinct()
        front = cut(new.join(seen, ["seed", "path"], "left_anti"))
        if front.isEmpty():
            break
        seen, rounds = seen.unionByName(front), rounds + 1
        if rounds % ROUNDS == 0:
            seen = cut(seen)
    scratch.forget(front)
    if kept is not edges:
        scratch.forget(kept)
    return seen.where("seed <> path")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, level: 0 for files without dependencies, else one more than the highest of them; null on a cycle or above one.

    Folders that no edge leaves are solved whole, what is left in rounds.
    """
    every = edges.select("src", "dst").where("src is not null and dst is not null").unionByName(nodes.select(F.col("path").alias("src"), F.lit(None).cast("string").alias("dst")).where("src is not null"))
    done = cut(folders.solved(every, folders.levels, "path string, level int"))
    nameless = nodes.where("path is null").select("path", F.lit(0).alias("level")).distinct()
    out = done.where("path is not null").select("path", "level").unionByName(nameless)
    left = done.where("src is not null")
    if left.isEmpty():
        return out
    return out.unionByName(_levels_in_rounds(left.where("dst is null").select(F.col("src").alias("path")), left.where("dst is not null")))


def _levels_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """levels() of any graph.

    Round i leaves the files from which a way of i imports begins; each is left by the next round at its level, but for those
    on cycles and above them, of which ever the same stay.
    """
    step = cut(edges.select("src", "dst").distinct())
    all_ = nodes.select("path").distinct()
    here, out, level, n = cut(all_), None, 0, -1
    while True:
        before, n = n, here.count()
        if n in (0, before):
            break
        own = here.select("path", F.lit(level).alias("level"))
        out = own if out is None else out.unionByName(own)
        here = cut(step.join(here.select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path")).distinct())
        level += 1
        if level % ROUNDS == 0:
            out = cut(out.groupBy("path").agg(F.max("level").alias("level")))
    if out is None:
        return all_.select("path", F.lit(None).cast("int").alias("level"))
    stuck = here.select("path", F.lit(True).alias("stuck"))
    highest = out.groupBy("path").agg(F.max("level").alias("level"))
    return highest.join(stuck, "path", "left").select("path", F.when(F.col("stuck").isNull(), F.col("level")).alias("level"))


def order(levelled: DataFrame) -> DataFrame:
    """A dependencies-first order; files on cycles last, in scan order."""
    return levelled.orderBy(F.col("level").asc_nulls_last(), F.when(F.col("level").isNotNull(), F.col("path")), paths.parts(F.col("path")))


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges between files that have both an importer and an import among them."""
    n = edges.count()
    while True:
        heads, tails = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        left = cut(edges.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        scratch.forget(edges)
        before, n, edges = n, left.count(), left
        if n == before:
            return edges


def components(edges: DataFrame) -> DataFrame:
    """path, scc: strongly connected components of more than one file, named by their least member.

    Folders that no edge leaves are solved whole, what is left in rounds.
    """
    done = cut(folders.solved(edges.select("src", "dst").where("src <> dst"), folders.components, "path string, scc string"))
    out, left = done.where("path is not null").select("path", "scc"), done.where("src is not null").select("src", "dst")
    return out if left.isEmpty() else out.unionByName(_components_in_rounds(left))


def _components_in_rounds(edges: DataFrame) -> DataFrame:
    """components() of any graph.

    Colours spread forward until every file has the least that reaches it; what reaches a colour's own file backward
    within the colour is one component.  Components are taken off and the rest is coloured again.
    """
    rest = _trimmed(cut(edges.select("src", "dst").where("src <> dst").distinct()))
    out = None
    while not rest.isEmpty():
        colour = cut(rest.select(F.col("src").alias("path")).union(rest.select("dst")).distinct().withColumn("c", F.col("path")))
        while True:
            came = rest.join(colour.withColumnRenamed("path", "src"), "src").groupBy(F.col("dst").alias("path")).agg(F.min("c").alias("m"))
            new = cut(colour.join(came, "path", "left").select("path", F.least("c", F.coalesce("m", "c")).alias("n"), "c"))
            done = new.where("n <> c").isEmpty()
            scratch.forget(colour)
            colour = new.select("path", F.col("n").alias("c"))
            colour._shared_path = new._shared_path
            if done:
                break
        inside = rest.join(colour.select(F.col("path").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("path").alias("dst"), F.col("c").alias("b")), "dst").where("a = b")
        inside = cut(inside.select("src", "dst", F.col("a").alias("scc")))
        front = cut(colour.where("path = c").select("path", F.col("c").alias("scc")))
        scratch.forget(colour)
        found, rounds = front, 0
        while True:
            back = inside.join(front.select(F.col("path").alias("dst"), "scc"), ["dst", "scc"]).select(F.col("src").alias("path"), "scc").distinct()
            front = cut(back.join(found, ["path", "scc"], "left_anti"))
            if front.isEmpty():
                break
            found, rounds = found.unionByName(front), rounds + 1
            if rounds % ROUNDS == 0:
                found = cut(found)
        sizes = found.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1")
        own = cut(found.join(sizes, "scc", "left_semi").select("path", "scc"))
        out = own if out is None else out.unionByName(own)
        gone = found.select("path")
        left = cut(rest.join(gone.withColumnRenamed("path", "src"), "src", "left_anti").join(gone.withColumnRenamed("path", "dst"), "dst", "left_anti"))
        scratch.forget(rest, inside)
        rest = _trimmed(left)
    return out if out is not None else edges.select(F.col("src").alias("path"), F.col("src").alias("scc")).limit(0)


def cycles(edges: DataFrame) -> DataFrame:
    """scc, cycle: for each component and each file that imports itself, the shortest way from its least member back to
    it, of equal lengths the least.

    Folders that no edge leaves are solved whole, what is left in rounds.
    """
    done = cut(folders.solved(edges.select("src", "dst").where("src is not null and dst is not null"), folders.cycles, "scc string, cycle array<string>"))
    out, left = done.where("scc is not null").select("scc", "cycle"), done.where("src is not null").select("src", "dst")
    return out if left.isEmpty() else out.unionByName(_cycles_in_rounds(left))


def _cycles_in_rounds(edges: DataFrame) -> DataFrame:
    """cycles() of any graph."""
    own = cut(_components_in_rounds(edges))
    inside = edges.join(own.withColumnRenamed("path", "src"), "src").join(own.select(F.col("path").alias("dst"), F.col("scc").alias("s")), "dst").where("scc = s and src <> dst")
    inside = cut(inside.select("scc", "src", "dst").distinct())
    front = cut(own.select("scc").distinct().select("scc", F.col("scc").alias("path"), F.array("scc").alias("way")))
    seen = front.select("scc", "path")
    out = edges.where("src = dst").select(F.col("src").alias("scc"), F.array("src", "dst").alias("cycle")).distinct()
    while not front.isEmpty():
        step = cut(front.join(inside.withColumnRenamed("src", "path"), ["scc", "path"]).select("scc", F.col("dst").alias("path"), F.concat("way", F.array("dst")).alias("way")))
        closed = cut(step.where("path = scc").groupBy("scc").agg(F.min("way").alias("cycle")))
        out = out.unionByName(closed)
        new = step.where("path <> scc").groupBy("scc", "path").agg(F.min("way").alias("way"))
        front = cut(new.join(seen, ["scc", "path"], "left_anti").join(closed, "scc", "left_anti"))
        scratch.forget(step)
        seen = seen.unionByName(front.select("scc", "path"))
    return out
