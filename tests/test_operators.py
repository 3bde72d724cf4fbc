"""Operators on small hand-written inputs: signatures, graphs, logs, bullets, sections, debouncing."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import paths, text
from lodestrata.operators import definitions, graph, history, profile, snapshot
from lodestrata.plans import reports
from lodestrata.streaming import debounce

FILE = f"path string, old_exists boolean, new_exists boolean, old_ast_hash string, new_ast_hash string, old_definitions array<{definitions.DEFINITION}>, new_definitions array<{definitions.DEFINITION}>"


def d(name, kind="function", params=(), returns=None, line=1):
    return name, kind, line, not name.startswith("_"), list(params), returns


@pytest.mark.parametrize(
    ("old", "new", "modified", "breaking", "category"),
    [
        ([d("f", params=["a"])], [d("f", params=["a", "b"])], True, False, "internal"),
        ([d("f", params=["a", "b"])], [d("f", params=["a"])], True, True, "breaking"),
        ([d("f", params=["a", "b=..."])], [d("f", params=["a"])], True, False, "internal"),
        ([d("f", params=["a", "b"])], [d("f", params=["b", "a"])], True, True, "breaking"),
        ([d("f", params=["a: int"])], [d("f", params=["a: str"])], True, True, "breaking"),
        ([d("f", params=["a"])], [d("f", params=["a: int"])], True, False, "internal"),
        ([d("f")], [d("f", returns="int")], True, True, "breaking"),
        ([d("f", returns="int")], [d("f", returns="str")], True, True, "breaking"),
        ([d("C", "class")], [d("C", "function")], True, False, "internal"),
        ([d("f")], [], False, False, "breaking"),
        ([d("_f")], [], False, False, "internal"),
        ([], [d("g")], False, False, "additive"),
        ([d("f", params=["a"])], [d("f", params=["a", "b"]), d("g")], True, False, "additive"),
        ([d("f", params=["a"]), d("f", params=["b"])], [d("f", params=["b"])], False, False, "internal"),
    ],
)
def test_signatures(spark, old, new, modified, breaking, category):
    df = spark.createDataFrame([("p", True, True, "a", "b", old, new)], FILE)
    rows = definitions.changes(df).collect()
    assert any(r["change_type"] == "modified" for r in rows) == modified
    assert any(r["is_breaking_signature"] for r in rows) == breaking
    assert definitions.classify(df).first()["category"] == category


def test_creation_deletion_docs(spark):
    rows = [
        ("n", False, True, None, "x", None, [d("_p")]), ("g", True, False, "x", None, [d("_p")], None), ("h", True, False, "x", None, [d("p"), d("q")], None),
        ("s", True, True, "x", "x", [d("p")], []), ("z", False, False, None, None, None, None), ("e", True, True, "", "", [d("p")], [d("p")]),
    ]
    got = {r["path"]: (r["category"], r["description"]) for r in definitions.classify(spark.createDataFrame(rows, FILE)).collect()}
    assert got == {
        "n": ("additive", "New file with 1 definition(s)"), "g": ("internal", "File deleted with 1 definition(s)"), "h": ("breaking", "File deleted with 2 definition(s) (2 public - BREAKING)"),
        "s": ("docs-only", "Documentation-only changes (comments, docstrings, whitespace)"), "z": ("unknown", "Unable to classify"), "e": ("internal", "No significant changes detected"),
    }


def test_diff_properties(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    t = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, hash string")
    assert {r["change_type"] for r in snapshot.diff(s, s).collect()} == {"unchanged"}
    one = snapshot.summary(snapshot.diff(t, s)).first()
    assert (one["added"], one["modified"], one["deleted"], one["unchanged"], one["total_files"], one["has_changes"]) == (1, 1, 1, 0, 3, True)
    assert sorted(map(tuple, snapshot.upsert(s, t).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_resolution(spark):
    rows = [
        ("pkg/__init__.py", [], "python"), ("pkg/a.py", [".", "pkg.c"], "python"), ("pkg/b.py", ["pkg"], "python"), ("pkg/c.py", ["os", "pkg.a"], "python"), ("pkg/d.py", [".a", "..top", "....far"], "python"),
        ("top.py", [".pkg.c"], "python"), ("far/__init__.py", [], "python"), ("web/x.js", ["./y", "react", "./dir", "../web/y.js", "./../../up"], "javascript"), ("web/y.js", [], "javascript"), ("web/dir/index.ts", ["../x"], "typescript"),
        ("up.mjs", [], "javascript"),
    ]
    nodes = spark.createDataFrame(rows, "path string, imports array<string>, language string")
    got = {(r["src"], r["import"], r["dst"]) for r in graph.resolve(nodes).collect()}
    assert got == {
        ("pkg/a.py", ".", "pkg/__init__.py"), ("pkg/a.py", "pkg.c", "pkg/c.py"), ("pkg/b.py", "pkg", "pkg/__init__.py"), ("pkg/c.py", "pkg.a", "pkg/a.py"), ("pkg/d.py", ".a", "pkg/a.py"), ("pkg/d.py", "..top", "top.py"),
        ("pkg/d.py", "....far", "far/__init__.py"), ("top.py", ".pkg.c", "pkg/c.py"), ("web/x.js", "./y", "web/y.js"), ("web/x.js", "./dir", "web/dir/index.ts"), ("web/x.js", "../web/y.js", "web/y.js"),
        ("web/x.js", "./../../up", "up.mjs"), ("web/dir/index.ts", "../x", "web/x.js"),
    }
    ordered = {(r["src"], r["dst"]) for r in graph.resolve(nodes, ordered=True).collect()}
    assert ordered == {("pkg/c.py", "pkg/a.py"), ("pkg/d.py", "pkg/a.py"), ("top.py", "pkg/c.py")}
    assert {r["import"] for r in graph.unresolved(nodes, graph.resolve(nodes)).collect()} == {"os", "react"}


def edges_of(spark, pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


def nodes_of(spark, names):
    return spark.createDataFrame([(x,) for x in names], "path string")


def test_graph_walks(spark):
    e = edges_of(spark, ["ab", "bc", "ca", "cd", "xy", "yx", "dz", "qq"])
    n = nodes_of(spark, "abcdxyzqi")
    assert sorted(map(tuple, graph.closure(e, spark.createDataFrame([("a",), ("d",)], "seed string")).collect())) == [("a", "b"), ("a", "c"), ("a", "d"), ("a", "z"), ("d", "z")]
    assert sorted(r["path"] for r in graph.closure(e, spark.createDataFrame([("d",)], "seed string"), reverse=True).collect()) == ["a", "b", "c"]
    assert sorted(map(tuple, graph.components(e).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert sorted((r["scc"], r["cycle"]) for r in graph.cycles(e).collect()) == [("a", ["a", "b", "c", "a"]), ("q", ["q", "q"]), ("x", ["x", "y", "x"])]
    levels = {r["path"]: r["level"] for r in graph.levels(n, e).collect()}
    assert levels == {"z": 0, "d": 1, "i": 0, "a": None, "b": None, "c": None, "x": None, "y": None, "q": None}
    assert [r["path"] for r in graph.order(graph.levels(n, e)).collect()] == ["i", "z", "d", "a", "b", "c", "q", "x", "y"]
    assert [r["path"] for r in graph.isolated(n, e).collect()] == ["i"]
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.components(none).count() == 0 and {r["level"] for r in graph.levels(n, none).collect()} == {0}


def test_graph_edits(spark):
    e = edges_of(spark, ["ab", "bc", "ac"])
    assert sorted(map(tuple, graph.replace_node(e, "a", edges_of(spark, ["ad"])).collect())) == [("a", "d"), ("b", "c")]
    assert sorted(map(tuple, graph.remove_nodes(e, nodes_of(spark, "c")).collect())) == [("a", "b")]


def test_paths(spark):
    rows = [("a/b.py", "b.py", ".py", "a"), ("a.py", "a.py", ".py", "_root"), (".py", ".py", "", "_root"), ("x/.env", ".env", "", "x"), ("a/b.tar.gz", "b.tar.gz", ".gz", "a"), ("end.", "end.", "", "_root")]
    df = spark.createDataFrame([r[:1] for r in rows], "path string")
    got = df.select("path", paths.name(F.col("path")), paths.suffix(F.col("path")), paths.top_folder(F.col("path"))).collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    ordered = spark.createDataFrame([("a.py",), ("a/b.py",)], "path string").orderBy(paths.parts(F.col("path"))).collect()
    assert [r["path"] for r in ordered] == ["a/b.py", "a.py"]
    globs = {"src/a.py": True, "a.py": False, "deep/src/a.py": True, "a.js": True}
    df = spark.createDataFrame([(k,) for k in globs], "path string")
    assert {r["path"]: r["m"] for r in df.select("path", paths.matches(F.col("path"), ["**/*.py", "*.js"]).alias("m")).collect()} == globs


def test_log(spark):
    log = "\n".join([
        "0123456789|Ann|1700000000|Add a | bar", "3\t1\ta.py", "-\t-\tlogo.png", "", "aaaaaaaaaa|Bob|1700000001|merge", "", "bbbbbbbbbb|Bob|1700000002|rename", "x\t1\tbad.py", "2\t2\t{a => b}/c.py",
        "5\t5\twith|bar.py", "9\t9\tlost.py", "cccccccccc|C|1700000003|last", "1\t0\tz.py",
    ])
    commits, files = history.parse_log(spark.createDataFrame([("r", log), ("empty", "")], "repo string, text string"))
    got = [tuple(r) for r in commits.orderBy("ord").select("hash", "author", "message", "insertions", "deletions").collect()]
    assert got == [("01234567", "Ann", "Add a | bar", 3, 1), ("aaaaaaaa", "Bob", "merge", 0, 0), ("bbbbbbbb", "Bob", "rename", 2, 2), ("cccccccc", "C", "last", 1, 0)]
    assert [tuple(r) for r in files.orderBy("ord", "pos").select("hash", "path").collect()] == [
        ("01234567", "a.py"), ("01234567", "logo.png"), ("bbbbbbbb", "bad.py"), ("bbbbbbbb", "{a => b}/c.py"), ("cccccccc", "z.py"),
    ]


@pytest.mark.parametrize(("n", "inserted", "expected"), [(9, 10, False), (10, 10, True)])
def test_bullet_thresholds(spark, n, inserted, expected):
    commits = spark.createDataFrame([(i, f"{i:08d}", "A", "A good long commit message", inserted, 0, 1) for i in range(n)], "ord int, hash string, author string, message string, insertions bigint, deletions bigint, n_files bigint")
    cf = spark.createDataFrame([(i, "a.py") for i in range(n)], "ord int, path string")
    files = spark.createDataFrame([("a.py", "python", "additive")], "path string, language string, semantic_category string")
    rows = history.bullets(history.stats(commits, cf, files), commits, files, "demo").collect()
    texts = [r["text"] for r in rows]
    assert any(t.startswith("Contributed") for t in texts) == expected and texts[0].startswith("Developed demo, a python project with 1 source files and")
    assert any(t.startswith("Followed best practices") for t in texts)
    assert [r["impact_score"] for r in rows] == sorted((r["impact_score"] for r in rows), reverse=True)
    assert "\n  Category: technical | Impact: 8.0/10\n  Evidence: " in history.formatted(spark.createDataFrame(rows, history.BULLET), "detailed", 1).first()["text"]
    assert history.formatted(spark.createDataFrame(rows, history.BULLET), "odd").count() == 0
    assert '"total_bullets":' in history.exported(spark.createDataFrame(rows, history.BULLET)).first()[0]


def test_profile(spark):
    rows = [("LICENSE", None, []), ("pyproject.toml", None, []), ("requirements.txt", None, []), ("src/app.py", "python", ["flask"]), ("src/latest.py", "python", ["numpy.linalg"]), ("web/x.go", "go", [])]
    files = spark.createDataFrame(rows, "path string, language string, imports array<string>")
    assert profile.primary_language(files).first()[0] == "python" and profile.license_file(files).first()[0] == "LICENSE" and profile.package_manager(files).first()[0] == "pip/poetry"
    assert sorted(r[0] for r in profile.frameworks(files, "python").collect()) == ["Flask", "NumPy"] and profile.frameworks(files, "go").count() == 0
    assert profile.has_tests(files).first()[0] and [r[0] for r in profile.entry_points(files).collect()] == ["src/app.py"]
    none = files.limit(0)
    assert profile.primary_language(none).first()[0] == "unknown" and profile.package_manager(none).first()[0] is None and profile.license_file(none).first()[0] is None


def test_phrases(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>")
    assert [r[0] for r in df.select(text.phrase(F.col("x"))).collect()] == ["", "a", "a and b", "a, b, and c"]


README = "# T\nintro\n\n## Usage\nold\n## Mine\nkeep\n```\n## Fence\n```\n## License\nown text\n## Mine\nagain\n"


def test_sections(spark):
    for t in (README, "", "no headings", "## A\n", "x\n## A\n\n## A\ny"):
        got = spark.createDataFrame([(t,)], "t string").select(F.explode(text.sections(F.col("t"))).alias("s")).select("s.*").orderBy("ord").collect()
        assert [(r["title"], r["content"]) for r in got] == list(reports.split_sections(t).items())


def test_merge():
    new = [reports.Section("overview", "Overview", "O"), reports.Section("usage", "Usage", "U"), reports.Section("license", "License", "L"), reports.Section("api", "API Reference", "A")]
    out = reports.merged(README, new)
    assert [line[3:] for line in out.split("\n") if line.startswith("## ")] == ["Overview", "Usage", "API Reference", "Mine", "Fence", "License"]
    assert "own text" in out and "\nL\n" not in out and "\nU\n" in out and "old" not in out and out.startswith("# T\nintro")
    assert reports.merged("", new).startswith("## Overview\n\nO\n")
    assert reports.merged(out, new) == out


def test_debounce(spark):
    at, step = datetime(2024, 1, 1, tzinfo=UTC), timedelta(microseconds=1)
    gap = timedelta(seconds=2)
    times = [at, at + gap - step, at + 2 * gap - step, at + 3 * gap]
    df = spark.createDataFrame([(t, f"f{i}", "modified", False) for i, t in enumerate(times)], debounce.EVENT)
    assert sorted(r["n_events"] for r in debounce.batches(df, 2.0).collect()) == [1, 1, 2]


def test_stream(spark, tmp_path):
    at = datetime(2024, 1, 1, tzinfo=UTC)
    seconds = {"a.py": 0, "b.py": 1, "c.py": 3, "d.py": 6, "end": 60}
    source = tmp_path / "in"
    for i, (p, s) in enumerate(seconds.items()):
        spark.createDataFrame([(at + timedelta(seconds=s), p, "modified", False)], debounce.EVENT).coalesce(1).write.mode("append").parquet(str(source))
    got = []
    q = debounce.watch(spark.readStream.schema(debounce.EVENT).parquet(str(source)), got.append, str(tmp_path / "check"), 2.0, 0.1)
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [["a.py", "b.py"], ["c.py"], ["d.py"]]


def test_pending_changes():
    from lodestrata.streaming.debounce import Pending

    own = Pending(2.0, ["*.py"], ["**/test_*.py"])
    own.changed(["a.py", "b.txt", ".git/c.py", "t/test_x.py"], 10.0)
    assert own.due(11.9) == [] and own.due(12.0) == ["a.py"]
    own.changed(["x/b.py"], 12.5)
    assert own.due(14.0) == [] and own.due(14.5) == ["a.py", "x/b.py"]
    own.again(14.5)
    assert own.due(16.0) == [] and own.due(16.5) == ["a.py", "x/b.py"]
    own.changed(["c.py"], 17.0)
    own.done(["a.py", "x/b.py"])
    assert own.due(19.0) == ["c.py"] and Pending().is_wanted("any") and Pending().due(0) == []


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from lodestrata.sources import scratch

    told = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: None)))
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.base_folder(told(master))
    assert scratch.base_folder(told("local[4]"))
    table = scratch.written(spark.range(3))
    assert table.count() == 3 and table._shared_path.startswith(scratch.application_folder(spark))
    scratch.forget(table)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(table._shared_path).count()


def test_deep_graphs(spark):
    """Ways longer than the rounds after which tables are written anew."""
    from lodestrata.operators import graph

    n = graph.ROUNDS + 4
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(n)], "src string, dst string")
    nodes = chain.selectExpr("src as path").union(chain.selectExpr("dst")).distinct()
    assert {r["path"]: r["level"] for r in graph.levels(nodes, chain).collect()} == {f"n{i:03}": n - i for i in range(n + 1)}
    seeds = spark.createDataFrame([("n000",)], "seed string")
    assert graph.closure(chain, seeds).count() == n


def _any_graph(seed, n_folders, n_edges, across):
    """Edges in folders, and of the part `across` of them to others."""
    import random

    r = random.Random(seed)
    name = lambda f: f"p{f}/m{r.randrange(6)}"
    edges = [(name(f), name(r.randrange(n_folders) if r.random() < across else f)) for f in (r.randrange(n_folders) for _ in range(n_edges))]
    return [*edges, *edges[:5], ("top", "top2"), ("top2", "top")]


def _ways(edges):
    """For each file those that it reaches."""
    out = {a: set() for e in edges for a in e}
    for a in out:
        todo = [a]
        while todo:
            v = todo.pop()
            new = {y for x, y in edges if x == v} - out[a]
            out[a] |= new
            todo += new
    return out


def _sccs(edges):
    """The least member of each file's component of more than one file."""
    ways = _ways(edges)
    own = {a: [b for b in ways if b == a or b in ways[a] and a in ways[b]] for a in ways}
    return {a: min(v) for a, v in own.items() if len(v) > 1}


def test_folders_components(spark, rows, monkeypatch):
    """Folders without edges to others need no rounds; the others are solved as before."""
    near = _any_graph(1, 20, 120, 0.0)
    odd = spark.createDataFrame([(None, "top"), ("top", None)], "src string, dst string")
    frame = lambda e: spark.createDataFrame(e, "src string, dst string").union(odd)
    far = near + [("p1/m1", "p2/m1"), ("p2/m1", "p1/m1")]
    assert rows(graph.components(frame(far))) == sorted(_sccs(far).items(), key=repr)
    monkeypatch.setattr(graph, "_components_in_rounds", None)
    assert rows(graph.components(frame(near))) == sorted(_sccs(near).items(), key=repr)


def _cycles(edges):
    own, out = _sccs(edges), {(a, (a, b)) for a, b in edges if a == b}
    for root in set(own.values()):
        ways, closed = [(root,)], []
        while not closed:
            ways = [(*w, b) for w in ways for a, b in set(edges) if a == w[-1] and a != b and own.get(b) == root and b not in w[1:]]
            closed = [w for w in ways if w[-1] == root]
        out.add((root, min(closed)))
    return sorted(((a, list(w)) for a, w in out), key=repr)


def test_folders_cycles(spark, rows, monkeypatch):
    """Ties by path, files that import themselves, folders beyond the bound of a task, and batches that end anywhere."""
    near = _any_graph(2, 12, 90, 0.0)
    frame = lambda e: spark.createDataFrame(e, "src string, dst string")
    rounds = graph._cycles_in_rounds
    monkeypatch.setattr(graph, "_cycles_in_rounds", None)
    assert rows(graph.cycles(frame(near))) == _cycles(near)
    monkeypatch.setattr(graph, "_cycles_in_rounds", rounds)
    monkeypatch.setattr(graph.folders, "MOST", 12)
    monkeypatch.setattr(graph.folders, "BATCH", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        large = near + [(f"big/{i:02}", f"big/{(i + 1) % 20:02}") for i in range(20)]
        assert rows(graph.cycles(frame(large))) == _cycles(large)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_folders_levels(spark, rows, monkeypatch):
    """Only files of nodes end a way; levels are null on cycles and above them."""
    e = [("p/a", "p/b"), ("p/b", "p/c"), ("p/a", "p/c"), ("q/a", "q/a"), ("q/b", "q/a"), ("q/c", "q/x"), ("q/x", "q/y"), ("q/y", "q/x"), ("r/new", "r/a")]
    n = ["p/a", "p/b", "p/c", "q/a", "q/b", "q/c", "r/a", "r/a", "alone", None]
    edges, nodes = spark.createDataFrame(e, "src string, dst string"), spark.createDataFrame([(x,) for x in n], "path string")
    want = rows(graph._levels_in_rounds(nodes, edges))
    assert ("r/new", 1) in want and ("q/c", 0) in want and ("q/b", None) in want and (None, 0) in want
    monkeypatch.setattr(graph, "_levels_in_rounds", None)
    assert rows(graph.levels(nodes, edges)) == want


def _meant(files):
    """src, import, dst by trying path after path; files: path, imports, language."""
    import posixpath

    names, out = {f[0] for f in files if f[0] is not None}, set()
    for src, imports, language in files:
        folders = (src or "").split("/")[:-1]
        for imp in {x for x in imports or [] if x is not None}:
            tried = []
            if language == "python":
                dots = len(imp) - len(imp.lstrip("."))
                rest = imp[dots:].replace(".", "/")
                module = "/".join(folders[: max(len(folders) - dots + 1, 0)] + [rest] * bool(rest)) if dots else rest
                tried = [f"{module}.py", f"{module}/__init__.py"] if module else ["..py", "__init__.py"]
            elif language in graph.SCRIPTS and imp.startswith(("./", "../")):
                at = posixpath.normpath("/" + "/".join([*folders, imp])).lstrip("/")
                tried = [at] if at.endswith(tuple(graph.SCRIPT_SUFFIXES)) else [at, *(at + s for s in graph.SCRIPT_SUFFIXES), *(f"{at}/index{s}" for s in graph.SCRIPT_SUFFIXES)]
            out |= {(src, imp, next(x for x in tried if x in names))} if any(x in names for x in tried) else set()
    return sorted(out, key=repr)


def test_resolve_tries_paths_in_order(spark, rows):
    """Each import is one row until it meets a file, and means the first of the paths that it could."""
    files = [
        ("a/b/m.py", [".", "..", "...", "....", ".x", "..x", "a", "a.b", "a.b.x", "x", "none", None, "...none"], "python"), ("top.py", [".", "..", ".a", "a", "top", ".py"], "python"),
        ("a/b/x.py", [".m", "a.b.m", "..b"], "python"), ("a/b/x/__init__.py", [], "python"), ("a/x/__init__.py", None, "python"), ("a/b/__init__.py", [".x"], "python"), ("a/__init__.py", ["."], "python"),
        ("__init__.py", ["."], "python"), ("..py", ["top"], "python"), (".py", [], "python"), ("a.py", ["a"], "python"), ("none.go", ["a"], "go"), ("none", ["./a"], None), (None, ["a"], "python"),
        ("w/x.js", ["./y", "./y.js", "./y.ts", "../w/y", "react", "./d", "./d/index", "./x.js", "./none", "..", "../", "./", "../../../top", "./e"], "javascript"), ("w/y.ts", ["./x", "./x"], "typescript"), ("w/y", [], None),
        ("w/y.js.js", ["./y.js", "./y.js.js"], "jsx"), ("w/d/index.tsx", ["..", "../x", "./index"], "tsx"), ("w/d/index.js", [], "javascript"), ("w/e.cjs", [], None), ("w/e/index.js", [], None), ("top.js", ["./w/x"], "javascript"), ("w/index.mjs", [], None),
    ]
    nodes = spark.createDataFrame(files + files[:3], "path string, imports array<string>, language string")
    assert rows(graph.resolve(nodes)) == _meant(files)
    assert rows(graph.resolved_edges(nodes)) == sorted({(a, c) for a, _, c in _meant(files)}, key=repr)
    one = spark.createDataFrame([("w/x.js", ["./y", "../z"], "javascript")], nodes.schema)
    assert graph._named(one, False).count() == 2


@pytest.mark.parametrize("name", ["relative_imports", "script_imports", "import_resolve"])
def test_files_are_never_broadcast(spark, name):
    from lodestrata.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_counted_commits(spark, rows):
    """Commits, their lines and how many these are come from one pass over the lines."""
    from lodestrata.operators import history

    log = "\n".join(["h1234567890|a|0|one | bar", "1\t2\tx", "-\t-\ty", "z\t1\tw", "", "3\t3\tlost", "a|b", "4\t4\tlost", "h2|b|x|none", "h3|c|60|", "5\t6\tq\tmore", "|||"])
    logs = spark.createDataFrame([("r", log), ("empty", ""), ("null", None)], "repo string, text string")
    got = [tuple(r) for r in history.counted_commits(logs).drop("date").orderBy("ord").collect()]
    assert got == [("r", 0, "h1234567", "a", "one | bar", 1, 2, 3), ("r", 8, "h2", "b", "none", 0, 0, 0), ("r", 9, "h3", "c", "", 5, 6, 1), ("r", 11, "", "", "", 0, 0, 0)]
    commits, files = history.parse_log(logs)
    assert commits.columns == ["repo", "ord", "hash", "author", "date", "message", "insertions", "deletions"] and files.count() == 4
    plan = history.counted_commits(logs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
