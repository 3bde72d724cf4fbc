"""Scans of a working tree, state on disk, settings, and the command line."""

import json
import subprocess

import pytest

from lodestrata import cli
from lodestrata.plans.scan import scan
from lodestrata.sources import state, tree
from lodestrata.sources.config import Config, ConfigError

TREE = {
    "pkg/__init__.py": "", "pkg/a.py": "from . import b\nimport pkg.c\n\ndef run(x):\n    return x\n", "pkg/b.py": "from pkg import a\n", "pkg/c.py": "import os\nimport pkg.a\n", "pkg/latest.py": "import pkg.a\n",
    "a.py": "def one(): pass\n", "a/b.py": "def two(): pass\n", "web/x.js": "import y from './y'\n", "web/y.js": "export class K { m() {} }\n", "build/skip.py": "x\n", "k.egg-info/z.py": "x\n",
    "README.md": "# T\n\n## Mine\nkept\n", "LICENSE": "x", "pyproject.toml": "", "notes.txt": "x", "_p.py": "\xff",
}


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "demo"
    for p, t in TREE.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(t.encode("latin-1"))
    git = lambda *w: subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@b.c", *w], cwd=root, check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "Add everything that the demo needs")
    return root


def test_scan(spark, repo):
    first = scan(spark, str(repo))
    files = {r["path"]: r for r in first.files.collect()}
    assert set(files) == set(TREE) - {"build/skip.py", "k.egg-info/z.py", "notes.txt"}
    assert {r["change_type"] for r in files.values()} == {"added"} and files["a.py"]["semantic_category"] == "additive" and files["_p.py"]["ast_hash"] is None
    assert {(r["src"], r["dst"]) for r in first.edges.collect()} == {
        ("pkg/a.py", "pkg/__init__.py"), ("pkg/a.py", "pkg/c.py"), ("pkg/b.py", "pkg/__init__.py"), ("pkg/c.py", "pkg/a.py"), ("pkg/latest.py", "pkg/a.py"), ("web/x.js", "web/y.js"),
    }
    document = state.document_of(first.files, first.edges, {"name": "demo"})
    again = state.files_of(spark, json.loads(json.dumps(document)))
    (repo / "a.py").write_text("def one(y): pass\ndef new(): pass\n")
    (repo / "a/b.py").unlink()
    (repo / "pkg/c.py").write_text("import os\nimport pkg.a\n# note\n")
    second = scan(spark, str(repo), again)
    got = {r["path"]: (r["change_type"], r["semantic_category"]) for r in second.changes.collect()}
    assert got["a.py"] == ("modified", "additive") and got["a/b.py"] == ("deleted", "breaking") and got["pkg/c.py"] == ("modified", "docs-only") and got["pkg/a.py"] == ("unchanged", None)
    kept = {r["path"]: r for r in second.files.collect()}
    assert "a/b.py" not in kept and [d["name"] for d in kept["pkg/a.py"]["definitions"]] == ["run"]
    one = second.summary.first()
    assert one["modified"] == 2 and one["deleted"] == 1 and one["added"] == 0 and one["total_files"] == len(files)


def test_no_repository(tmp_path):
    with pytest.raises(tree.RepositoryNotFound):
        tree.Repository.at(tmp_path)
    assert cli.main(["--root", str(tmp_path), "scan"]) == 1 and tree.log_text(str(tmp_path)) == ""


def test_command_line(spark, repo, capsys):
    run = lambda *w: cli.main(["--root", str(repo), *w])
    assert run("init") == 0 and run("init") == 1 and run("init", "--force") == 0
    assert run("scan", "-n", "-v") == 0 and "13 added" in capsys.readouterr().out.replace(str(len(TREE) - 3) + " added", "13 added")
    assert run("scan") == 0 and run("scan") == 0 and "0 added, 0 modified" in capsys.readouterr().out
    assert run("generate", "readme") == 0
    text = (repo / "README.md").read_text()
    assert "## Mine\n\nkept" in text and "A python project" in text and "pip install -e ." in text and "Found 1 circular dependency chain(s)" in text and "a.py → c.py → a.py" in text
    assert run("generate", "resume", "-v", "-s", "concise") == 0 and "Implemented Add everything" in capsys.readouterr().out
    assert run("generate", "resume", "-o", str(repo / "out.json")) == 0 and json.loads((repo / "out.json").read_text())["total_bullets"] >= 2


@pytest.mark.parametrize("content", [None, "", "[]", "{", '{"repo": {}, "files": {}}'])
def test_bad_state(tmp_path, content):
    at = tmp_path / "state.json"
    if content is not None:
        at.write_text(content)
    assert state.load(at) == state.default()


def test_old_state(tmp_path):
    at = tmp_path / "x" / "state.json"
    state.save(at, {"version": "1.0", "repo": {}, "last_scan": None, "files": {}})
    assert state.load(at)["version"] == "1.1" and "dependency_graph" in state.load(at)


def test_snapshot_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1")], "path string, hash string")
    for k in ("one", "two"):
        state.append(rows, str(tmp_path / "t"), k)
    assert state.read(spark, str(tmp_path / "t"), "two").count() == 1 and state.read(spark, str(tmp_path / "t")).count() == 2


def test_settings(tmp_path):
    pytest.importorskip("yaml")
    at = tmp_path / "c" / "config.yaml"
    Config().save(at)
    assert Config.load(at) == Config() and Config.load(tmp_path / "none") == Config()
    assert "# The import graph" in at.read_text() and all(f"\n{k}:" in at.read_text() for k in Config.__dataclass_fields__)
    at.write_text("watch: {debounce: 5, odd: 1}\nast_parsing:\n  strict: true\nreadme_sections: [title, structure]\ninclude_patterns:\nodd: 1\n")
    own = Config.load(at)
    assert own.watch.debounce == 5 and own.ast_parsing.strict and own.sections() == ["overview", "structure"] and own.include_patterns == Config().include_patterns
    assert Config().sections() is None
    for bad in ("[1]", "watch: 3", "a: ["):
        at.write_text(bad)
        with pytest.raises(ConfigError):
            Config.load(at)


def test_settings_are_honoured(spark, repo):
    of = lambda **x: Config.of(x)
    paths = lambda c: {r["path"]: r for r in scan(spark, str(repo), settings=c).changes.collect()}
    every = paths(Config())
    assert set(paths(of(exclude_patterns=["web/*"]))) == {p for p in every if not p.startswith("web/")}
    assert set(paths(of(include_patterns=["*.js"]))) == {"web/x.js", "web/y.js"}
    only = paths(of(ast_parsing={"languages": ["javascript"]}))
    assert only["web/y.js"]["ast_hash"] and not only["a.py"]["ast_hash"] and set(only) == set(every)
    assert not paths(of(ast_parsing={"skip_patterns": ["a.py"]}))["a.py"]["ast_hash"] and not any(r["ast_hash"] for r in paths(of(ast_parsing={"enabled": False})).values())
    for key in ("enabled", "classify_changes"):
        assert not any(r["semantic_category"] for r in paths(of(semantic_analysis={key: False})).values())
    assert scan(spark, str(repo), settings=of(dependency_analysis={"enabled": False})).edges.isEmpty() and not scan(spark, str(repo)).edges.isEmpty()


def test_stored_graph(spark, repo):
    done = scan(spark, str(repo))
    document = json.loads(json.dumps(state.document_of(done.files, done.edges, {})))
    nodes, edges = state.graph_of(spark, document)
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, done.edges.collect())) and {r["path"] for r in nodes.collect()} == {r["path"] for r in done.files.collect()}
    assert state.graph_of(spark, state.default())[1].isEmpty()


def test_without_git(repo, monkeypatch):
    """Where git is not installed branch and commit are unknown and the log is empty."""
    commit = tree.Repository.at(repo).commit
    assert commit != "unknown" and len(commit) < 20
    monkeypatch.setenv("PATH", "")
    own = tree.Repository.at(repo)
    assert own.branch == own.commit == "unknown" and tree.log_text(str(repo)) == ""


def test_watch(spark, repo, monkeypatch, capsys):
    """A change leads to a scan after a pause; a scan that fails is tried again; files that go meanwhile do no harm."""
    assert cli.main(["--root", str(repo), "init"]) == 0 and cli.main(["--root", str(repo), "scan"]) == 0
    real, calls, looks = cli._scan, [], []

    def failing(*a):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("disk is away")
        return real(*a)

    def stop():
        looks.append(1)
        if len(looks) == 2:
            (repo / "a.py").write_text("def one(y): pass\n")
            (repo / "notes.txt").write_text("not watched")
        return len(calls) >= 2 or len(looks) > 200

    monkeypatch.setattr(cli, "_scan", failing)
    args = type("Args", (), {"root": str(repo), "verbose": True, "debounce": 0.0, "interval": 0.01, "no_readme": False})
    assert cli.watch_command(args, Config(), stop) == 0 and len(calls) == 2
    said = capsys.readouterr()
    assert "disk is away" in said.err and "0 added, 1 modified, 0 deleted" in said.out and "changed: a.py" in said.out and "notes.txt" not in said.out
    assert "## Overview" in (repo / "README.md").read_text()
