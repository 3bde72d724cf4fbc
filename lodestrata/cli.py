"""Command line: init, scan, generate readme, generate resume, watch."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import history
from .plans import reports
from .plans.scan import Scan, scan
from .sources import state, tree
from .sources.config import Config, ConfigError
from .streaming import debounce

FOLDER, STATE, CONFIG = ".lodestrata", "state.json", "config.yaml"


def session() -> SparkSession:
    return (
        SparkSession.builder.appName("lodestrata").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def _scan(spark: SparkSession, repo: tree.Repository, config: Config) -> tuple[Scan, dict]:
    document = state.load(Path(repo.root, FOLDER, STATE))
    old = state.files_of(spark, document)
    return scan(spark, repo.root, old, config), document


def _save(done: Scan, repo: tree.Repository) -> dict:
    document = state.document_of(done.files, done.edges, {"name": repo.name, "root": repo.root, "branch": repo.branch, "commit": repo.commit})
    state.save(Path(repo.root, FOLDER, STATE), document)
    return document


def _readme(spark: SparkSession, root: str, document: dict, config: Config) -> str:
    files, edges = state.files_of(spark, document).cache(), state.graph_of(spark, document)[1].cache()
    name = document["repo"].get("name", "Project")
    made = reports.sections(files, edges, name, wanted=config.sections(), detect_cycles=config.dependency_analysis.detect_cycles)
    at = Path(root, "README.md")
    return reports.merged(at.read_text(encoding="utf-8"), made) if at.exists() else reports.readme(made, name)


def init(args) -> int:
    repo = tree.Repository.at(args.root)
    folder = Path(repo.root, FOLDER)
    if (folder / STATE).exists() and not args.force:
        print(f"{folder} is there already; --force starts anew")
        return 1
    Config().save(folder / CONFIG)
    state.save(folder / STATE, state.default() | {"repo": {"name": repo.name}})
    print(f"Initialised {folder}")
    return 0


def scan_command(args, config: Config) -> int:
    repo = tree.Repository.at(args.root)
    done, _ = _scan(session(), repo, config)
    n = done.summary.first()
    print(", ".join(f"{n[k]} {k}" for k in ("added", "modified", "deleted", "unchanged")))
    if args.verbose or config.verbose:
        first = done.changes.where("change_type = 'added'").orderBy(F.split("path", "/")).limit(5).collect()
        for r in first:
            print(f"  + {r['path']}")
        if n["added"] > 5:
            print(f"  ... and {n['added'] - 5} more")
    if not (args.dry_run or config.dry_run):
        _save(done, repo)
    return 0


def readme_command(args, config: Config) -> int:
    repo = tree.Repository.at(args.root)
    text = _readme(session(), repo.root, state.load(Path(repo.root, FOLDER, STATE)), config)
    if args.verbose or config.verbose:
        for line in text.splitlines():
            if line.startswith("## "):
                print(line.removeprefix("## "))
    if args.dry_run or config.dry_run:
        print(text)
    else:
        Path(args.output or Path(repo.root, "README.md")).write_text(text, encoding="utf-8")
    return 0


def resume_command(args, config: Config) -> int:
    spark, repo = session(), tree.Repository.at(args.root)
    document = state.load(Path(repo.root, FOLDER, STATE))
    commits, commit_files = history.parse_log(tree.logs(spark, repo.root, args.limit))
    commits = history.with_files(commits, commit_files).cache()
    files = state.files_of(spark, document)
    ranked = history.bullets(history.stats(commits, commit_files, files, args.author), commits, files, document["repo"].get("name", "project"))
    if args.output:
        Path(args.output).write_text(json.dumps(json.loads(history.exported(ranked).first()[0]), indent=2), encoding="utf-8")
    else:
        for r in history.formatted(ranked, args.style, args.max_bullets).orderBy(F.desc("impact_score"), "gen_ord").collect():
            print(r["text"])
    if args.verbose:
        for r in history.categories(ranked).orderBy("category").collect():
            print(f"{r['category']}: {r['n']}")
    return 0


def seen(root: str) -> dict[str, int]:
    """When each file of a working tree was changed; files that go while this looks are left out."""
    out = {}
    for p in tree.names(root):
        with contextlib.suppress(OSError):
            out[p] = Path(root, p).stat().st_mtime_ns
    return out


def watch_command(args, config: Config, stop=lambda: False) -> int:
    """Scan again whenever the tree has been quiet after changes; a scan that fails is tried again after another pause."""
    repo, spark, c = tree.Repository.at(args.root), session(), config.watch
    verbose = args.verbose or config.verbose
    pending = debounce.Pending(c.debounce if args.debounce is None else args.debounce, config.include_patterns, config.exclude_patterns)
    last = seen(repo.root)
    while not stop():
        time.sleep(c.interval if args.interval is None else args.interval)
        now = seen(repo.root)
        changed = {p for p in last.keys() | now.keys() if last.get(p) != now.get(p)}
        last = now
        pending.changed(changed, time.monotonic())
        if verbose:
            for p in sorted(filter(pending.is_wanted, changed)):
                print(f"changed: {p}")
        batch = pending.due(time.monotonic())
        if not batch:
            continue
        try:
            done, _ = _scan(spark, repo, config)
            document, n = _save(done, repo), done.summary.first()
            print(", ".join(f"{n[k]} {k}" for k in ("added", "modified", "deleted")))
            if n["has_changes"] and not args.no_readme:
                at = Path(repo.root, "README.md")
                at.write_text(_readme(spark, repo.root, document, config), encoding="utf-8")
                last["README.md"] = at.stat().st_mtime_ns  # our own change is none
            pending.done(batch)
        except Exception as e:  # whatever it is, the next try may do
            print(f"error: {e}", file=sys.stderr)
            pending.again(time.monotonic())
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="lodestrata", description=__doc__)
    top.add_argument("--root", default=".")
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("init")
    a.add_argument("--force", action="store_true")
    a = sub.add_parser("scan")
    a.add_argument("-v", "--verbose", action="store_true")
    a.add_argument("-n", "--dry-run", action="store_true")
    gen = sub.add_parser("generate").add_subparsers(dest="what", required=True)
    a = gen.add_parser("readme")
    a.add_argument("-o", "--output")
    a.add_argument("-n", "--dry-run", action="store_true")
    a.add_argument("-v", "--verbose", action="store_true")
    a = gen.add_parser("resume")
    a.add_argument("-a", "--author")
    a.add_argument("-l", "--limit", type=int, default=50)
    a.add_argument("-m", "--max-bullets", type=int, default=5)
    a.add_argument("-s", "--style", default="standard", choices=["standard", "detailed", "concise"])
    a.add_argument("-o", "--output")
    a.add_argument("-v", "--verbose", action="store_true")
    a = sub.add_parser("watch")
    a.add_argument("-v", "--verbose", action="store_true")
    a.add_argument("-d", "--debounce", type=float)
    a.add_argument("-i", "--interval", type=float)
    a.add_argument("--no-readme", action="store_true")
    args = top.parse_args(argv)
    try:
        if args.command == "init":
            return init(args)
        config = Config.load(Path(args.root, FOLDER, CONFIG))
        if args.command == "scan":
            return scan_command(args, config)
        if args.command == "watch":
            return watch_command(args, config)
        return readme_command(args, config) if args.what == "readme" else resume_command(args, config)
    except (tree.RepositoryNotFound, ConfigError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 0


if __name__ == "__main__":
    sys.exit(main())
