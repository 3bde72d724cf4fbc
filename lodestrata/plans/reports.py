"""Reports on a snapshot: sections of a README as ranked aggregations, rendered and merged on the driver.

Every section is made from DataFrames that end in a handful of rows (top-k, counts, one row); only those reach the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import phrase
from ..operators import graph, profile

# Headings of sections that are written anew, their order, and how each manager installs.
GENERATED = ["Overview", "Installation", "Usage", "Project Structure", "Architecture", "API Reference", "Recent Changes"]
PRIORITY = {t: i for i, t in enumerate(GENERATED, 1)} | {"License": 99}
INSTALL = {
    "pip/poetry": ("# Install dependencies", "pip install -e ."), "pip": ("# Install dependencies", "pip install -r requirements.txt"),
    "npm/yarn": ("# Install dependencies", "npm install"), "cargo": ("# Build the project", "cargo build --release"), "go modules": ("# Build the project", "go build"),
}
RUN = {"python": "python {}", "javascript": "node {}", "typescript": "node {}", "go": "go run {}", "rust": "cargo run"}


@dataclass
class Section:
    name: str
    title: str
    content: str

    def rendered(self) -> str:
        return f"## {self.title}\n\n{self.content}\n"


def _one(df: DataFrame):
    return df.first()[0]


def _scanned(df: DataFrame, most: int | None = None) -> list[str]:
    own = df.orderBy(paths.parts(F.col("path")))
    return [r["path"] for r in (own.limit(most) if most else own).collect()]


def overview(files: DataFrame) -> Section:
    language = _one(profile.primary_language(files))
    built = _one(profile.frameworks(files, language).agg(phrase(F.array_sort(F.collect_set("framework")))))
    return Section("overview", "Overview", (f"A {language} project" if language != "unknown" else "A software project") + (f" built with {built}" if built else "") + ".")


def installation(files: DataFrame, name: str) -> Section:
    more = INSTALL.get(_one(profile.package_manager(files)))
    lines = ["```bash", "# Clone the repository", f"git clone https://github.com/username/{name}.git", f"cd {name}", *(["", *more] if more else []), "```"]
    return Section("installation", "Installation", "\n".join(lines))


def usage(files: DataFrame) -> Section:
    first = _scanned(profile.entry_points(files), 1)
    if not first:
        return Section("usage", "Usage", "<!-- Add usage instructions here -->")
    how = RUN.get(_one(profile.primary_language(files)))
    return Section("usage", "Usage", "\n".join(["```bash", how.format(first[0]), "```"]) if how else "")


def structure(files: DataFrame, edges: DataFrame) -> Section:
    core = graph.core(edges).select("path", F.lit(True).alias("is_core"))
    marked = files.select("path").join(core, "path", "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))
    counts = {r["top"]: r["n"] for r in marked.groupBy(paths.top_folder(F.col("path")).alias("top")).agg(F.count_if("is_core").alias("n")).collect()}
    shown = profile.first_of_each(files.select("path"), 5).join(marked, "path").orderBy("top", "place").collect()
    mark = lambda r: " (core)" if r["is_core"] else ""
    lines = ["```"] + [f"├── {r['path']}{mark(r)}" for r in shown if r["top"] == "_root"]
    for top in sorted({r["top"] for r in shown} - {"_root"}):
        own = [r for r in shown if r["top"] == top and r["place"] <= 3]
        lines.append(f"├── {top}/" + (f" ({counts[top]} core files)" if counts[top] else ""))
        lines += [f"│   ├── {r['path'][len(top) + 1 :]}{mark(r)}" for r in own]
        if own[0]["total"] > 3:
            lines.append(f"│   └── ... ({own[0]['total'] - 3} more files)")
    lines.append("```")
    n = {r["role"]: r["count"] for r in profile.roles(files, edges).groupBy("role").count().collect()}
    if n:
        lines += ["", "**Key Components:**", ""]
        said = (("core", "Core files", "central modules"), ("entry_points", "Entry points", "executable files"), ("tests", "Tests", "test files"))
        lines += [f"- **{title}**: {n[k]} {what}" for k, title, what in said if n.get(k)]
    return Section("structure", "Project Structure", "\n".join(lines))


def architecture(files: DataFrame, edges: DataFrame, detect_cycles: bool = True) -> Section | None:
    if files.isEmpty():
        return None
    lines = ["This section provides insights into the codebase architecture based on dependency analysis.", ""]
    if detect_cycles:
        found = graph.cycles(edges)
        n = found.count()
        if n:
            lines += ["### Circular Dependencies Detected", "", f"Found {n} circular dependency chain(s):", ""]
            for i, r in enumerate(found.orderBy("scc", "cycle").limit(3).collect(), 1):
                way = [x.rpartition("/")[2] for x in r["cycle"]]
                lines.append(f"{i}. " + " → ".join(way[:5]) + (" → ..." if len(way) > 5 else ""))
            lines += [""] + ([f"*...and {n - 3} more*", ""] if n > 3 else [])
    top = graph.core(edges).orderBy(F.desc("dependents"), "path").limit(10).collect()
    if top:
        lines += ["### Core Modules", "", "These modules are central to the codebase (imported by many files):", ""]
        lines += [f"- `{r['path']}` (imported by {r['dependents']} files)" for r in top] + [""]
    entries = _scanned(profile.roles(files, edges).where("role = 'entry_points'"), 5)
    if entries:
        lines += ["### Entry Points", "", "These files serve as entry points (not imported by other files):", "", *(f"- `{p}`" for p in entries), ""]
    alone = graph.isolated(files, edges).count()
    if alone:
        lines += ["### Isolated Files", "", f"{alone} file(s) have no dependencies and are not imported by other files.", ""]
    return Section("architecture", "Architecture", "\n".join(lines))


def api(files: DataFrame, edges: DataFrame) -> Section | None:
    rows = profile.api_listing(profile.public_api(files), graph.core(edges)).orderBy("module", "place").collect()
    if not rows:
        return None
    lines = ["This section provides an overview of the public API based on code analysis.", ""]
    for module in sorted({r["module"] for r in rows}):
        lines += ["### Root Level" if module == "_root" else f"### {module}", ""]
        own = [r for r in rows if r["module"] == module]
        for r in own:
            lines += [f"**`{r['path']}`**", *(["*(core module)*"] if r["is_core"] else []), ""]
            for title, listed in (("Classes:", r["classes"]), ("Functions:", r["functions"])):
                if listed:
                    lines += [title, *(f"- `{x}`" for x in listed), ""]
        if own[0]["total"] > 5:
            lines += [f"*...and {own[0]['total'] - 5} more files*", ""]
    return Section("api", "API Reference", "\n".join(lines))


def recent_changes(files: DataFrame) -> Section | None:
    own = files.where(F.col("change_type").isin("added", "modified") & F.col("semantic_category").isin("breaking", "additive", "internal"))
    n = {r["semantic_category"]: r["count"] for r in own.groupBy("semantic_category").count().collect()}
    if not n:
        return None
    lines = []
    said = ("breaking", "### Breaking Changes", "The following files contain breaking API changes:"), ("additive", "### New Features", "The following files contain new functionality:")
    for kind, title, what in said:
        if n.get(kind):
            lines += [title, "", what, "", *(f"- `{p}`" for p in _scanned(own.where(F.col("semantic_category") == kind), 10)), ""]
    if n.get("internal"):
        lines += ["### Internal Changes", "", f"{n['internal']} files have internal implementation changes without API modifications.", ""]
    return Section("recent_changes", "Recent Changes", "\n".join(lines))


def licence(files: DataFrame) -> Section:
    at = _one(profile.license_file(files))
    return Section("license", "License", f"This project is licensed under the terms specified in [`{at}`]({at})." if at else "<!-- Add license information here -->")


def sections(files: DataFrame, edges: DataFrame, name: str, advanced: bool = True, wanted: list[str] | None = None, detect_cycles: bool = True) -> list[Section]:
    made = [overview(files), installation(files, name), usage(files), structure(files, edges)]
    if advanced:
        made += [architecture(files, edges, detect_cycles), api(files, edges), recent_changes(files)]
    made.append(licence(files))
    return [s for s in made if s and (not wanted or s.name in wanted)]


def readme(made: list[Section], name: str) -> str:
    return f"# {name}\n\n" + "\n".join(s.rendered() for s in made)


def split_sections(text: str) -> dict[str, str]:
    """Title -> content of level-two sections; `_preamble` is what stands before them."""
    heads = list(re.finditer(r"^## (.+)$", text, re.MULTILINE))
    out = {}
    before = text[: heads[0].start()].strip() if heads else text.strip()
    if before or not heads:
        out["_preamble"] = before
    for m, after in zip(heads, [*heads[1:], None]):
        out[m[1].strip()] = text[m.end() : after.start() if after else len(text)].strip()
    return out


def merged(existing: str, made: list[Section]) -> str:
    """existing with its generated sections replaced and new ones put where they belong; the user's own text stays."""
    if not existing.strip():
        return "\n".join(s.rendered() for s in made)
    new = {s.title: s.content for s in made}
    out = [(t, new.pop(t) if t in GENERATED and t in new else c) for t, c in split_sections(existing).items()]
    have = {t for t, _ in out}
    for title, content in new.items():
        if title in have:
            continue
        rank = PRIORITY.get(title, 50)
        later = (i for i, (t, _) in enumerate(out) if t != "_preamble" and PRIORITY.get(t, 50) > rank)
        out.insert(next(later, len(out)), (title, content))
    return "\n".join(f"{c}\n" if t == "_preamble" else f"## {t}\n\n{c}\n" for t, c in out).strip() + "\n"
