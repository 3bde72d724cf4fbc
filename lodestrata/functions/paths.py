"""Columns about repository paths: parts, names, suffixes, languages, and which files count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of source files and their languages.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".java": "java", ".go": "go",
    ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
}
# Suffixes that the parsers know.
PARSER_LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx", ".mjs": "javascript", ".cjs": "javascript"}
# Fixed values, but for the folder of our own state: names of folders that are never scanned.
IGNORED = [".git", ".lodestrata", ".venv", "venv", "env", ".env", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", "dist", "build", ".eggs"]
IGNORED_END = ".egg-info"
# Files that are scanned whatever their suffix.
ALWAYS = [
    "README.md", "README.rst", "README.txt", "CHANGELOG.md", "CONTRIBUTING.md", "LICENSE", "LICENSE.md", "pyproject.toml", "package.json",
    "Cargo.toml", "go.mod", "requirements.txt", "setup.py", "setup.cfg",
]


def parts(path: Column) -> Column:
    """The components of a path; arrays of them sort in scan order."""
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last suffix with its dot; empty for names like `.py` and for names that end in a dot."""
    return F.regexp_extract(name(path), r"^.+?(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.left(path, F.length(path) - F.length(name(path)) - 1)).otherwise(F.lit(""))


def top_folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("_root"))


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def language(path: Column) -> Column:
    """Language by suffix, null if unknown."""
    return _looked_up(F.lower(suffix(path)), LANGUAGES)


def parser_language(suffix_: Column) -> Column:
    return _looked_up(F.lower(suffix_), PARSER_LANGUAGES)


def is_parsed(language_: Column) -> Column:
    """Whether there is a parser for a language."""
    return F.coalesce(F.lower(language_).isin(*set(PARSER_LANGUAGES.values())), F.lit(False))


def is_ignored(path: Column) -> Column:
    """Whether any component, the name included, is a folder that is never scanned."""
    own = parts(path)
    return F.arrays_overlap(own, F.array(*map(F.lit, IGNORED))) | F.exists(own, lambda x: x.endswith(IGNORED_END))


def is_source(path: Column) -> Column:
    """Whether a file is scanned: a known suffix or one of the names that always count."""
    return F.lower(suffix(path)).isin(*LANGUAGES) | name(path).isin(*ALWAYS)


def about_tests(path: Column) -> Column:
    """Whether the path mentions test or spec anywhere; `latest` and `inspect` do."""
    return F.lower(path).rlike("test|spec")


def below(root: Column, path: Column) -> Column:
    """An absolute path relative to its root."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def absolute(root: Column, path: Column) -> Column:
    return F.concat_ws("/", root, path)


def normalised(components: Column) -> Column:
    """A path from components with `.` and `..` resolved; `..` at the top stays at the top."""
    empty = F.array().cast("array<string>")
    step = lambda done, x: (
        F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    )
    return F.array_join(F.aggregate(components, empty, step), "/")


def glob(pattern: str) -> str:
    """A regular expression for a glob that matches from the right; `*` and `**` stand for one component's worth of
    characters."""
    rule = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".^$+{}[]|()\\" else c for c in pattern.replace("**", "*"))
    return f"(^|/){rule}$"


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether any glob matches."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob(p))
    return out
