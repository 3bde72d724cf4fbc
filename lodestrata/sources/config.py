"""Settings, read from and written as YAML.  Defaults leave results as they are; what is set otherwise is honoured."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import paths

# The default settings.
LANGUAGES = ["python", "javascript", "typescript", "rust", "go"]
SKIPPED = ["*.min.js", "*_pb2.py", "*.generated.*"]
INCLUDED = [
    "*.py", "*.js", "*.ts", "*.tsx", "*.jsx", "*.java", "*.go", "*.rs", "*.rb", "*.php", "*.c", "*.cpp", "*.h", "*.hpp", "*.cs", "*.swift", "*.kt", "*.scala", "*.sh", "*.bash", "*.zsh",
    "README.*", "CHANGELOG.*", "CONTRIBUTING.*", "LICENSE*", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "requirements.txt", "setup.py", "setup.cfg",
]
EXCLUDED = [
    ".git/**", ".lodestrata/**", ".venv/**", "venv/**", "env/**", ".env/**", "node_modules/**", "__pycache__/**", ".pytest_cache/**", ".mypy_cache/**", ".tox/**", "dist/**", "build/**", ".eggs/**",
    "*.egg-info/**",
]
SECTIONS = ["title", "description", "features", "installation", "usage", "structure", "contributing", "license"]
#: What the names of sections in the settings mean.
SECTION_NAMES = {"title": "overview", "description": "overview"}
#: What a comment says about each key.
COMMENTS = {
    "include_patterns": "Globs of the files that a watch is about; other than the default ones, a scan is about them too",
    "exclude_patterns": "Globs of the files that it leaves out",
    "readme_sections": "Sections of the README; the default list stands for all of them",
    "ast_parsing": "Parsing; the default lists of languages and skipped files leave nothing out",
    "dependency_analysis": "The import graph; ordered: as one pass over the files in order would find it",
    "semantic_analysis": "Categories of changes",
    "watch": "Seconds of quiet after changes before a scan, and between looks",
    "verbose": "Defaults of the command line",
}


class ConfigError(Exception):
    """The file is no mapping or can't be read as YAML."""


@dataclass
class Watch:
    debounce: float = 2.0
    interval: float = 1.0


@dataclass
class Parsing:
    enabled: bool = True
    languages: list[str] = field(default_factory=lambda: list(LANGUAGES))
    skip_patterns: list[str] = field(default_factory=lambda: list(SKIPPED))
    strict: bool = False


@dataclass
class Dependencies:
    enabled: bool = True
    detect_cycles: bool = True
    ordered: bool = False


@dataclass
class Semantics:
    enabled: bool = True
    classify_changes: bool = True


@dataclass
class Config:
    include_patterns: list[str] = field(default_factory=lambda: list(INCLUDED))
    exclude_patterns: list[str] = field(default_factory=lambda: list(EXCLUDED))
    readme_sections: list[str] = field(default_factory=lambda: list(SECTIONS))
    ast_parsing: Parsing = field(default_factory=Parsing)
    dependency_analysis: Dependencies = field(default_factory=Dependencies)
    semantic_analysis: Semantics = field(default_factory=Semantics)
    watch: Watch = field(default_factory=Watch)
    verbose: bool = False
    dry_run: bool = False

    @classmethod
    def of(cls, values: dict) -> Config:
        """Settings from a mapping; keys that are missing or null have their defaults, unknown ones are left out."""
        out = cls()
        for name, kind in cls.__dataclass_fields__.items():
            given, own = values.get(name), getattr(out, name)
            if given is None:
                continue
            if kind.type in ("Parsing", "Dependencies", "Semantics", "Watch"):
                if not isinstance(given, dict):
                    raise ConfigError(f"{name} must be a mapping")
                given = type(own)(**{k: v for k, v in given.items() if k in own.__dataclass_fields__ and v is not None})
            elif isinstance(own, list):
                given = [str(x) for x in given] if isinstance(given, list) else [str(given)]
            setattr(out, name, given)
        return out

    @classmethod
    def load(cls, path: str | Path) -> Config:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("reading YAML needs the yaml package") from e
        try:
            values = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        except OSError:
            return cls()
        except yaml.YAMLError as e:
            raise ConfigError(str(e)) from e
        if not isinstance(values, dict):
            raise ConfigError("the settings must be a mapping")
        return cls.of(values)

    def parsed(self, path: Column, language: Column) -> Column:
        """Whether a file is parsed."""
        own = self.ast_parsing
        out = F.lit(own.enabled)
        if own.languages != LANGUAGES:
            out = out & F.coalesce(language.isin(*own.languages), F.lit(False))
        return out & ~paths.matches(path, own.skip_patterns) if own.skip_patterns != SKIPPED else out

    def scanned(self, path: Column) -> Column:
        """Whether a file that is there is scanned."""
        out = F.lit(True)
        if self.include_patterns != INCLUDED:
            out = out & paths.matches(path, self.include_patterns)
        return out & ~paths.matches(path, self.exclude_patterns) if self.exclude_patterns != EXCLUDED else out

    def sections(self) -> list[str] | None:
        """Names of the wanted sections, null for all."""
        return None if self.readme_sections in (SECTIONS, []) else [SECTION_NAMES.get(x, x) for x in self.readme_sections]

    def to_dict(self) -> dict:
        return asdict(self)

    def to_yaml(self) -> str:
        """The settings as YAML with comments, without needing a package for it."""

        def value(x) -> str:
            if isinstance(x, bool):
                return "true" if x else "false"
            if isinstance(x, int | float):
                return str(x)
            return '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'

        def block(values: dict, indent: str) -> list[str]:
            out = []
            for k, v in values.items():
                if not indent and k in COMMENTS:
                    out += ["", f"# {COMMENTS[k]}"]
                if isinstance(v, dict):
                    out += [f"{indent}{k}:", *block(v, indent + "  ")]
                elif isinstance(v, list):
                    out += [f"{indent}{k}:" + (" []" if not v else ""), *(f"{indent}  - {value(x)}" for x in v)]
                else:
                    out.append(f"{indent}{k}: {value(v)}")
            return out

        return "\n".join(["# Settings", *block(self.to_dict(), "")]) + "\n"

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(self.to_yaml(), encoding="utf-8")
