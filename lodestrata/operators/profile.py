"""What kind of project a snapshot is: languages, roles, frameworks, package manager, licence, entry points, public API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

# Names by which roles, managers and entry points are told.
CONFIG_NAMES = ["pyproject.toml", "package.json", "cargo.toml", "go.mod", "requirements.txt", "setup.py", "setup.cfg", "config.yaml"]
DOC_PREFIXES = ["readme", "changelog", "contributing", "license", "licence", "copying"]
LICENSE_NAMES = ["LICENSE", "LICENSE.TXT", "LICENSE.MD", "LICENCE", "LICENCE.TXT", "LICENCE.MD", "COPYING", "COPYING.TXT"]
STRONG_MANAGERS = {"pyproject.toml": "pip/poetry", "package.json": "npm/yarn", "Cargo.toml": "cargo", "go.mod": "go modules"}
WEAK_MANAGERS = ["requirements.txt", "setup.py"]
ENTRY_NAMES = ["main.py", "app.py", "index.js", "index.ts", "main.go", "main.rs"]
# Framework, family, what is looked at, and how it is compared.
FRAMEWORKS = [
    ("Django", "python", "import", "django"), ("Django", "python", "name", "settings.py"), ("Django", "python", "name", "wsgi.py"), ("Django", "python", "name", "asgi.py"),
    ("Django", "python", "path", "manage.py"), ("Flask", "python", "import", "flask"), ("FastAPI", "python", "import", "fastapi"), ("pytest", "python", "lower path", "pytest"),
    ("pytest", "python", "import", "pytest"), ("SQLAlchemy", "python", "import", "sqlalchemy"), ("Pandas", "python", "import", "pandas"), ("NumPy", "python", "import", "numpy"),
    ("React", "script", "import", "react"), ("React", "script", "end", ".jsx"), ("React", "script", "end", ".tsx"), ("Vue", "script", "import", "vue"), ("Vue", "script", "end", ".vue"),
    ("Angular", "script", "exact import", "@angular"), ("Express", "script", "import", "express"), ("Next.js", "script", "import", "next"), ("Next.js", "script", "name", "next.config.js"),
    ("Next.js", "script", "name", "next.config.ts"), ("Svelte", "script", "end", ".svelte"),
]


def primary_language(files: DataFrame) -> DataFrame:
    """One row: the commonest language; of equals the one whose first file comes first; `unknown` without any."""
    best = (
        files.where("language is not null").groupBy("language").agg(F.count("*").alias("n"), F.min(paths.parts(F.col("path"))).alias("first"))
        .orderBy(F.desc("n"), "first").limit(1)
    )
    return best.agg(F.coalesce(F.first("language"), F.lit("unknown")).alias("language"))


def license_file(files: DataFrame) -> DataFrame:
    own = files.where(F.upper(paths.name(F.col("path"))).isin(*LICENSE_NAMES))
    return own.agg(F.min_by("path", paths.parts(F.col("path"))).alias("license_file"))


def package_manager(files: DataFrame) -> DataFrame:
    """One row: the manager of the last file that names one for sure, else pip if anything hints at it, else null."""
    base = paths.name(F.col("path"))
    strong = F.try_element_at(F.create_map(*[F.lit(x) for kv in STRONG_MANAGERS.items() for x in kv]), base)
    own = files.select("path", strong.alias("strong"), base.isin(*WEAK_MANAGERS).alias("weak"))
    last = F.max_by("strong", F.when(F.col("strong").isNotNull(), paths.parts(F.col("path"))))
    return own.agg(F.coalesce(last, F.when(F.bool_or("weak"), F.lit("pip"))).alias("package_manager"))


def entry_points(files: DataFrame) -> DataFrame:
    return files.where(paths.name(F.col("path")).isin(*ENTRY_NAMES)).select("path")


def has_tests(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.bool_or(paths.about_tests(F.col("path"))), F.lit(False)).alias("has_tests"))


def frameworks(files: DataFrame, language: str) -> DataFrame:
    """framework: those that files (path, imports) of a project in that language point to."""
    family = "python" if language == "python" else "script" if language in ("javascript", "typescript") else None
    path = F.col("path")

    def test(what: str, x: str) -> Column:
        if what == "import":
            return F.exists("imports", lambda i: F.contains(F.lower(i), F.lit(x)))
        if what == "exact import":
            return F.exists("imports", lambda i: F.contains(i, F.lit(x)))
        if what == "name":
            return paths.name(path) == x
        if what == "end":
            return F.endswith(path, F.lit(x))
        return F.contains(F.lower(path) if what == "lower path" else path, F.lit(x))

    rules = [F.when(test(what, x), F.lit(name)) for name, of, what, x in FRAMEWORKS if of == family]
    found = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
    return files.select(F.explode(found).alias("framework")).distinct()


def roles(files: DataFrame, edges: DataFrame) -> DataFrame:
    """path, role: the first that fits of docs, config, tests, core, entry_points, other."""
    from . import graph

    own = files.select("path").join(graph.fan_in(edges), "path", "left").join(graph.fan_out(edges), "path", "left")
    base = F.lower(paths.name(F.col("path")))
    starts = F.lit(False)
    for p in DOC_PREFIXES:
        starts = starts | F.startswith(base, F.lit(p))
    role = (
        F.when(starts, "docs").when(base.isin(*CONFIG_NAMES), "config").when(paths.about_tests(F.col("path")), "tests").when(F.col("dependents") >= 3, "core")
        .when(F.col("dependents").isNull() & F.col("dependencies").isNotNull(), "entry_points").otherwise("other")
    )
    return own.select("path", role.alias("role"))


def profile(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row about a project (path, language, imports, definitions): language, frameworks, package_manager, has_tests,
    license_file, entry_points, imports, core_files, roles (how many files have each) and public_files.

    Numbers stand for lists that grow with the project; entry_points(), graph.core(), roles() and public_api() have them.
    """
    from . import graph

    language = primary_language(files)
    name = language.first()[0]
    count = lambda df, name: df.agg(F.count("*").alias(name))
    by_role = roles(files, edges).groupBy("role").agg(F.count("*").alias("n"))
    out = language
    for one in (
        frameworks(files, name).agg(F.array_sort(F.collect_set("framework")).alias("frameworks")), package_manager(files), has_tests(files), license_file(files), count(entry_points(files), "entry_points"),
        count(edges.distinct(), "imports"), count(graph.core(edges), "core_files"), by_role.agg(F.array_sort(F.collect_list(F.struct("role", "n"))).alias("roles")), count(public_api(files), "public_files"),
    ):
        out = out.crossJoin(one)  # one row each
    return out


def public_api(files: DataFrame) -> DataFrame:
    """path, definitions: those whose names do not begin with an underscore; files without any are left out."""
    own = F.filter("definitions", lambda d: ~F.startswith(d["name"], F.lit("_")))
    return files.select("path", own.alias("definitions")).where(F.size("definitions") > 0)


def first_of_each(files: DataFrame, most: int, order: list[Column] | None = None) -> DataFrame:
    """top, path, place, total: the first files of each top folder, and how many it has."""
    own = files.withColumn("top", paths.top_folder(F.col("path")))
    sized = own.groupBy("top").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("top").orderBy(*(order or [F.col("path")])))
    return own.withColumn("place", place).where(F.col("place") <= most).join(sized, "top").select("top", "path", "place", "total")


def api_listing(api: DataFrame, core_paths: DataFrame, files_a_module: int = 5, names: int = 5) -> DataFrame:
    """module, path, place, total, is_core, classes, functions: what an API reference shows."""
    own = api.join(core_paths.select("path", F.lit(True).alias("c")), "path", "left").withColumn("is_core", F.coalesce("c", F.lit(False)))
    top = first_of_each(own.select("path", "is_core", "definitions"), files_a_module, [F.desc("is_core"), F.col("path")])
    pick = lambda t: F.slice(F.transform(F.filter("definitions", lambda d: d["type"] == t), lambda d: d["name"]), 1, names)
    return top.join(own, "path").select(F.col("top").alias("module"), "path", "place", "total", "is_core", pick("class").alias("classes"), pick("function").alias("functions"))
