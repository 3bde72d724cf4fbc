"""Every query over the driver tables, and SQL that gives the same rows.

The driver tables hold no source code, imports or commits, so code-shaped inputs are derived from their columns; the SQL
side takes the expected rows straight from those columns wherever it can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, paths, text
from ..operators import definitions, graph, history, profile, snapshot
from ..streaming import debounce
from . import reports, scan

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(line.strip() for line in sql.splitlines())  # blanks inside literals stay
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of part, dealt out to all cores: a few MB of Parquet, which one task would read, are work for many."""
    return table(spark, sf_dir, "part").select(*columns).repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")


# --- snapshots of documents

OLD = "select 'doc_' || cast(doc_id as string) as path, case when doc_id % 7 = 0 then text || ' ' else text end as content from documents where doc_id % 11 <> 0"
NEW = "select 'doc_' || cast(doc_id as string) as path, text as content from documents where doc_id % 13 <> 0"


def _hashed(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.where("doc_id % 13 <> 0") if new else docs.where("doc_id % 11 <> 0").selectExpr("doc_id", "case when doc_id % 7 = 0 then text || ' ' else text end as text")
    return docs.selectExpr("'doc_' || cast(doc_id as string) as path", "text").select("path", snapshot.content_hash(F.col("text")).alias("hash"))


_DIFF = f"""with a as ({NEW}), b as ({OLD}), d as (
 select coalesce(a.path, b.path) as path, sha256(a.content) as new_hash, sha256(b.content) as old_hash from a full join b on a.path = b.path), t as (
 select path, case when old_hash is null then 'added' when new_hash is null then 'deleted' when old_hash <> new_hash then 'modified' else 'unchanged' end as change_type, old_hash, new_hash from d)"""


@query("select doc_id, sha256(text) as content_hash from documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", snapshot.content_hash(F.col("text")).alias("content_hash"))


@query(f"{_DIFF} select * from t")
def snapshot_diff(spark, sf_dir):
    return snapshot.diff(_hashed(spark, sf_dir, True), _hashed(spark, sf_dir, False))


@query("""select count_if(doc_id % 11 = 0 and doc_id % 13 <> 0) as added, count_if(doc_id % 11 <> 0 and doc_id % 13 <> 0 and doc_id % 7 = 0) as modified,
 count_if(doc_id % 11 <> 0 and doc_id % 13 = 0) as deleted, count_if(doc_id % 11 <> 0 and doc_id % 13 <> 0 and doc_id % 7 <> 0) as unchanged,
 count_if(doc_id % 11 <> 0 or doc_id % 13 <> 0) as total_files, true as has_changes from documents""")
def scan_summary(spark, sf_dir):
    return snapshot.summary(snapshot_diff(spark, sf_dir))


@query("select 'doc_' || cast(doc_id as string) as path from documents where doc_id % 13 = 0 and doc_id % 11 <> 0")
def deleted_files(spark, sf_dir):
    return snapshot.deleted(_hashed(spark, sf_dir, True), _hashed(spark, sf_dir, False))


@query(f"with b as ({OLD}) select path, sha256(content) as hash from b where path not in (select path from ({NEW}) where content is not null) union all select path, sha256(content) from ({NEW})")
def snapshot_upsert(spark, sf_dir):
    return snapshot.upsert(_hashed(spark, sf_dir, False), _hashed(spark, sf_dir, True))


@query("select 'doc_' || cast(doc_id as string) as path, sha256(case when doc_id % 7 = 0 then text || ' ' else text end) as hash from documents where doc_id % 11 <> 0 and doc_id % 13 = 0")
def snapshot_remove(spark, sf_dir):
    return snapshot.remove(_hashed(spark, sf_dir, False), _hashed(spark, sf_dir, True))


# --- files with paths made from documents

_NAME = """case doc_id % 12 when 0 then 'test_' || cast(doc_id as string) || '.py' when 1 then 'm' || cast(doc_id as string) || '.py' when 2 then 'x' || cast(doc_id as string) || '.js'
 when 3 then 'x' || cast(doc_id as string) || '.tsx' when 4 then 'README.md' when 5 then 'notes' || cast(doc_id as string) || '.txt' when 6 then 'setup.py' when 7 then 'requirements.txt'
 when 8 then 'main.py' when 9 then 'LICENSE' when 10 then 'a' || cast(doc_id as string) || '.go' else 'pyproject.toml' end"""
_FOLDER = """(case when doc_id % 17 = 0 then 'build/' when doc_id % 19 = 0 then '.git/' when doc_id % 23 = 0 then 'k.egg-info/' else '' end) || source || '/' || lang || '/d' || cast(doc_id as string) || '/'"""
PATH = f"case when doc_id % 29 = 0 then 'm' || cast(doc_id as string) || '.py' else {_FOLDER} || {_NAME} end"
IMPORTS = "split(case when doc_id % 50 = 3 then 'django.db,os' when doc_id % 50 = 4 then 'Flask' when doc_id % 50 = 5 then 'numpy,pandas.io' when doc_id % 50 = 6 then 'react' else 'sys' end, ',')"
_KIND = "case when doc_id % 29 = 0 then 1 else doc_id % 12 end"
_LANGUAGE = f"case {_KIND} when 0 then 'python' when 1 then 'python' when 2 then 'javascript' when 3 then 'typescript' when 6 then 'python' when 8 then 'python' when 10 then 'go' end"
FILES = f"select doc_id, {PATH} as path, {_KIND} as k, {_LANGUAGE} as language, {IMPORTS} as imports from documents"
_TO = "doc_id - doc_id % 20"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").selectExpr("doc_id", f"{PATH} as path", f"{IMPORTS} as imports")
    return own.withColumn("language", paths.language(F.col("path")))


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth file imports the first of its twenty."""
    own = files(spark, sf_dir).select("doc_id", "path")
    return own.where("doc_id % 5 = 1").selectExpr("path as src", f"{_TO} as to_id").join(own.selectExpr("doc_id as to_id", "path as dst"), "to_id").select("src", "dst")


_EDGES = f"e as (select a.path as src, b.path as dst from f a join f b on a.doc_id % 5 = 1 and b.doc_id = a.doc_id - a.doc_id % 20), i as (select dst as path, count(distinct src) as dependents from e group by 1)"


@query(f"with f as ({FILES}) select doc_id, path, language from f")
def language_map(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "path", "language")


@query(f"with f as ({FILES}) select path from f where k <> 5 and not (doc_id % 29 <> 0 and (doc_id % 17 = 0 or doc_id % 19 = 0 or doc_id % 23 = 0))")
def source_filter(spark, sf_dir):
    return files(spark, sf_dir).where(paths.is_source(F.col("path")) & ~paths.is_ignored(F.col("path"))).select("path")


@query(f"with f as ({FILES}) select path from f where doc_id % 29 <> 0 and (doc_id % 17 = 0 or doc_id % 19 = 0 or doc_id % 23 = 0)")
def ignored_paths(spark, sf_dir):
    return files(spark, sf_dir).where(paths.is_ignored(F.col("path"))).select("path")


@query(f"""with f as (select doc_id, {PATH} as path, case when doc_id % 29 = 0 then 'm' || cast(doc_id as string) || '.py' else {_NAME} end as name,
 case when doc_id % 29 = 0 then '' else rtrim({_FOLDER}, '/') end as parent, {_KIND} as k from documents)
 select path, name, parent, case k when 4 then '.md' when 5 then '.txt' when 7 then '.txt' when 9 then '' when 10 then '.go' when 11 then '.toml' when 2 then '.js' when 3 then '.tsx' else '.py' end as suffix,
 case when parent = '' then '_root' else string_split(parent, '/')[1] end as top from f""")
def path_functions(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", paths.name(p).alias("name"), paths.parent(p).alias("parent"), paths.suffix(p).alias("suffix"), paths.top_folder(p).alias("top"))


@query(f"""with f as ({FILES}) select path from f where (k in (1, 6, 8) and doc_id % 29 <> 0 or k = 2) and not path like '.git/%' and not path like 'build/%'""")
def watch_filter(spark, sf_dir):
    events = files(spark, sf_dir).where("not startswith(path, 'build/')").select("path", F.lit(False).alias("is_directory"))
    return debounce.wanted(events, ["**/*.py", "*.js"], ["**/test_*.py"]).select("path")


@query(f"""with f as ({FILES}) select path, case when k in (0, 1, 6, 8) then 'python' when k = 2 then 'javascript' when k = 3 then 'tsx' end as parser_language, coalesce(language in ('python', 'javascript', 'typescript'), false) as parsed,
 '/src/' || path as absolute, path as relative, case k when 0 then 'py' when 4 then 'one and two' else 'a, b, and c' end as said from f""")
def path_lookups(spark, sf_dir):
    p = F.col("path")
    items = F.when(paths.name(p) == "README.md", F.split(F.lit("one two"), " ")).when(paths.name(p).startswith("test_"), F.array(F.lit("py"))).otherwise(F.split(F.lit("a b c"), " "))
    own = files(spark, sf_dir).withColumn("absolute", paths.absolute(F.lit("/src"), p))
    return own.select("path", paths.parser_language(paths.suffix(p)).alias("parser_language"), paths.is_parsed(F.col("language")).alias("parsed"), "absolute", paths.below(F.lit("/src"), F.col("absolute")).alias("relative"), text.phrase(items).alias("said"))


@query(f"with f as ({FILES}) select language from f where language is not null group by 1 order by count(*) desc, min(string_split(path, '/')) limit 1")
def primary_language(spark, sf_dir):
    return profile.primary_language(files(spark, sf_dir))


@query(f"""with f as ({FILES}), {_EDGES}, o as (select distinct src as path from e)
 select f.path, case when k in (4, 9) then 'docs' when k in (6, 7, 11) then 'config' when k = 0 then 'tests' when i.dependents >= 3 then 'core'
 when i.path is null and o.path is not null then 'entry_points' else 'other' end as role from f left join i on f.path = i.path left join o on f.path = o.path""")
def role_categories(spark, sf_dir):
    return profile.roles(files(spark, sf_dir), file_edges(spark, sf_dir))


@query(f"with f as ({FILES}) select case when count_if(k = 11) > 0 then 'pip/poetry' when count_if(k in (6, 7)) > 0 then 'pip' end as package_manager from f")
def package_manager(spark, sf_dir):
    return profile.package_manager(files(spark, sf_dir))


@query(f"with f as ({FILES}) select path as license_file from f where k = 9 order by string_split(path, '/') limit 1")
def license_file(spark, sf_dir):
    return profile.license_file(files(spark, sf_dir))


@query(f"with f as ({FILES}) select path from f where k = 8")
def entry_points(spark, sf_dir):
    return profile.entry_points(files(spark, sf_dir))


@query(f"with f as ({FILES}) select count_if(k = 0) > 0 as has_tests from f")
def has_tests(spark, sf_dir):
    return profile.has_tests(files(spark, sf_dir))


_FRAMEWORKS = """select distinct case doc_id % 50 when 3 then 'Django' when 4 then 'Flask' when 5 then 'NumPy' end as framework from documents where doc_id % 50 in (3, 4, 5)
 union select 'Pandas' from documents where doc_id % 50 = 5"""
_ROLES = f"""o as (select distinct src as path from e), rl as (select f.path, case when k in (4, 9) then 'docs' when k in (6, 7, 11) then 'config' when k = 0 then 'tests' when i.dependents >= 3 then 'core'
 when i.path is null and o.path is not null then 'entry_points' else 'other' end as role from f left join i on f.path = i.path left join o on f.path = o.path)"""
_CORE = "core as (select * from i where dependents >= 3 and not regexp_matches(lower(path), 'test|spec'))"


def described_files(spark, sf_dir):
    """files() with two definitions each, one of them private, and with what a scan found."""
    own = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").selectExpr(
        "doc_id", f"{PATH} as path", f"{IMPORTS} as imports", "case doc_id % 3 when 0 then 'added' when 1 then 'modified' else 'unchanged' end as change_type",
        "case doc_id % 5 when 0 then 'breaking' when 1 then 'additive' when 2 then 'internal' end as semantic_category",
        "case when doc_id % 4 = 3 then array() else array(named_struct('name', concat('f', doc_id), 'type', if(doc_id % 2 = 0, 'class', 'function')), named_struct('name', '_p', 'type', 'function')) end as definitions",
    )
    return own.withColumn("language", paths.language(F.col("path")))


@query(f"""with f as ({FILES}), {_EDGES}, {_ROLES}, {_CORE}, fw as ({_FRAMEWORKS})
 select (select language from f where language is not null group by 1 order by count(*) desc, min(string_split(path, '/')) limit 1) as language, (select string_agg(framework, ',' order by framework) from fw) as frameworks,
 (select case when count_if(k = 11) > 0 then 'pip/poetry' when count_if(k in (6, 7)) > 0 then 'pip' end from f) as package_manager, (select count_if(k = 0) > 0 from f) as has_tests,
 (select path from f where k = 9 order by string_split(path, '/') limit 1) as license_file, (select count_if(k = 8) from f) as entry_points, (select count(*) from (select distinct src, dst from e)) as imports,
 (select count(*) from core) as core_files, (select string_agg(role || '=' || n, ',' order by role) from (select role, count(*) as n from rl group by 1)) as roles, (select count_if(doc_id % 4 <> 3) from f) as public_files""")
def project_profile(spark, sf_dir):
    own = profile.profile(described_files(spark, sf_dir), file_edges(spark, sf_dir))
    roles = F.array_join(F.transform("roles", lambda r: F.concat(r["role"], F.lit("="), r["n"].cast("string"))), ",")
    return own.withColumn("frameworks", F.array_join("frameworks", ",")).withColumn("roles", roles)


_NL, _LINES = "chr(10)", "string_agg({}, chr(10) order by {})"
_TREE = f"""t as (select f.path, core.path is not null as is_core, case when f.path like '%/%' then string_split(f.path, '/')[1] else '_root' end as top from f left join core on f.path = core.path),
 r as (select *, row_number() over (partition by top order by path) as place, count(*) over (partition by top) as total from t), tc as (select top, count_if(is_core) as n, count(*) as total from t group by 1),
 folders as (select r.top, '├── ' || r.top || '/' || case when any_value(n) > 0 then ' (' || any_value(n) || ' core files)' else '' end || {_NL} || string_agg('│   ├── ' || substr(path, length(r.top) + 2) || case when is_core then ' (core)' else '' end, {_NL} order by place)
  || case when any_value(tc.total) > 3 then {_NL} || '│   └── ... (' || (any_value(tc.total) - 3) || ' more files)' else '' end as text from r join tc on r.top = tc.top where place <= 3 and r.top <> '_root' group by r.top),
 keys as (select string_agg('- **' || case role when 'core' then 'Core files' when 'entry_points' then 'Entry points' else 'Tests' end || '**: ' || n || case role when 'core' then ' central modules' when 'entry_points' then ' executable files' else ' test files' end, {_NL}
  order by case role when 'core' then 0 when 'entry_points' then 1 else 2 end) as text from (select role, count(*) as n from rl where role in ('core', 'entry_points', 'tests') group by 1))"""
_API = f"""a as (select f.path, top, is_core, case when doc_id % 2 = 0 then 'Classes:' else 'Functions:' end as title, 'f' || doc_id as def, row_number() over (partition by top order by is_core desc, f.path) as place, count(*) over (partition by top) as total
  from f join t on f.path = t.path where doc_id % 4 <> 3), modules as (select top, case when top = '_root' then '### Root Level' else '### ' || top end || {_NL} || {_NL} || string_agg('**`' || path || '`**' || {_NL} || case when is_core then '*(core module)*' || {_NL} else '' end
  || {_NL} || title || {_NL} || '- `' || def || '`' || {_NL}, {_NL} order by place) || case when any_value(total) > 5 then {_NL} || '*...and ' || (any_value(total) - 5) || ' more files*' || {_NL} else '' end as text from a where place <= 5 group by top)"""
_CHANGED_FILES = f"""rc as (select path, case doc_id % 5 when 0 then 'breaking' when 1 then 'additive' else 'internal' end as kind from f where doc_id % 3 < 2 and doc_id % 5 < 3),
 rk as (select *, row_number() over (partition by kind order by string_split(path, '/')) as place from rc), rs as (select string_agg(text, {_NL} order by kind) as text from (
  select 0 as kind, '### Breaking Changes' || {_NL} || {_NL} || 'The following files contain breaking API changes:' || {_NL} || {_NL} || string_agg('- `' || path || '`', {_NL} order by place) || {_NL} as text from rk where kind = 'breaking' and place <= 10 having count(*) > 0
  union all select 1, '### New Features' || {_NL} || {_NL} || 'The following files contain new functionality:' || {_NL} || {_NL} || string_agg('- `' || path || '`', {_NL} order by place) || {_NL} from rk where kind = 'additive' and place <= 10 having count(*) > 0
  union all select 2, '### Internal Changes' || {_NL} || {_NL} || count(*) || ' files have internal implementation changes without API modifications.' || {_NL} from rc where kind = 'internal' having count(*) > 0))"""


@query(f"""with f as ({FILES}), {_EDGES}, {_ROLES}, {_CORE}, fw as ({_FRAMEWORKS}), fws as (select list(framework order by framework) as l from fw), {_TREE}, {_API}, {_CHANGED_FILES},
 c10 as (select string_agg('- `' || path || '` (imported by ' || dependents || ' files)', {_NL} order by dependents desc, path) as text from (select * from core order by dependents desc, path limit 10)),
 ep as (select string_agg('- `' || path || '`', {_NL} order by string_split(path, '/')) as text from (select path from rl where role = 'entry_points' order by string_split(path, '/') limit 5)),
 alone as (select count(*) as n from f where path not in (select src from e) and path not in (select dst from e))
 select * from (select 0 as ord, 'overview' as name, 'Overview' as title, 'A ' || (select language from f where language is not null group by 1 order by count(*) desc, min(string_split(path, '/')) limit 1) || ' project built with '
   || case len(l) when 1 then l[1] when 2 then l[1] || ' and ' || l[2] else array_to_string(l[1:-2], ', ') || ', and ' || l[-1] end || '.' as content from fws
 union all select 1, 'installation', 'Installation', '```bash' || {_NL} || '# Clone the repository' || {_NL} || 'git clone https://github.com/username/demo.git' || {_NL} || 'cd demo' || {_NL} || {_NL} || '# Install dependencies' || {_NL} || 'pip install -e .' || {_NL} || '```'
 union all select 2, 'usage', 'Usage', '```bash' || {_NL} || 'python ' || (select path from f where k = 8 order by string_split(path, '/') limit 1) || {_NL} || '```'
 union all select 3, 'structure', 'Project Structure', '```' || {_NL} || (select string_agg('├── ' || path || case when is_core then ' (core)' else '' end || {_NL}, '' order by place) from r where top = '_root' and place <= 5)
   || (select string_agg(text, {_NL} order by top) from folders) || {_NL} || '```' || {_NL} || {_NL} || '**Key Components:**' || {_NL} || {_NL} || (select text from keys)
 union all select 4, 'architecture', 'Architecture', 'This section provides insights into the codebase architecture based on dependency analysis.' || {_NL} || {_NL}
   || coalesce((select '### Core Modules' || {_NL} || {_NL} || 'These modules are central to the codebase (imported by many files):' || {_NL} || {_NL} || text || {_NL} || {_NL} from c10), '')
   || coalesce((select '### Entry Points' || {_NL} || {_NL} || 'These files serve as entry points (not imported by other files):' || {_NL} || {_NL} || text || {_NL} || {_NL} from ep), '')
   || (select '### Isolated Files' || {_NL} || {_NL} || n || ' file(s) have no dependencies and are not imported by other files.' || {_NL} from alone)
 union all select 5, 'api', 'API Reference', 'This section provides an overview of the public API based on code analysis.' || {_NL} || {_NL} || (select string_agg(text, {_NL} order by top) from modules)
 union all select 6, 'recent_changes', 'Recent Changes', (select text from rs)
 union all select 7, 'license', 'License', (select 'This project is licensed under the terms specified in [`' || path || '`](' || path || ').' from f where k = 9 order by string_split(path, '/') limit 1))""")
def readme_sections(spark, sf_dir):
    made = reports.sections(described_files(spark, sf_dir), file_edges(spark, sf_dir), "demo")
    return spark.createDataFrame([(i, s.name, s.title, s.content) for i, s in enumerate(made)], "ord int, name string, title string, content string")


@query("""select distinct case doc_id % 50 when 3 then 'Django' when 4 then 'Flask' when 5 then 'NumPy' end as framework from documents where doc_id % 50 in (3, 4, 5)
 union select 'Pandas' from documents where doc_id % 50 = 5""")
def framework_detect(spark, sf_dir):
    return profile.frameworks(files(spark, sf_dir), "python")


@query(f"""with f as ({FILES}), t as (select path, case when path like '%/%' then string_split(path, '/')[1] else '_root' end as top from f),
 r as (select top, path, row_number() over (partition by top order by path) as place, count(*) over (partition by top) as total from t)
 select top, path, place, total from r where place <= 3""")
def directory_top3(spark, sf_dir):
    return profile.first_of_each(files(spark, sf_dir).select("path"), 3).select("top", "path", F.col("place").cast("bigint").alias("place"), "total")


# --- history made from orders

MESSAGE = "(case o_orderkey % 6 when 0 then 'Add ' when 1 then 'fix ' when 2 then 'Implement ' when 3 then 'Update docs ' when 4 then 'new ' else 'Refactored ' end) || o_orderpriority || ' handling'"
HASH = "substr(md5(cast(o_orderkey as string)), 1, 8)"
_PART = "'pkg' || cast(p_size as string) || '/m' || cast(p_partkey as string) || '.py'"
_PARTS = f"select {_PART} as path, case when p_partkey % 3 = 0 then 'python' when p_partkey % 3 = 1 then 'go' end as language, case p_partkey % 9 when 0 then 'breaking' when 1 then 'additive' when 2 then 'internal' when 3 then 'docs-only' end as semantic_category from part"
_HISTORY = f"""with cf as (select l_orderkey as ord, {_PART} as path, cast(l_quantity as bigint) as insertions, cast(l_linenumber as bigint) as deletions from lineitem join part on l_partkey = p_partkey),
 s as (select ord, sum(insertions) as insertions, sum(deletions) as deletions, count(*) as n_files from cf group by 1),
 c as (select o_orderkey as ord, {HASH} as hash, c_name as author, o_orderdate as date, {MESSAGE} as message, cast(coalesce(s.insertions, 0) as bigint) as insertions,
 cast(coalesce(s.deletions, 0) as bigint) as deletions, cast(coalesce(n_files, 0) as bigint) as n_files from orders join customer on o_custkey = c_custkey left join s on s.ord = o_orderkey)"""


def commit_files(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_PART} as path")
    own = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as ord", "l_partkey", "cast(l_quantity as bigint) as insertions", "cast(l_linenumber as bigint) as deletions", "l_suppkey")
    return own.join(part, own.l_partkey == part.p_partkey).select("ord", "path", "insertions", "deletions", "l_suppkey", "p_partkey")


def commit_heads(spark, sf_dir):
    orders, people = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return orders.join(people, orders.o_custkey == people.c_custkey).selectExpr("o_orderkey as ord", f"{HASH} as hash", "c_name as author", "o_orderdate as date", f"{MESSAGE} as message")


def commits(spark, sf_dir):
    sums = commit_files(spark, sf_dir).groupBy("ord").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count("*").alias("n_files"))
    return commit_heads(spark, sf_dir).join(sums, "ord", "left").fillna(0, ["insertions", "deletions", "n_files"])


def part_files(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*(x.strip() for x in (
        f"{_PART} as path", "case when p_partkey % 3 = 0 then 'python' when p_partkey % 3 = 1 then 'go' end as language",
        "case p_partkey % 9 when 0 then 'breaking' when 1 then 'additive' when 2 then 'internal' when 3 then 'docs-only' end as semantic_category")))


_AUTHOR = "7"
_STATS = f"""own as (select * from c where contains(lower(author), '{_AUTHOR}')), f as ({_PARTS}), touched as (select distinct path from cf where ord in (select ord from own)),
 st as (select (select count(*) from own) as total_commits, (select cast(sum(insertions) as bigint) from own) as total_insertions, (select cast(sum(deletions) as bigint) from own) as total_deletions,
 (select count(*) from touched) as files_touched, (select string_agg(distinct language, ',' order by language) from touched join f using (path)) as languages_used,
 (select count_if(semantic_category = 'breaking') from f) as breaking_changes, (select count_if(semantic_category = 'additive') from f) as additive_changes,
 (select count_if(semantic_category = 'internal') from f) as internal_changes, (select count_if(semantic_category = 'docs-only') from f) as docs_changes)"""


def _stats(spark, sf_dir):
    return history.stats(commits(spark, sf_dir), commit_files(spark, sf_dir), part_files(spark, sf_dir), _AUTHOR)


@query(f"{_HISTORY}, {_STATS} select * from st")
def contribution_stats(spark, sf_dir):
    return _stats(spark, sf_dir).withColumn("languages_used", F.array_join("languages_used", ","))


@query(f"{_HISTORY} select ord, hash, author, message, insertions from c order by date desc, ord limit 50")
def recent_commits(spark, sf_dir):
    return history.newest(commits(spark, sf_dir), 50).select("ord", "hash", "author", "message", "insertions")


@query(f"{_HISTORY} select ord, author from c where lower(author) like '%{_AUTHOR}%'")
def author_filter(spark, sf_dir):
    return history.by_author(commits(spark, sf_dir), _AUTHOR).select("ord", "author")


@query(f"{_HISTORY} select ord, message from c where ord % 6 in (0, 2, 4) or (n_files >= 5 and insertions >= 50)")
def feature_commits(spark, sf_dir):
    return commits(spark, sf_dir).where(history.is_feature(F.col("message"), F.col("n_files"), F.col("insertions"))).select("ord", "message")


@query("select role, count(*) as n, count_if(length(text) >= 20 and regexp_matches(text, '^\\p{Lu}')) as good from conversations group by 1")
def message_quality(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(history.is_good_message(F.col("text"))).alias("good"))


@query(f"{_HISTORY} select round(coalesce(avg(insertions), 0), 6) as mean from c")
def avg_insertions(spark, sf_dir):
    return commits(spark, sf_dir).agg(F.round(F.coalesce(F.avg("insertions"), F.lit(0.0)), 6).alias("mean"))


_BULLETS = f"""{_HISTORY}, {_STATS}, n as (select count(*) as n_commits, count_if(length(message) >= 20 and regexp_matches(message, '^\\p{{Lu}}')) as good, avg(insertions) as mean from c),
 t as (select count(*) as n_files, count_if(contains(lower(path), 'test')) as n_tests from f), l as (select string_split(languages_used, ',') as langs from st),
 feats as (select *, row_number() over (order by ord) + 2 as g from c where ord % 6 in (0, 2, 4) or (n_files >= 5 and insertions >= 50)), b as (
 select 0 as gen_ord, 'Developed demo, a ' || array_to_string(langs[1:3], ', ') || case when len(langs) > 3 then ' and ' || (len(langs) - 3) || ' more' else '' end || ' project with ' || files_touched || ' source files and ' || format('{{:,}}', total_insertions) || ' lines of code' as text,
 8.0 as impact_score, 'technical' as category, n_commits || ' commits;' || files_touched || ' files' as evidence from st, n, l
 union all select 1, 'Architected and implemented ' || case when additive_changes > 0 then additive_changes || ' new features' else '' end || case when additive_changes > 0 and breaking_changes > 0 then ', ' else '' end || case when breaking_changes > 0 then breaking_changes || ' API redesigns' else '' end || ', demonstrating strong software design and API development skills',
 7.5, 'technical', additive_changes || ' additive changes;' || breaking_changes || ' breaking changes' from st where breaking_changes > 0 or additive_changes > 5
 union all select 2, 'Improved code quality through ' || internal_changes || ' internal refactorings, maintaining clean architecture without breaking public APIs', 6.5, 'technical', internal_changes || ' internal changes' from st where internal_changes > 10
 union all select g, 'Implemented ' || upper(message[1]) || message[2:] || ', touching ' || n_files || ' files with ' || insertions || ' additions', 7.0, 'technical', hash from feats where g <= 5
 union all select 10, 'Contributed ' || total_commits || ' commits totaling ' || format('{{:,}}', total_insertions) || ' additions and ' || format('{{:,}}', total_deletions) || ' deletions across ' || files_touched || ' files', 6.0, 'impact', total_commits || ' commits' from st where total_commits >= 10
 union all select 11, 'Built comprehensive codebase with ' || n_files || ' modules demonstrating full-stack development capabilities', 7.0, 'impact', n_files || ' files total' from t where n_files >= 20
 union all select 12, 'Established robust testing practices with ' || n_tests || ' test files ensuring code quality and reliability', 6.5, 'impact', n_tests || ' test files' from t where n_tests >= 5
 union all select 13, 'Maintained comprehensive documentation with ' || docs_changes || ' documentation updates improving code maintainability', 5.5, 'impact', docs_changes || ' doc changes' from st where docs_changes >= 5
 union all select 20, 'Followed best practices with clear, descriptive commit messages and structured version control workflow', 5.0, 'collaboration', good || '/' || n_commits || ' quality commit messages' from n where good >= n_commits * 0.7
 union all select 21, 'Practiced iterative development with ' || n_commits || ' incremental commits, enabling easy code review and collaboration', 5.5, 'collaboration', 'Average ' || cast(floor(mean) as bigint) || ' LOC per commit' from n where mean < 100 and n_commits >= 20)"""


def _bullets(spark, sf_dir):
    return history.bullets(_stats(spark, sf_dir), commits(spark, sf_dir), part_files(spark, sf_dir), "demo")


@query(f"{_BULLETS} select cast(gen_ord as bigint) as gen_ord, text, cast(impact_score as double) as impact_score, category, evidence from b")
def bullet_rank(spark, sf_dir):
    return _bullets(spark, sf_dir).select(F.col("gen_ord").cast("bigint").alias("gen_ord"), "text", "impact_score", "category", F.array_join("evidence", ";").alias("evidence"))


@query(f"{_BULLETS} select cast(gen_ord as bigint) as gen_ord, '• ' || case when length(text) > 100 then text[1:97] || '...' else text end as text from b order by impact_score desc, gen_ord limit 5")
def bullet_format(spark, sf_dir):
    return history.formatted(_bullets(spark, sf_dir), "concise", 5).select(F.col("gen_ord").cast("bigint").alias("gen_ord"), "text")


_TOP5 = "t5 as (select * from b order by impact_score desc, gen_ord limit 5)"


@query(f"""{_BULLETS}, {_TOP5} select cast(gen_ord as bigint) as gen_ord, 'standard' as style, '• ' || text as text from t5 union all
 select gen_ord, 'detailed', '• ' || text || chr(10) || '  Category: ' || category || ' | Impact: ' || format('{{:.1f}}', impact_score) || '/10' || chr(10) || '  Evidence: ' || replace(evidence, ';', ', ') || chr(10) from t5""")
def bullet_styles(spark, sf_dir):
    ranked = _bullets(spark, sf_dir)
    own = [history.formatted(ranked, style, 5).select(F.col("gen_ord").cast("bigint").alias("gen_ord"), F.lit(style).alias("style"), "text") for style in ("standard", "detailed", "none")]
    return own[0].unionByName(own[1]).unionByName(own[2])


@query(f"""{_BULLETS} select '{{"bullets":[' || string_agg('{{"text":' || cast(to_json(text) as string) || ',"impact_score":' || format('{{:.1f}}', impact_score) || ',"category":"' || category || '","evidence":["' || replace(evidence, ';', '","') || '"]}}', ',' order by impact_score desc, gen_ord)
 || '],"total_bullets":' || count(*) || ',"categories":["' || (select string_agg(distinct category, '","' order by category) from b) || '"]}}' as json from b""")
def bullets_json(spark, sf_dir):
    return history.exported(_bullets(spark, sf_dir))


@query(f"{_BULLETS} select category, count(*) as n from b group by 1")
def bullet_categories(spark, sf_dir):
    return history.categories(_bullets(spark, sf_dir))


@query(f"{_HISTORY} select ord // 64 as repo, hash, author, date, message, insertions, deletions, n_files from c")
def gitlog_parse(spark, sf_dir):
    stats = commit_files(spark, sf_dir).groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("deletions", "p_partkey", "l_suppkey", F.concat_ws("\t", "insertions", "deletions", "path").alias("line")))).alias("s"))
    orders = commit_heads(spark, sf_dir).join(stats, "ord", "left")
    head = F.concat_ws("|", "hash", "author", F.unix_seconds(F.col("date").cast("timestamp")).cast("string"), "message")
    block = F.concat_ws("\n", head, F.array_join(F.transform(F.coalesce("s", F.array()), lambda x: x["line"]), "\n"))
    logs = orders.select(F.expr("ord div 64 as repo"), "ord", F.concat(block, F.lit("\n")).alias("block")).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("ord", "block"))).alias("b"))
    logs = logs.select("repo", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("text"))
    return history.counted_commits(logs).select("repo", "hash", "author", F.col("date").cast("timestamp_ntz").alias("date"), "message", "insertions", "deletions", "n_files")


# --- an import graph made from line items

_RAW = """select distinct prev as a, l_partkey as b from (select l_partkey, lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as prev from lineitem)
 where prev is not null and prev <> l_partkey"""
_GRAPH = f"""raw as ({_RAW}), p as (select p_partkey as k, {_PART} as path, 'pkg' || cast(p_size as string) || '.m' || cast(p_partkey as string) as module from part),
 e as (select x.path as src, y.path as dst, y.module as import from raw join p x on a = x.k join p y on b = y.k)"""


def module_files(spark, sf_dir):
    """All files (path) of the graph."""
    return table(spark, sf_dir, "part").selectExpr(f"{_PART} as path")


def module_nodes(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").selectExpr("l_partkey as b", "lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as a")
    raw = raw.where("a is not null and a <> b")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    # parts are as many as rows, so never a broadcast table; numbers are shuffled, and named afterwards
    wanted = raw.join(p.selectExpr("k as b", "p_size as size").hint("merge"), "b").groupBy("a").agg(F.collect_set(F.struct("b", "size")).alias("w"))
    modules = F.transform("w", lambda x: F.concat(F.lit("pkg"), x["size"].cast("string"), F.lit(".m"), x["b"].cast("string")))
    own = p.join(wanted.hint("merge"), p.k == wanted.a, "left").selectExpr("k as p_partkey", "p_size", "w")
    return own.select(F.expr(_PART).alias("path"), F.coalesce(modules, F.array().cast("array<string>")).alias("imports"), F.lit("python").alias("language"))


def module_edges(spark, sf_dir):
    return graph.resolved_edges(module_nodes(spark, sf_dir), unique=True)


@query(f"with {_GRAPH} select src, import, dst from e")
def import_resolve(spark, sf_dir):
    return graph.resolve(module_nodes(spark, sf_dir))


@query(f"with {_GRAPH} select src as path, count(*) as dependencies from e group by 1")
def direct_deps(spark, sf_dir):
    return graph.fan_out(module_edges(spark, sf_dir))


@query(f"with {_GRAPH} select dst as path, count(*) as dependents from e group by 1")
def direct_dependents(spark, sf_dir):
    return graph.fan_in(module_edges(spark, sf_dir))


@query(f"with {_GRAPH} select dst as path, count(*) as dependents from e group by 1 having count(*) >= 3")
def core_modules(spark, sf_dir):
    return graph.core(module_edges(spark, sf_dir))


@query(f"with {_GRAPH} select dst as path, count(*) as dependents from e group by 1 having count(*) >= 3 order by 2 desc, 1 limit 10")
def core_top10(spark, sf_dir):
    return graph.core(module_edges(spark, sf_dir)).orderBy(F.desc("dependents"), "path").limit(10)


@query(f"with {_GRAPH} select path from p where path not in (select dst from e)")
def leaf_files(spark, sf_dir):
    return graph.leaves(module_files(spark, sf_dir), module_edges(spark, sf_dir))


@query(f"with {_GRAPH} select path from p where path not in (select src from e)")
def root_files(spark, sf_dir):
    return graph.roots(module_files(spark, sf_dir), module_edges(spark, sf_dir))


@query(f"with {_GRAPH} select path from p where path not in (select src from e) and path not in (select dst from e)")
def isolated_files(spark, sf_dir):
    return graph.isolated(module_files(spark, sf_dir), module_edges(spark, sf_dir))


@query(f"with {_GRAPH} select src as path, string_agg(dst, ',' order by dst) as dependencies from e group by 1")
def graph_export(spark, sf_dir):
    return graph.adjacency(module_edges(spark, sf_dir)).withColumn("dependencies", F.array_join("dependencies", ","))


def _seed(edges: DataFrame, column: str) -> DataFrame:
    return edges.groupBy(column).count().orderBy(F.desc("count"), column).limit(1).select(F.col(column).alias("seed"))


@query(f"""with recursive {_GRAPH}, s as (select src as seed from e group by 1 order by count(*) desc, 1 limit 1), r(seed, path) as (select seed, seed from s union select r.seed, e.dst from r join e on e.src = r.path)
 select seed, path from r where path <> seed""")
def transitive_deps(spark, sf_dir):
    edges = graph.cut(module_edges(spark, sf_dir))
    return graph.closure(edges, _seed(edges, "src"))


@query(f"""with recursive {_GRAPH}, s as (select dst as seed from e group by 1 order by count(*) desc, 1 limit 1), r(seed, path) as (select seed, seed from s union select r.seed, e.src from r join e on e.dst = r.path)
 select seed, path from r where path <> seed""")
def transitive_dependents(spark, sf_dir):
    edges = graph.cut(module_edges(spark, sf_dir))
    return graph.closure(edges, _seed(edges, "dst"), reverse=True)


# packages of sixteen orders: their files import each other as the lines of an order follow each other
_FILE = "'p' || cast(l_orderkey // 16 as string) || '/m' || cast({} % 24 as string)"
_PACKAGES = f"""pairs as (select l_orderkey, l_partkey, lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as prev from lineitem),
 files as (select distinct {_FILE.format("l_partkey")} as path from pairs)"""
_PACKAGE_EDGES = f"{_PACKAGES}, e as (select distinct {_FILE.format('prev')} as src, {_FILE.format('l_partkey')} as dst from pairs where prev is not null)"


def package_files(spark, sf_dir):
    """Pairs of files (src, dst) that follow each other in an order, and all files (path); rows repeat."""
    file = lambda c: f"concat('p', l_orderkey div 16, '/m', {c} % 24)"
    own = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", "lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as prev")
    pairs = own.where("prev is not null").selectExpr(f"{file('prev')} as src", f"{file('l_partkey')} as dst")
    return pairs, own.selectExpr(f"{file('l_partkey')} as path")


@query(f"""with recursive {_PACKAGES}, e as (select distinct {_FILE.format("greatest(prev % 24, l_partkey % 24)")} as src, {_FILE.format("least(prev % 24, l_partkey % 24)")} as dst from pairs
 where prev % 24 <> l_partkey % 24), r(path, level) as (select path, 0 from files union select e.src, r.level + 1 from r join e on e.dst = r.path)
 select path, cast(max(level) as bigint) as level from r group by path""")
def topo_levels(spark, sf_dir):
    pairs, nodes = package_files(spark, sf_dir)
    number = lambda c: F.substring_index(c, "/m", -1).cast("int")
    up = number("src") > number("dst")
    edges = pairs.where("src <> dst").select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"))
    return graph.levels(nodes, edges).withColumn("level", F.col("level").cast("bigint"))


_SCC = f"""{_PACKAGE_EDGES}, r(a, b) as (select src, dst from e union select r.a, e.dst from r join e on e.src = r.b),
 s as (select x.a as path, min(x.b) as scc from r x join r y on x.a = y.b and x.b = y.a group by x.a having count(distinct x.b) > 1)"""


@query(f"with recursive {_SCC} select path, scc from s")
def cycles_scc(spark, sf_dir):
    return graph.components(package_files(spark, sf_dir)[0])


@query(f"""with recursive {_SCC}, own as (select distinct x.scc, src, dst from e join s x on x.path = e.src join s y on y.path = e.dst where x.scc = y.scc and src <> dst),
 d(scc, path, n) as (select distinct scc, scc, 0 from own union select own.scc, own.src, d.n + 1 from d join own on own.scc = d.scc and own.dst = d.path where d.n < 24),
 near as (select scc, path, min(n) as n from d where path <> scc group by all), turn as (select own.scc, min(near.n) as n from own join near on near.scc = own.scc and near.path = own.dst where own.src = own.scc group by 1),
 nxt as (select own.scc, own.src, min(own.dst) as dst from own join near a on a.scc = own.scc and a.path = own.src join (select * from near union all select distinct scc, scc, 0 from own) b on b.scc = own.scc and b.path = own.dst where b.n = a.n - 1 group by all
  union all select own.scc, own.src, min(own.dst) from own join turn on turn.scc = own.scc join near on near.scc = own.scc and near.path = own.dst and near.n = turn.n where own.src = own.scc group by all),
 w(scc, path, way, k) as (select distinct scc, scc, scc, 0 from own union all select w.scc, nxt.dst, w.way || ',' || nxt.dst, w.k + 1 from w join nxt on nxt.scc = w.scc and nxt.src = w.path where w.k = 0 or w.path <> w.scc)
 select scc, way as cycle from w where k > 0 and path = scc union all select src, src || ',' || dst from e where src = dst""")
def cycles(spark, sf_dir):
    return graph.cycles(package_files(spark, sf_dir)[0]).withColumn("cycle", F.array_join("cycle", ","))


@query(f"with {_GRAPH} select (select count(*) from p) as files, (select count(*) from e) as edges")
def graph_size(spark, sf_dir):
    return graph.size(module_files(spark, sf_dir), module_edges(spark, sf_dir))


@query(f"with {_GRAPH}, f as (select max(path) as path from p) select f.path, (select count(*) from e where src = f.path) as dependencies, (select count(*) from e where dst = f.path) as dependents from f")
def graph_lookup(spark, sf_dir):
    nodes, edges = module_files(spark, sf_dir), graph.cut(module_edges(spark, sf_dir))
    path = nodes.agg(F.max("path")).first()[0]
    counts = (f(edges, path).agg(F.count("*").alias(n)) for f, n in ((graph.dependencies, "dependencies"), (graph.dependents, "dependents")))
    own = graph.node(nodes, path).select("path")
    for one in counts:
        own = own.crossJoin(one)  # one row each
    return own


_WEB = "'web/d' || cast({0} % 10 as string) || '/m' || cast({0} as string) || case {0} % 3 when 0 then '.js' when 1 then '.ts' else '/index.js' end"
_UP = "case when p_partkey % 3 = 2 then '../' else './' end"
_NEXT = f"{_UP} || 'm' || cast(p_partkey + 10 as string)"
_SIDE = "case when p_partkey % 3 = 2 then '../../' else '../' end || 'd' || cast((p_partkey + 1) % 10 as string) || '/m' || cast(p_partkey + 1 as string)"


@query(f"""select {_WEB.format("p_partkey")} as src, {_NEXT} as import, {_WEB.format("(p_partkey + 10)")} as dst from part where p_partkey + 10 in (select p_partkey from part)
 union all select {_WEB.format("p_partkey")}, {_SIDE}, {_WEB.format("(p_partkey + 1)")} from part where p_partkey + 1 in (select p_partkey from part)""")
def script_imports(spark, sf_dir):
    own = parts(spark, sf_dir, "p_partkey").selectExpr(f"{_WEB.format('p_partkey')} as path", f"array({_NEXT}, {_SIDE}, 'react', './none') as imports", "'javascript' as language")
    return graph.resolve(own)


_SUB = "'pkg' || cast(p_partkey % 10 as string) || '/sub/m' || cast({} as string)"


@query(f"""select {_SUB.format("p_partkey")} || '.py' as src, '.m' || cast(p_partkey + 10 as string) as import, {_SUB.format("p_partkey + 10")} || '.py' as dst from part where p_partkey + 10 in (select p_partkey from part)
 union all select {_SUB.format("p_partkey")} || '.py', '..sub.m' || cast(p_partkey + 20 as string), {_SUB.format("p_partkey + 20")} || '.py' from part where p_partkey + 20 in (select p_partkey from part)
 union all select {_SUB.format("p_partkey")} || '.py', '.', 'pkg' || cast(p_partkey % 10 as string) || '/sub/__init__.py' from part""")
def relative_imports(spark, sf_dir):
    part = parts(spark, sf_dir, "p_partkey")
    own = part.selectExpr(f"{_SUB.format('p_partkey')} || '.py' as path", "array('.m' || cast(p_partkey + 10 as string), '..sub.m' || cast(p_partkey + 20 as string), '.', '...none') as imports")
    packages = part.selectExpr("'pkg' || cast(p_partkey % 10 as string) || '/sub/__init__.py' as path").distinct().withColumn("imports", F.array().cast("array<string>"))
    return graph.resolve(own.unionByName(packages).withColumn("language", F.lit("python")))


# --- definitions made from parts

_DEFS = """select p_partkey // 5 as g, p_partkey as k, case when p_partkey % 7 = 0 then '_f' else 'f' end || cast(p_partkey as string) as name,
 case when p_partkey % 4 = 0 then 'class' else 'function' end as type, p_partkey % 7 <> 0 as is_public, p_partkey % 11 <> 0 and (p_partkey // 5) % 17 <> 0 as in_old,
 p_partkey % 13 <> 0 and (p_partkey // 5) % 19 <> 0 as in_new from part"""
_CHANGED = f"""d as ({_DEFS}), j as (select *, not (type = 'class') and (k % 5 <> 4 or k % 10 = 3) as differs, type = 'function' and (k % 5 in (0, 1, 3) or k % 10 = 3) as breaks from d),
 ch as (select 'pkg' || cast(g as string) as path, g, name, type as definition_type, case when not in_new then 'removed' when not in_old then 'added' else 'modified' end as change_type,
 case when in_old then k % 100 end as old_line, case when in_new then k % 100 + 1 end as new_line, is_public, in_old and in_new and is_public and breaks as is_breaking_signature
 from j where (in_old or in_new) and (in_old <> in_new or differs))"""
_CLASSIFIED = f"""{_CHANGED}, g as (select g, 'pkg' || cast(g as string) as path, g % 17 <> 0 as old_exists, g % 19 <> 0 as new_exists, count_if(in_old) as n_old, count_if(in_old and is_public) as p_old,
 count_if(in_new) as n_new, count_if(in_new and is_public) as p_new from d group by g), n as (select path, count_if(is_public and change_type = 'removed') as rem, count_if(is_breaking_signature) as brk,
 count_if(is_public and change_type = 'added') as ad, count_if(is_public and change_type = 'modified') as md, count_if(not is_public) as priv from ch group by path), m as (
 select g.*, coalesce(rem, 0) as rem, coalesce(brk, 0) as brk, coalesce(ad, 0) as ad, coalesce(md, 0) as md, coalesce(priv, 0) as priv,
 case when old_exists and new_exists then case when g.g % 6 = 0 then 'docs' else 'mod' end when new_exists then 'new' when old_exists then 'gone' else 'none' end as k from g left join n on g.path = n.path),
 cl as (select path, g, case k when 'docs' then 'docs-only' when 'new' then 'additive' when 'none' then 'unknown' when 'gone' then case when p_old > 0 then 'breaking' else 'internal' end
 else case when rem + brk > 0 then 'breaking' when ad > 0 then 'additive' else 'internal' end end as category,
 case k when 'gone' then p_old > 0 when 'mod' then rem + brk > 0 else false end as has_breaking, case k when 'new' then true when 'mod' then ad > 0 else false end as has_additions,
 case k when 'gone' then true when 'mod' then rem > 0 else false end as has_removals,
 case k when 'docs' then 'Documentation-only changes (comments, docstrings, whitespace)' when 'none' then 'Unable to classify'
 when 'new' then 'New file with ' || n_new || ' definition(s)' || case when p_new > 0 then ' (' || p_new || ' public)' else '' end
 when 'gone' then 'File deleted with ' || n_old || ' definition(s)' || case when p_old > 0 then ' (' || p_old || ' public - BREAKING)' else '' end
 else coalesce(nullif(concat_ws('; ', case when rem > 0 then 'Removed ' || rem || ' public API(s)' end, case when brk > 0 then 'Breaking signature changes in ' || brk || ' function(s)' end,
 case when ad > 0 then 'Added ' || ad || ' public API(s)' end, case when md > brk then 'Modified ' || (md - brk) || ' public API(s)' end, case when priv > 0 then priv || ' internal change(s)' end), ''), 'No significant changes detected') end as description from m)"""


def definition_files(spark, sf_dir):
    """Files whose definitions come from parts: parameters, types and returns differ between old and new by rule."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select("p_partkey", F.expr("p_partkey div 5 as g"))

    def struct(new: bool):
        old_params = F.lit("x,y: int")
        new_params = F.when(k % 5 == 0, "x").when(k % 5 == 1, "x,y: str").when(k % 5 == 2, "x,y: int,z").when(k % 5 == 3, "y: int,x").otherwise("x,y: int")
        old_return = F.when(k % 3 != 0, "int")
        params = F.split(new_params if new else old_params, ",")
        return F.struct(
            F.concat(F.when(k % 7 == 0, "_f").otherwise("f"), k.cast("string")).alias("name"), F.when(k % 4 == 0, "class").otherwise("function").alias("type"),
            (k % 100 + int(new)).cast("int").alias("line"), (k % 7 != 0).alias("is_public"), params.alias("parameters"),
            (F.when(k % 10 == 3, "str").otherwise(old_return) if new else old_return).alias("return_type"),
        )

    def side(new: bool):
        there = (k % (13 if new else 11) != 0) & (F.col("g") % (19 if new else 17) != 0)
        return F.transform(F.array_sort(F.collect_list(F.when(there, F.struct("p_partkey", struct(new).alias("d"))))), lambda x: x["d"])

    own = d.groupBy("g").agg(side(False).alias("old_definitions"), side(True).alias("new_definitions"))
    g = F.col("g")
    return own.select(
        F.concat(F.lit("pkg"), g.cast("string")).alias("path"), (g % 17 != 0).alias("old_exists"), (g % 19 != 0).alias("new_exists"), F.concat(F.lit("h"), g.cast("string")).alias("old_ast_hash"),
        F.concat(F.when(g % 6 == 0, "h").otherwise("n"), g.cast("string")).alias("new_ast_hash"), "old_definitions", "new_definitions",
    )


def package_edges(spark, sf_dir):
    g = table(spark, sf_dir, "part").select(F.expr("p_partkey div 5 as g")).distinct()
    name = lambda x: F.concat(F.lit("pkg"), x.cast("string"))
    return g.select(name(F.col("g") + 1).alias("src"), name(F.col("g")).alias("dst"))


@query(f"with {_CHANGED} select path, name, definition_type, change_type, cast(old_line as int) as old_line, cast(new_line as int) as new_line, is_public, is_breaking_signature from ch")
def definition_diff(spark, sf_dir):
    return definitions.changes(definition_files(spark, sf_dir))


@query(f"with {_CLASSIFIED} select path, category, has_breaking, has_additions, has_removals, description from cl")
def classify_changes(spark, sf_dir):
    return definitions.classify(definition_files(spark, sf_dir))


@query(f"with {_CHANGED} select path, name, change_type from ch where is_public and change_type in ('removed', 'modified')")
def breaking_only(spark, sf_dir):
    return definitions.breaking(definitions.changes(definition_files(spark, sf_dir))).select("path", "name", "change_type")


@query(f"with {_CHANGED} select path, name from ch where change_type = 'added'")
def additive_only(spark, sf_dir):
    return definitions.additive(definitions.changes(definition_files(spark, sf_dir))).select("path", "name")


@query(f"""with {_CLASSIFIED} select (select count(*) from cl) as total_files, (select count_if(category = 'breaking') from cl) as breaking_files, (select count_if(category = 'additive') from cl) as additive_files,
 (select count_if(category = 'internal') from cl) as internal_files, (select count_if(category = 'docs-only') from cl) as docs_only_files, (select count_if(category = 'unknown') from cl) as unknown_files,
 (select count_if(change_type = 'added') from ch) as total_additions, (select count_if(change_type = 'removed') from ch) as total_removals, (select count_if(change_type = 'modified') from ch) as total_modifications""")
def change_summary(spark, sf_dir):
    own = definition_files(spark, sf_dir)
    return definitions.summarise(definitions.classify(own), definitions.changes(own))


@query(f"with {_CLASSIFIED} select category, path from cl where category in ('breaking', 'additive')")
def change_files(spark, sf_dir):
    return definitions.listed(definitions.classify(definition_files(spark, sf_dir)))


@query(f"""with {_CLASSIFIED.replace("rem + brk > 0", "rem > 0").replace("when brk > 0", "when false").replace("when md > brk then 'Modified ' || (md - brk)", "when md > 0 then 'Modified ' || md")}
 select path, category, has_breaking, has_additions, has_removals, description from cl""")
def classify_by_names(spark, sf_dir):
    return definitions.classify(definition_files(spark, sf_dir), signatures=False)


@query(f"""with {_CLASSIFIED} select path as changed, 'pkg' || cast(g + 1 as string) as dependent, case category when 'breaking' then 'May be broken by changes in ' || path || ': ' || description
 when 'additive' then 'New APIs available from ' || path || ': ' || description when 'internal' then 'Internal changes in ' || path || ' (no API impact expected)'
 else 'Documentation updated in ' || path || ' (no code impact)' end as impact from cl where category <> 'unknown'""")
def import_impact(spark, sf_dir):
    return definitions.import_impact(definitions.classify(definition_files(spark, sf_dir)), package_edges(spark, sf_dir))


@query(f"""with d as ({_DEFS}), f as (select 'pkg' || cast(g as string) || '/a.py' as path, 'pkg' || cast(g as string) as module, list(name order by k) filter (where type = 'class' and is_public and in_new) as c,
 list(name order by k) filter (where type = 'function' and is_public and in_new) as fn from d where in_new and is_public group by g)
 select module, path, array_to_string(c[1:5], ',') as classes, array_to_string(fn[1:5], ',') as functions from f""")
def api_top5(spark, sf_dir):
    own = definition_files(spark, sf_dir).select(F.concat("path", F.lit("/a.py")).alias("path"), F.col("new_definitions").alias("definitions"))
    none = graph.core(own.select(F.col("path").alias("src"), F.col("path").alias("dst")).limit(0))
    out = profile.api_listing(profile.public_api(own), none)
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return out.select("module", "path", joined("classes"), joined("functions"))


# --- source text made from parts

_PY = """'import pkg' || cast(p_size as string) || '.m' || cast(p_partkey as string) || chr(10) || 'from .x' || cast(p_size as string) || ' import y' || chr(10) || 'import os as o' || chr(10) || 'class C' || cast(p_partkey as string) || ':' || chr(10)
 || '    def m_' || cast(p_partkey as string) || '(self, a: int, b=1):' || chr(10) || '        return "' || p_name || '"  # def no()' || chr(10) || 'def _f' || cast(p_partkey as string) || '(x) -> int:' || chr(10) || '    return x' || chr(10)"""
_JS = """'import y from "./m' || cast(p_partkey as string) || '"' || chr(10) || 'export class K' || cast(p_partkey as string) || ' { run(a, b) { return a } _hid() { if (x) { y() } } }' || chr(10)
 || 'function g' || cast(p_partkey as string) || '(x, y = 2) { const t = `v${x}`; return t }' || chr(10) || '// class No {}' || chr(10) || 'const z' || cast(p_partkey as string) || ' = /a"b/;' || chr(10)"""


def _parsed(spark, sf_dir, sql: str, language: str) -> DataFrame:
    own = parts(spark, sf_dir, "p_partkey", "p_size", "p_name").selectExpr("p_partkey", f"{sql} as content", f"'{language}' as language")
    return parse.parsed(own, hashed=False)


def _definitions(df: DataFrame) -> DataFrame:
    own = df.select("p_partkey", F.explode("definitions").alias("d"))
    return own.select("p_partkey", "d.name", "d.type", "d.line", "d.is_public", F.array_join("d.parameters", ";").alias("parameters"), F.col("d.return_type").alias("return_type"))


@query("""select p_partkey, 'C' || cast(p_partkey as string) as name, 'class' as type, cast(4 as int) as line, true as is_public, '' as parameters, null as return_type from part
 union all select p_partkey, 'm_' || cast(p_partkey as string), 'function', 5, true, 'self;a: int;b=...', null from part
 union all select p_partkey, '_f' || cast(p_partkey as string), 'function', 7, false, 'x', 'int' from part""")
def parse_python_defs(spark, sf_dir):
    return _definitions(_parsed(spark, sf_dir, _PY, "python"))


@query("""select p_partkey, 'K' || cast(p_partkey as string) as name, 'class' as type, cast(2 as int) as line, true as is_public, '' as parameters, cast(null as string) as return_type from part
 union all select p_partkey, 'run', 'method', 2, true, 'a;b', null from part union all select p_partkey, '_hid', 'method', 2, false, '', null from part
 union all select p_partkey, 'g' || cast(p_partkey as string), 'function', 3, true, 'x;y=...', null from part union all select p_partkey, 't', 'variable', 3, true, '', null from part
 union all select p_partkey, 'z' || cast(p_partkey as string), 'variable', 5, true, '', null from part""")
def parse_js_defs(spark, sf_dir):
    return _definitions(_parsed(spark, sf_dir, _JS, "javascript"))


@query("""select p_partkey, 'pkg' || cast(p_size as string) || '.m' || cast(p_partkey as string) as import from part union all select p_partkey, '.x' || cast(p_size as string) from part
 union all select p_partkey, './m' || cast(p_partkey as string) from part""")
def imports_extract(spark, sf_dir):
    both = _parsed(spark, sf_dir, _PY, "python").select("p_partkey", "imports").unionByName(_parsed(spark, sf_dir, _JS, "javascript").select("p_partkey", "imports"))
    return both.select("p_partkey", F.explode("imports").alias("import"))


# what is done to a file, the file before and after, and whether its structure is the same afterwards
_EDITS = [
    ("comment", "x = 1  # a", "x = 1  # b", True), ("blank lines", "x = 1", "\n\nx = 1\n", True), ("number", "x = 1", "x = 2", True), ("name", "x = 1", "y = 1", False), ("text", "x = 'a'", "x = 'b'", False),
    ("operator", "x = a + b", "x = a - b", False), ("statement", "x = 1", "x = 1\ny = 2", False), ("docstring", "def f():\n    'a'", "def f():\n    'b'", False), ("indent", "if a:\n  b()", "if a:\n      b()", True),
]
_SCRIPT_EDITS = [
    ("script comment", "let x = 1 // a", "let x = 1 /* b */", True), ("script number", "let x = 1", "let x = 2", True), ("script method", "class A { m() {} }", "class A { n() {} }", True),
    ("script name", "let x = 1", "let y = 1", False), ("script text", "let x = 'a'", "let x = 'b'", False), ("script operator", "f(a + b)", "f(a - b)", False),
]


@query("select p_partkey, edit, same from part join (values " + ", ".join(f"({i}, '{name}', {same})" for i, (name, _, _, same) in enumerate(_EDITS + _SCRIPT_EDITS)) + f") v(i, edit, same) on p_partkey % {len(_EDITS + _SCRIPT_EDITS)} = i")
def structural_hashes(spark, sf_dir):
    every = [(i, name, "python" if i < len(_EDITS) else "javascript", old, new) for i, (name, old, new, _) in enumerate(_EDITS + _SCRIPT_EDITS)]
    edits = spark.createDataFrame(every, "i int, edit string, language string, old string, new string")
    # the same end for both sides of a part
    last = F.concat(F.lit("\n"), F.when(F.col("language") == "python", "z").otherwise("let z"), F.col("p_partkey").cast("string"), F.lit(" = 0\n"))
    own = parts(spark, sf_dir, "p_partkey").join(F.broadcast(edits), F.expr(f"p_partkey % {len(every)} = i"))
    side = lambda c: parse.parsed(own.select("p_partkey", "edit", "language", F.concat(c, last).alias("content"))).select("p_partkey", "edit", F.col("ast_hash").alias(f"{c}_hash"))
    return side("old").join(side("new"), ["p_partkey", "edit"]).select("p_partkey", "edit", (F.col("old_hash") == F.col("new_hash")).alias("same"))


_MODULE = "'def f' || cast(p_partkey as string) || '(a, b):' || chr(10) || '    return a' || chr(10)"
_EDITED = f"""case when p_partkey % 7 = 0 then '# note' || chr(10) || {_MODULE} when p_partkey % 5 = 0 then replace({_MODULE}, '(a, b)', '(a)') when p_partkey % 3 = 0 then {_MODULE} || 'def g(): pass' || chr(10)
 when p_partkey % 17 = 0 then replace({_MODULE}, 'def f', 'def _f') || {_MODULE} else {_MODULE} end"""


@query(f"""select {_PART} as path, case when k = 'new' then 'added' when k = 'gone' then 'deleted' when k = 'same' then 'unchanged' else 'modified' end as change_type,
 case k when 'new' then 'additive' when 'gone' then 'breaking' when 'docs' then 'docs-only' when 'cut' then 'breaking' when 'more' then 'additive' when 'own' then 'internal' end as semantic_category,
 case k when 'new' then 'New file with ' || n || ' definition(s) (' || p || ' public)' when 'gone' then 'File deleted with 1 definition(s) (1 public - BREAKING)' when 'docs' then 'Documentation-only changes (comments, docstrings, whitespace)'
 when 'cut' then 'Breaking signature changes in 1 function(s)' when 'more' then 'Added 1 public API(s)' when 'own' then '1 internal change(s)' end as description, case when k = 'gone' then 0 else n end as n_definitions
 from (select *, case when p_partkey % 7 = 0 or p_partkey % 5 = 0 then 1 when p_partkey % 3 = 0 or p_partkey % 17 = 0 then 2 else 1 end as n, case when p_partkey % 7 = 0 or p_partkey % 5 = 0 then 1 when p_partkey % 3 = 0 then 2 else 1 end as p,
 case when p_partkey % 11 = 0 then 'new' when p_partkey % 13 = 0 then 'gone' when p_partkey % 7 = 0 then 'docs' when p_partkey % 5 = 0 then 'cut' when p_partkey % 3 = 0 then 'more' when p_partkey % 17 = 0 then 'own' else 'same' end as k from part) where p_partkey % 143 <> 0""")
def scan_changes(spark, sf_dir):
    part = parts(spark, sf_dir, "p_partkey", "p_size").where("p_partkey % 143 <> 0")
    tree = lambda df, sql: df.selectExpr(f"{_PART} as path", f"cast({sql} as binary) as content")
    old = scan.scan_files(tree(part.where("p_partkey % 11 <> 0"), _MODULE))
    new = scan.scan_files(tree(part.where("p_partkey % 13 <> 0"), _EDITED), old.files)
    return new.changes.select("path", "change_type", "semantic_category", "description", F.when(F.col("change_type") == "deleted", 0).otherwise(F.size("definitions")).alias("n_definitions"))


_README = """'pre ' || cast(doc_id as string) || chr(10) || '## Alpha' || chr(10) || 'x' || cast(doc_id as string) || chr(10) || '## Beta' || chr(10) || lang || chr(10) || case when doc_id % 5 = 0 then '## Alpha' || chr(10) || 'again' else '' end"""


@query("""select doc_id, cast(0 as int) as ord, '_preamble' as title, 'pre ' || cast(doc_id as string) as content from documents
 union all select doc_id, 1, 'Alpha', case when doc_id % 5 = 0 then 'again' else 'x' || cast(doc_id as string) end from documents union all select doc_id, 2, 'Beta', lang from documents""")
def section_split(spark, sf_dir):
    own = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_README} as t")
    return own.select("doc_id", F.explode(text.sections(F.col("t"))).alias("s")).select("doc_id", "s.*")


@query("select doc_id, '## ' || lang || chr(10) || chr(10) || source || chr(10) as section, upper(lang[1]) || lang[2:] as title, case when length(text) > 100 then text[1:97] || '...' else text end as short from documents")
def section_render(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    return own.select("doc_id", text.rendered(F.col("lang"), F.col("source")).alias("section"), text.capitalised(F.col("lang")).alias("title"), text.clipped(F.col("text")).alias("short"))


@query("""with e as (select user_id, ts, event_type, case when ts - lag(ts) over (partition by user_id order by ts) < interval 10 minutes then 0 else 1 end as f from events),
 b as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as n from e)
 select user_id, min(ts) as batch_start, max(ts) as batch_end, count(*) as n_events, count(distinct event_type) as n_items from b group by user_id, n""")
def debounce_batches(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = debounce.batches(events, 600, "user_id", "event_type")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("batch_start", "batch_end")), "n_events", "n_items")
