"""Parsers and structural hashes on hand-written sources."""

import pytest

from lodestrata.functions import parse

PY = '''"""Doc."""
import os
import pkg.c, other as o
from . import b
from ..up.x import y


@dec
def f(a, b: int, c=1, d: int = 2, *args, e, g=3, **kw) -> "str":
    """text"""
    def inner(): pass
    return a + 1


class C(Base):
    async def m(self): ...
    def _p(self): ...
'''


def test_python():
    p = parse.parse("python", PY)
    assert [(d[0], d[1], d[3]) for d in p.definitions] == [("f", "function", True), ("inner", "function", True), ("C", "class", True), ("m", "function", True), ("_p", "function", False)]
    assert p.definitions[0][4] == ["a", "b: int", "c=...", "e", "g=..."] and p.definitions[0][5] == "'str'"
    assert p.imports == ["os", "pkg.c", ".", "..up.x"] and p.parse_mode == "ast"


def test_python_that_does_not_compile():
    p = parse.parse("python", "import a.b\nfrom .c import d\ndef f(:\n  pass\nclass K\n")
    assert [(d[0], d[1]) for d in p.definitions] == [("f", "function"), ("K", "class")] and p.imports == ["a.b", ".c"] and p.parse_mode == "tokens" and p.ast_hash


@pytest.mark.parametrize(
    ("old", "new", "same", "strict"),
    [
        ("x = 1 # a\n", "x = 1\n\n# b\n", True, True),
        ("if x:\n  y()\n", "if x:\n        y()\n", True, True),
        ("x = 1\n", "x = 2\n", True, False),
        ("x = 1\n", "y = 1\n", False, False),
        ("x = 'a'\n", "x = 'b'\n", False, False),
        ('def f():\n  "a"\n', 'def f():\n  "b"\n', False, False),
        ("x = a + b\n", "x = a - b\n", False, False),
        ("x = 1\n", "x = 1\ny()\n", False, False),
    ],
)
def test_python_hash(old, new, same, strict):
    h = lambda s, strict=False: parse.parse("python", s, strict).ast_hash
    assert (h(old) == h(new)) == same and (h(old, True) == h(new, True)) == strict


JS = """// import no from 'no'
import def, { a as b } from './x';
import * as n from "../y/z.js";
import 'side';
const re = /["'`/]+/g, q = { k: 1, inner: 2 }, z = a / b / c;
export default class Foo extends Bar {
  constructor(x, y = 2) { super(x); if (x) { go(x) } }
  static async _hidden({ a }, ...rest) { return `t ${ (() => { const inTpl = `n ${1}`; return inTpl })() } }` }
  get size() { return 1 }
}
function* gen(a, b) { for (let i = 0; i < 3; i++) yield i }
async function later() {}
let u
var w = function named(p) {}
require('not'); import('dynamic');
"""


def test_script():
    p = parse.parse("javascript", JS)
    assert p.imports == ["./x", "../y/z.js", "side"]
    got = [(d[0], d[1], d[3]) for d in p.definitions]
    assert got == [
        ("re", "variable", True), ("q", "variable", True), ("z", "variable", True), ("Foo", "class", True), ("constructor", "method", True), ("_hidden", "method", False),
        ("inTpl", "variable", True), ("size", "method", True), ("gen", "function", True), ("i", "variable", True), ("later", "function", True), ("u", "variable", True), ("w", "variable", True),
        ("named", "function", True),
    ]
    by_name = {d[0]: d for d in p.definitions}
    assert by_name["constructor"][4] == ["x", "y=..."] and by_name["gen"][4] == ["a", "b"] and by_name["later"][2] == 12


@pytest.mark.parametrize(
    ("old", "new", "same"),
    [("a.b(1)", "a.c(2) // x", True), ("class A { m() {} }", "class A { n() {} }", True), ("x = 'a'", "x = 'b'", False), ("x = y", "x = z", False), ("a + b", "a - b", False), ("f(`a`)", "f(`b`)", True)],
)
def test_script_hash(old, new, same):
    h = lambda s: parse.parse("typescript", s).ast_hash
    assert (h(old) == h(new)) == same
    assert parse.parse("typescript", old, True).ast_hash != parse.parse("typescript", new, True).ast_hash


def test_other_inputs():
    for language, source in (("go", "x"), (None, "x"), ("python", None), ("python", b"\xff\xfe"), ("javascript", b"\xff")):
        assert parse.parse(language, source).row() == (None, [], [], "none")
    assert parse.parse("python", "").ast_hash and parse.parse("javascript", "`${").ast_hash and parse.parse("javascript", "'open\n/re").ast_hash


def test_table_function(spark):
    parse.register(spark)
    spark.createDataFrame([("python", "def f(x): pass\nclass _C: pass")], "language string, source string").createOrReplaceTempView("sources")
    got = spark.sql("select p.name, p.type, p.is_public from sources, lateral parse_source(language, source) p").collect()
    assert sorted(map(tuple, got)) == [("_C", "class", False), ("f", "function", True)]


def test_definitions_without_hash():
    """What is not hashed has the same definitions and imports; every kind of block is walked in the order of its text."""
    odd = (
        "import a.b\nif x:\n    def f1(p: int, q: a.b, r: 'c' = 1) -> list[int]: pass\nelif y:\n    import c\nelse:\n    class C:\n        async def m(self) -> None:\n            with z:\n                from .d import e\n"
        "try:\n    def f2(): pass\nexcept E:\n    import g\nelse:\n    def f3(): pass\nfinally:\n    def f4(): pass\nfor i in j:\n    def f5(): pass\nelse:\n    def f6(): pass\n"
        "match v:\n    case 1:\n        def f7(): pass\n    case _:\n        import h\nwhile k:\n    class D(B): pass\n"
    )
    p = parse.parse("python", odd)
    assert [d[0] for d in p.definitions] == ["f1", "C", "m", "f2", "f3", "f4", "f5", "f6", "f7", "D"]
    assert p.imports == ["a.b", "c", ".d", "g", "h"] and p.definitions[0][4:] == (["p: int", "q: a.b"], "list[int]")
    for language, source in (("python", PY), ("python", odd), ("python", "def f(:\nimport x"), ("javascript", JS)):
        full, bare = parse.parse(language, source), parse.parse(language, source, hashed=False)
        assert full.ast_hash and bare.row() == (None, *full.row()[1:])


def test_parts_are_dealt_out(spark):
    """A part file of one row group is work for all cores."""
    from lodestrata.plans import registry

    for name in ("parse_python_defs", "parse_js_defs", "imports_extract", "script_imports", "relative_imports"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name
