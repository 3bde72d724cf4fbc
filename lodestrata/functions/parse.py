"""Definitions, imports and structural hashes of source text, and the table function that gives them.

Python goes through the standard library's syntax tree; text that it rejects is read by its tokens instead (parse_mode
`tokens`).  JavaScript and TypeScript have a tokenizer of their own, which knows strings, templates, comments and regular
expressions.  Structural hashes keep what kinds of things stand where, names and strings, and forget comments, layout and
(unless strict) numbers and the names of properties.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARSED = (
    "ast_hash string, definitions array<struct<name: string, type: string, line: int, is_public: boolean, parameters: array<string>, return_type: string>>, "
    "imports array<string>, parse_mode string"
)
PYTHON, SCRIPTS = ("python",), ("javascript", "typescript", "jsx", "tsx")


@dataclass
class Parsed:
    ast_hash: str | None = None
    definitions: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    parse_mode: str = "none"

    def row(self) -> tuple:
        return self.ast_hash, self.definitions, self.imports, self.parse_mode


def _digest(kind: str, words: list[str]) -> str:
    return kind + hashlib.sha256("\x00".join(words).encode("utf-8", "replace")).hexdigest()[:16]


def _definition(name: str, kind: str, line: int, parameters: list[str], returns: str | None) -> tuple:
    return name, kind, line, not name.startswith("_"), parameters, returns


# --- Python


def _written(node: ast.expr) -> str:
    return node.id if isinstance(node, ast.Name) else ast.unparse(node)


#: What statements are below; expressions hold no statement.
_BLOCKS = ast.stmt | ast.excepthandler | ast.match_case


def _statements(node) -> list:
    """The statements, handlers and cases right below a node, in order."""
    return [x for f in node._fields if isinstance(v := getattr(node, f, None), list) for x in v if isinstance(x, _BLOCKS)]


def _python_parameters(a: ast.arguments) -> list[str]:
    """Plain, typed and defaulted ones; starred ones and those with both a type and a default are left out."""
    own = [*a.posonlyargs, *a.args]
    with_default = {x.arg for x in own[len(own) - len(a.defaults) :]} if a.defaults else set()
    with_default |= {x.arg for x, d in zip(a.kwonlyargs, a.kw_defaults) if d is not None}
    out = []
    for x in [*own, *a.kwonlyargs]:
        if x.annotation is None:
            out.append(f"{x.arg}=..." if x.arg in with_default else x.arg)
        elif x.arg not in with_default:
            out.append(f"{x.arg}: {_written(x.annotation)}")
    return out


def _structure(node, strict: bool, out: list[str]) -> None:
    out.append("(" + type(node).__name__)
    for name, value in ast.iter_fields(node):
        for x in value if isinstance(value, list) else [value]:
            if isinstance(x, ast.AST):
                if not isinstance(x, ast.expr_context):
                    _structure(x, strict, out)
            elif isinstance(node, ast.Constant):
                if name == "value":
                    out.append("s" + hashlib.sha256(repr(x).encode()).hexdigest()[:8] if isinstance(x, str | bytes) or strict else type(x).__name__)
            elif x is not None:
                out.append(str(x))
    out.append(")")


def parse_python(source: str, strict: bool = False, hashed: bool = True) -> Parsed:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_tokens(source, hashed)
    definitions, imports, digest = [], [], None
    if hashed:
        try:
            words: list[str] = []
            _structure(tree, strict, words)
            digest = _digest("ast:", words)
        except RecursionError:
            digest = _digest("source:", [source])
    todo = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            definitions.append(_definition(node.name, "function", node.lineno, _python_parameters(node.args), _written(node.returns) if node.returns else None))
        elif isinstance(node, ast.ClassDef):
            definitions.append(_definition(node.name, "class", node.lineno, [], None))
        elif isinstance(node, ast.Import):
            imports += [x.name for x in node.names if x.asname is None]
        elif isinstance(node, ast.ImportFrom):
            imports.append("." * node.level + (node.module or ""))
        todo += reversed(_statements(node))
    return Parsed(digest, definitions, list(dict.fromkeys(imports)), "ast")


_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)")
_FROM = re.compile(r"^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import\b")
_IMPORT = re.compile(r"^[ \t]*import[ \t]+([\w., \t]+)$")


def _python_tokens(source: str, hashed: bool = True) -> Parsed:
    """What can be told of text that is not valid Python."""
    words, code = [], source.split("\n")
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline) if hashed else ():
            if t.type in (tokenize.NAME, tokenize.OP, tokenize.STRING):
                words.append(t.string)
            elif t.type == tokenize.NUMBER:
                words.append("0")
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass
    definitions, imports = [], []
    for i, line in enumerate(code, 1):
        if m := _DEF.match(line):
            definitions.append(_definition(m[2], "function" if m[1] == "def" else "class", i, [], None))
        elif m := _FROM.match(line):
            imports.append(m[1])
        elif m := _IMPORT.match(line):
            imports += [x.strip() for x in m[1].split(",") if x.strip() and " as " not in x]
    return Parsed(_digest("ast:", words) if hashed else None, definitions, list(dict.fromkeys(imports)), "tokens")


# --- JavaScript and TypeScript

_SCRIPT = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<number>\b\d[\w.]*)|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<op>=>|\.\.\.|[{}()\[\];,<>+\-*%&|^!~?:=.@#/\\])|(?P<tick>`)|(?P<other>.)",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
# Words after which a slash begins a regular expression, and those that look like calls but are not methods.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_NO_METHOD = {"if", "for", "while", "switch", "catch", "return", "function", "with", "new", "typeof", "super", "do", "else", "await"}


def script_tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) without space and comments."""
    out, at, line, depth, templates = [], 0, 1, 0, []

    def template(at: int) -> tuple[int, bool]:
        """Where a template's text ends, and whether an expression begins there."""
        while at < len(source):
            if source[at] == "\\":
                at += 2
            elif source[at] == "`":
                return at + 1, False
            elif source.startswith("${", at):
                return at + 2, True
            else:
                at += 1
        return at, False

    while at < len(source):
        m = _SCRIPT.match(source, at)
        kind, words, end = m.lastgroup, m[0], m.end()
        if kind == "op" and words == "/":
            last = out[-1] if out else ("op", "(", 0)
            if (last[0] == "op" and last[1] not in (")", "]", "}") or last[0] == "name" and last[1] in _BEFORE_REGEX) and (r := _REGEX.match(source, at)):
                kind, words, end = "regex", r[0], r.end()
        elif kind == "tick" or kind == "op" and words == "}" and templates and templates[-1] == depth:
            if kind != "tick":
                templates.pop()
                depth -= 1
                out.append(("op", "}", line))
            end, more = template(at + 1)
            kind, words = "template", source[at:end]
            out.append((kind, words, line))
            if more:
                depth += 1
                templates.append(depth)
                out.append(("op", "{", line))
            line += words.count("\n")
            at = end
            continue
        if kind == "op" and words == "{":
            depth += 1
        elif kind == "op" and words == "}":
            depth -= 1
        if kind not in ("space", "comment"):
            out.append((kind, words, line))
        line += words.count("\n")
        at = end
    return out


def _closing(tokens: list, at: int) -> int:
    """The place of the bracket that closes the one at `at`."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    for i in range(at, len(tokens)):
        if tokens[i][0] == "op":
            if tokens[i][1] in pairs:
                depth += 1
            elif tokens[i][1] in pairs.values():
                depth -= 1
                if depth == 0:
                    return i
    return len(tokens)


def _script_parameters(tokens: list, at: int) -> list[str]:
    """Names in a bracket of parameters: plain, or with their default left open."""
    end, out, i = _closing(tokens, at), [], at + 1
    while i < end:
        own, depth = [], 0
        while i < end and not (tokens[i][1] == "," and depth == 0):
            depth += (tokens[i][1] in "([{") - (tokens[i][1] in ")]}") if tokens[i][0] == "op" else 0
            own.append(tokens[i])
            i += 1
        i += 1
        if own and own[0][0] == "name":
            words = [t[1] for t in own]
            out.append(f"{words[0]}=..." if "=" in words else words[0])
    return out


def parse_script(source: str, strict: bool = False, hashed: bool = True) -> Parsed:
    tokens = script_tokens(source)
    words = []
    for i, (kind, t, _) in enumerate(tokens if hashed else ()):
        before = tokens[i - 1][1] if i else ""
        if kind == "string" or kind == "regex":
            words.append("s" + hashlib.sha256(t.encode("utf-8", "replace")).hexdigest()[:8])
        elif kind in ("number", "template") and not strict:
            words.append(kind)
        elif kind == "name" and before == "." and not strict:
            words.append("property")
        else:
            words.append(t)
    definitions, imports, classes = [], [], []
    name_at = lambda i: tokens[i][1] if i < len(tokens) and tokens[i][0] == "name" else None
    text_at = lambda i: tokens[i][1] if i < len(tokens) else ""
    method_names = set()
    depth = 0
    for i, (kind, t, line) in enumerate(tokens):
        if kind == "op":
            depth += (t == "{") - (t == "}")
            while classes and t == "}" and depth < classes[-1]:
                classes.pop()
        if kind != "name" or i and text_at(i - 1) == ".":
            continue
        star = 1 if text_at(i + 1) == "*" else 0
        if t == "function" and (name := name_at(i + 1 + star)) and text_at(i + 2 + star) == "(":
            definitions.append((name, "function", line, True, _script_parameters(tokens, i + 2 + star), None))
        elif t == "class" and (name := name_at(i + 1)) and name != "extends":
            definitions.append((name, "class", line, True, [], None))
            classes.append(depth + 1)
        elif t in ("const", "let", "var"):
            j, level = i + 1, 0
            expects = True
            while j < len(tokens):
                k, x, n = tokens[j]
                if k == "op":
                    if level == 0 and (x == ";" or x in ")]}"):
                        break
                    level += (x in "([{") - (x in ")]}")
                    if level == 0 and x == ",":
                        expects = True
                        j += 1
                        continue
                elif level == 0 and expects and k == "name":
                    definitions.append((x, "variable", n, True, [], None))
                elif level == 0 and k == "name" and n > tokens[j - 1][2] and text_at(j - 1) not in ("=", "+", "-", "*", "/", "?", ":", "&", "|", "=>", "."):
                    break
                expects = False
                j += 1
        elif classes and depth == classes[-1] and text_at(i + 1) == "(" and t not in _NO_METHOD and text_at(_closing(tokens, i + 1) + 1) in ("{", ":"):
            method_names.add(i)
            definitions.append((t, "method", line, not t.startswith("_"), _script_parameters(tokens, i + 1), None))
        elif t == "import" and text_at(i + 1) != "(":
            for j in range(i + 1, min(len(tokens), i + 400)):
                if tokens[j][0] == "string":
                    imports.append(tokens[j][1][1:-1])
                    break
                if tokens[j][1] in (";", "="):
                    break
    if hashed and not strict:
        for i in method_names:
            words[i] = "property"
    return Parsed(_digest("ast:", words) if hashed else None, definitions, list(dict.fromkeys(imports)), "tokens")


def parse(language: str | None, source: str | bytes | None, strict: bool = False, hashed: bool = True) -> Parsed:
    """What a file defines and imports; nothing for other languages, null and text that is not UTF-8."""
    if source is None:
        return Parsed()
    if isinstance(source, bytes | bytearray):
        try:
            source = bytes(source).decode()
        except UnicodeDecodeError:
            return Parsed()
    if language in PYTHON:
        return parse_python(source, strict, hashed)
    if language in SCRIPTS:
        return parse_script(source, strict, hashed)
    return Parsed()


def parsed(files: DataFrame, content: str = "content", strict: bool = False, hashed: bool = True) -> DataFrame:
    """files with ast_hash (null unless hashed), definitions, imports and parse_mode from their language and content, in Arrow
    batches."""
    import pyarrow as pa

    kind = pa.struct([
        ("ast_hash", pa.string()),
        ("definitions", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("line", pa.int32()), ("is_public", pa.bool_()), ("parameters", pa.list_(pa.string())), ("return_type", pa.string())]))),
        ("imports", pa.list_(pa.string())), ("parse_mode", pa.string()),
    ])
    names = [f.name for f in kind.field("definitions").type.value_type]

    def run(language, source):
        rows = []
        for a, b in zip(language, source):
            p = parse(a.as_py(), b.as_py(), strict, hashed)
            rows.append({"ast_hash": p.ast_hash, "definitions": [dict(zip(names, d)) for d in p.definitions], "imports": p.imports, "parse_mode": p.parse_mode})
        return pa.array(rows, kind)

    run.__annotations__ = {"language": pa.Array, "source": pa.Array, "return": pa.Array}
    made = F.arrow_udf(run, f"struct<{re.sub(r'(^|, )(\w+) ', r'\1\2: ', PARSED)}>")
    return files.withColumn("_p", made("language", content)).select(*files.columns, "_p.*")


class ParseSource:
    """Table function parse_source(language, source): one row for each definition."""

    def eval(self, language: str, source: str):
        for d in parse(language, source).definitions:
            yield d


def register(spark) -> None:
    """Make parse_source known to SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("parse_source", udtf(ParseSource, returnType="name string, type string, line int, is_public boolean, parameters array<string>, return_type string"))
