"""Python sources: functions, classes, declarations, routes, and the references that resolvers join."""

from __future__ import annotations

import ast
import hashlib
import io
import json
import tokenize
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from claimweave.operators.extract.limits import SECONDS
from claimweave.operators.extract.rows import mapped
from claimweave.session import ship
from claimweave.tables import spread

#: kind is function, class, declaration, api, import, call, read, write, env_read, config_read or failed; detail is JSON by kind.
SCHEMA = "path string, kind string, qualname string, owner string, line_start int, line_end int, hash string, docstring string, detail string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
MADE = ("hash", "docstring", "detail")
REFERENCES = {"call", "read", "write", "env_read", "config_read"}
LAYOUT = {tokenize.INDENT, tokenize.DEDENT, tokenize.NEWLINE}
TRIVIA = {tokenize.ENCODING, tokenize.COMMENT, tokenize.NL, tokenize.ENDMARKER}
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Where a node has nodes that are looked at; operators and contexts aren't.
CHILDREN = {c: tuple(f for f in c._fields if f not in ("ctx", "op", "ops")) for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST)} | {ast.Name: (), ast.Constant: ()}
#: Where a node has statements, or nodes that have some; definitions and imports stand nowhere else.
BODIES = ("body", "handlers", "orelse", "finalbody", "cases")
NESTING = {c: tuple(f for f in c._fields if f in BODIES) for c in CHILDREN if issubclass(c, (ast.mod, ast.stmt, ast.excepthandler, ast.match_case))}
dump = json.JSONEncoder(sort_keys=True).encode


class Tokens:
    """A file's tokens without comments and blank lines, read once; spans are hashed from them."""

    def __init__(self, source: str) -> None:
        self.rows: list[tuple[bool, int, int, str]] = []
        try:
            for t in tokenize.generate_tokens(io.StringIO(source).readline):
                if t.type not in TRIVIA:
                    name = tokenize.tok_name[t.type]
                    self.rows.append((t.type in LAYOUT, t.start[0], t.end[0], name if t.type in LAYOUT else f"{name}:{t.string}"))
        except (tokenize.TokenError, IndentationError):
            self.rows = []
        self.starts = [r[1] for r in self.rows]

    def span_hash(self, first: int, last: int) -> str:
        """Of the tokens on these lines; block tokens before the first or after the last real token belong to what is around them."""
        own = self.rows[bisect_left(self.starts, first) : bisect_right(self.starts, last)]
        real = [i for i, r in enumerate(own) if not r[0]]
        text = "\0".join(r[3] for r in own[real[0] : real[-1] + 1]) if real else ""
        return hashlib.sha256(text.encode()).hexdigest()


def dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def text_of(node: ast.AST | None) -> str | None:
    return ast.unparse(node) if node is not None else None


def literal(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def children(n: ast.AST) -> list[ast.AST]:
    out: list[ast.AST] = []
    for f in CHILDREN[type(n)]:
        v = getattr(n, f, None)
        if isinstance(v, list):
            out += [x for x in v if isinstance(x, ast.AST)]
        elif isinstance(v, ast.AST):
            out.append(v)
    return out


def nested(n: ast.AST) -> list[ast.AST]:
    """The statements (handlers, cases) right below a node."""
    at = NESTING.get(type(n), ())
    return getattr(n, at[0]) if len(at) == 1 else [x for f in at for x in getattr(n, f)]


def own_nodes(fn: ast.AST) -> list[ast.AST]:
    """What a function's body holds, nested functions and classes aside."""
    out, todo = [], children(fn)[::-1]
    while todo:
        n = todo.pop()
        out.append(n)
        if CHILDREN[type(n)] and not isinstance(n, (*DEFS, ast.ClassDef)):
            todo += children(n)[::-1]
    return out


def interface(fn: ast.FunctionDef | ast.AsyncFunctionDef, inner: list[ast.AST]) -> dict:
    """Signature, parameters, what it returns and raises, decorators. inner: its own nodes."""
    a = fn.args
    params, shown = [], []

    def add(arg: ast.arg, kind: str, default: ast.AST | None, mark: str = "") -> None:
        note, value = text_of(arg.annotation), text_of(default)
        params.append({"name": arg.arg, "kind": kind, "annotation": note, "default": value})
        shown.append(mark + arg.arg + (f": {note}" if note else "") + (f"={value}" if value is not None else ""))

    plain = a.posonlyargs + a.args
    for arg, default in zip(plain, [None] * (len(plain) - len(a.defaults)) + a.defaults, strict=True):
        add(arg, "positional", default)
    if a.vararg:
        add(a.vararg, "vararg", None, "*")
    elif a.kwonlyargs:
        shown.append("*")
    for arg, default in zip(a.kwonlyargs, a.kw_defaults, strict=True):
        add(arg, "kwonly", default)
    if a.kwarg:
        add(a.kwarg, "kwarg", None, "**")
    returns = [n.value is not None for n in inner if isinstance(n, ast.Return)]
    note = text_of(fn.returns)
    shape = "value" if any(returns) else "bare" if returns else "annotation_only" if note else "none"
    raised, todo = set(), [fn]
    while todo:
        n = todo.pop()
        todo += nested(n)
        if isinstance(n, ast.Raise) and n.exc is not None:
            e = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
            raised |= {e.id} if isinstance(e, ast.Name) else {e.attr} if isinstance(e, ast.Attribute) else set()
    word = "async def" if isinstance(fn, ast.AsyncFunctionDef) else "def"
    marks = [d.func if isinstance(d, ast.Call) else d for d in fn.decorator_list]
    return {
        "signature": f"{word} {fn.name}({', '.join(shown)})" + (f" -> {note}" if note else ""),
        "params": params,
        "is_async": word != "def",
        "is_generator": any(isinstance(n, (ast.Yield, ast.YieldFrom)) for n in inner),
        "return": {"shape": shape, "annotation": note, "has_value": any(returns), "has_bare": not all(returns)},
        "raises": sorted(raised),
        "decorators": [dotted(d) or ast.unparse(d) for d in marks],
    }


def routes(fn: ast.FunctionDef | ast.AsyncFunctionDef) -> list[tuple[str, str, int]]:
    """(method, path, line) of literal route decorators."""
    out = []
    for d in fn.decorator_list:
        if not isinstance(d, ast.Call) or not d.args or (path := literal(d.args[0])) is None:
            continue
        name = dotted(d.func)
        if name == "app.route":
            given = next((k.value for k in d.keywords if k.arg == "methods"), None)
            if given is None:
                methods = ["GET"]
            elif isinstance(given, (ast.List, ast.Tuple, ast.Set)):
                methods = [literal(x) for x in given.elts]
            else:
                methods = [literal(given)]
            if all(m is not None for m in methods):
                out += [(m.upper(), path, d.lineno) for m in methods]
        elif name and name.startswith("router.") and name[7:] in ("get", "post", "put", "delete", "patch"):
            out.append((name[7:].upper(), path, d.lineno))
    return out


def references(fn: ast.FunctionDef | ast.AsyncFunctionDef, inner: list[ast.AST]) -> Iterator[tuple[str, dict]]:
    """(kind, detail) of what a function refers to. inner: its own nodes."""
    args = fn.args
    globals_ = {g for n in inner if isinstance(n, ast.Global) for g in n.names}
    local = {x.arg for x in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, [args.vararg, args.kwarg])]}
    local |= {n.id for n in inner if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} - globals_
    files: dict[str, str] = {}
    for n in inner:
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and dotted(n.value.func) == "json.load" and n.value.args:
            opened = n.value.args[0]
            if isinstance(opened, ast.Call) and dotted(opened.func) == "open" and opened.args and (p := literal(opened.args[0])):
                files |= {t.id: p for t in n.targets if isinstance(t, ast.Name)}
    bases = set()
    for n in inner:
        if isinstance(n, ast.Call):
            f, name = n.func, dotted(n.func)
            if name in ("os.getenv", "os.environ.get"):
                key = literal(n.args[0]) if n.args else None
                yield "env_read", {"name": key, "reason": None if key else "env_key_not_literal" if n.args else "env_key_missing"}
            elif isinstance(f, ast.Name):
                yield "call", {"shape": "name", "base": None, "name": f.id, "local": f.id in local}
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                yield "call", {"shape": "self" if f.value.id == "self" else "attribute", "base": f.value.id, "name": f.attr, "local": f.value.id in local and f.value.id != "self"}
            else:
                yield "call", {"shape": "dynamic", "base": None, "name": ast.unparse(f), "local": False}
        elif isinstance(n, ast.Subscript) and dotted(n.value) == "os.environ" and isinstance(n.ctx, ast.Load):
            key = literal(n.slice)
            yield "env_read", {"name": key, "reason": None if key else "env_key_not_literal"}
        elif isinstance(n, ast.Subscript) and id(n) not in bases:
            chain, at = [], n
            while isinstance(at, ast.Subscript):
                chain.append(literal(at.slice))
                bases.add(id(at.value))
                at = at.value
            if isinstance(at, ast.Name) and at.id in files:
                ok = all(k is not None for k in chain)
                yield "config_read", {"file": files[at.id], "key": ".".join(reversed(chain)) if ok else None, "reason": None if ok else "config_key_not_literal"}
        elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id not in local:
            yield "read", {"name": n.id}
        if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Delete)):
            op = {ast.Assign: "assignment", ast.AnnAssign: "annotated_assignment", ast.AugAssign: "augmented_assignment", ast.Delete: "delete"}[type(n)]
            for t in n.targets if isinstance(n, (ast.Assign, ast.Delete)) else [n.target]:
                if isinstance(t, ast.Name):
                    yield "write", {"name": t.id, "op": op, "reason": None if t.id in globals_ else "assignment_without_global_is_local"}


def facts_of(path: str, source: str, want: dict[str, tuple[str, ...]] | None = None) -> list[tuple]:
    """All rows of a file, with the detail as a dictionary; none if it doesn't parse. want: the kinds that are asked for, and which of hash,
    docstring and detail their rows are to have; what isn't asked for isn't made."""
    if not path.endswith(".py"):
        return []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    made: list[Tokens] = []
    out: list[tuple] = []
    asks = (lambda kind, column: True) if want is None else lambda kind, column: column in want.get(kind, ())
    wanted = (lambda kind: True) if want is None else want.__contains__
    refers = REFERENCES if want is None else REFERENCES & want.keys()

    def span_hash(first: int, last: int) -> str:
        if not made:
            made.append(Tokens(source))
        return made[0].span_hash(first, last)

    def add(kind: str, name: str | None, owner: str | None, first: int, last: int, detail: dict | None = None, node: ast.AST | None = None, hashed: bool = True) -> None:
        out.append((path, kind, name, owner, first, last, span_hash(first, last) if hashed and asks(kind, "hash") else None, ast.get_docstring(node) if node is not None and asks(kind, "docstring") else None, detail if asks(kind, "detail") else None))

    def function(n: ast.AST, name: str, cls: str | None) -> None:
        inner = own_nodes(n) if refers or asks("function", "detail") else []
        if wanted("function"):
            add("function", name, cls, n.lineno, n.end_lineno, interface(n, inner) if asks("function", "detail") else None, n)
        if wanted("api") and n.decorator_list:
            found = routes(n)
            for method, route, _ in found:
                add("api", name, route, min(x[2] for x in found), n.end_lineno, {"method": method, "route_path": route})
        if refers:
            for kind, detail in references(n, inner):
                if kind in refers:
                    add(kind, detail.get("name"), name, n.lineno, n.end_lineno, detail | {"class": cls}, hashed=False)

    def visit(body: ast.AST, stack: tuple[str, ...], cls: str | None) -> None:
        for n in nested(body):
            if isinstance(n, DEFS):
                function(n, ".".join((*stack, n.name)), cls)
                visit(n, (*stack, n.name), None)
            elif isinstance(n, ast.ClassDef):
                name = ".".join((*stack, n.name))
                if wanted("class"):
                    add("class", name, cls, n.lineno, n.end_lineno, {"bases": [dotted(b) for b in n.bases]}, n)
                visit(n, (*stack, n.name), name)
            elif type(n) in NESTING:
                visit(n, stack, cls)

    if want is None or refers or want.keys() & {"function", "api", "class"}:
        visit(tree, (), None)
    if wanted("declaration"):
        for n in tree.body:
            if isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and (t.id.isupper() or isinstance(n.value, ast.Dict)):
                        add("declaration", t.id, None, n.lineno, n.end_lineno, {"declaration_kind": "constant" if t.id.isupper() else "config_dict"})
    if wanted("import"):
        todo = list(nested(tree))
        for n in todo:  # it grows: those of a level come before those below them
            if isinstance(n, ast.Import):
                for a in n.names:
                    add("import", a.asname or a.name, None, n.lineno, n.lineno, {"module": a.name, "symbol": None, "level": 0}, hashed=False)
            elif isinstance(n, ast.ImportFrom):
                for a in n.names:
                    add("import", a.asname or a.name, None, n.lineno, n.lineno, {"module": n.module or "", "symbol": a.name, "level": n.level}, hashed=False)
            else:
                todo += nested(n)
    return out


def rows_of(path: str, source: str, want: dict[str, tuple[str, ...]] | None = None) -> list[tuple]:
    """facts_of a file with the detail as JSON; null where it isn't asked for."""
    return [(*r[:-1], dump(r[-1] or {}) if want is None or "detail" in want[r[1]] else None) for r in facts_of(path, source, want)]


def python_rows(files: DataFrame, seconds: float = SECONDS, want: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """files (path, text): all rows of all files, or of the kinds in want with the columns that are asked for, one pass over each. A file
    that takes longer than it may is one row of kind failed."""
    ship(files.sparkSession)
    own = spread(files.select("path", "text").where("path like '%.py'"), "path")
    return mapped(own, lambda path, text: rows_of(path, text, want), SCHEMA, seconds, lambda path, reason: (path, "failed", reason, None, 1, 1, None, None, "{}"))
