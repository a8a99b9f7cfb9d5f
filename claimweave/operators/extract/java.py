"""Java sources: a lexer and a parser of declarations that needs no grammar package. Hashes are over this lexer's leaf tokens."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame

from claimweave.operators.extract.limits import SECONDS
from claimweave.operators.extract.rows import mapped
from claimweave.session import ship
from claimweave.tables import spread

#: kind is package, import, type, method, constructor, field, annotation, call, field_use, type_use, deferred or failed; detail is JSON by kind.
SCHEMA = "path string, kind string, qualname string, owner string, line_start int, line_end int, hash string, detail string"
#: What bodies are read for.
BODIES = {"call", "field_use", "deferred"}
dump = json.JSONEncoder(sort_keys=True).encode
TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?)|(?P<char>'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<num>(?:0[xXbB][0-9a-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<=|>>=|>>>=|[-+*/%&|^=!<>?:;,.(){}\[\]@~])|(?P<bad>.)",
    re.S,
)
MODIFIERS = set("public protected private static final abstract default synchronized native strictfp transient volatile sealed non-sealed".split())
TYPE_WORDS = {"class", "interface", "enum", "record"}
PRIMITIVE = set("void boolean byte short int long char float double var".split())
CONTROL = set("if for while switch catch synchronized return throw assert do else try new case yield instanceof super this".split())
OPEN, SHUT = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Tokens:
    def __init__(self, source: str) -> None:
        kinds: list[str] = []
        texts: list[str] = []
        lines: list[int] = []
        match: dict[int, int] = {}
        stack: list[tuple[int, str]] = []
        line = 1
        for m in TOKEN.finditer(source):
            kind, t = m.lastgroup, m[0]
            if kind == "skip":
                line += t.count("\n")
                continue
            if kind == "op":
                if t in OPEN:
                    stack.append((len(texts), OPEN[t]))
                elif t in SHUT:
                    while stack:
                        j, shut = stack.pop()
                        if shut == t:
                            match[j] = len(texts)
                            break
            kinds.append(kind)
            texts.append(t)
            lines.append(line)
            if kind in ("text", "char"):
                line += t.count("\n")
        self.kind, self.text, self.line, self.match = kinds, texts, lines, match

    def span_hash(self, a: int, b: int) -> str:
        return hashlib.sha256("\0".join(f"{k}:{t}" for k, t in zip(self.kind[a:b], self.text[a:b], strict=True)).encode()).hexdigest()

    def close(self, i: int) -> int:
        return self.match.get(i, len(self.text) - 1)

    def angle(self, i: int) -> int:
        """Behind the type arguments that open at i."""
        depth = 0
        while i < len(self.text):
            t = self.text[i]
            depth += (t == "<") - (t == ">")
            i += 1
            if depth == 0:
                break
            if t in ";{}":
                break
        return i


def joined(tokens: list[str]) -> str:
    """Types as text: a space only between words."""
    out = ""
    for t in tokens:
        out += " " + t if out and (out[-1].isalnum() or out[-1] in "_$?") and (t[0].isalnum() or t[0] in "_$") else t
    return out


def literal(tokens: list[str], kinds: list[str]) -> object:
    """The value of a literal argument: text, number, boolean, T.class, an array of those; None for any expression."""
    if not tokens:
        return None
    if tokens[0] == "{" and tokens[-1] == "}":
        parts = [literal(t, k) for t, k in split_args(tokens[1:-1], kinds[1:-1])]
        return parts if all(p is not None for p in parts) else None
    if len(tokens) == 1:
        if kinds[0] == "text":
            return tokens[0].strip('"')
        if kinds[0] == "num" or tokens[0] in ("true", "false"):
            return tokens[0]
        return None
    if tokens[0] == "-" and len(tokens) == 2 and kinds[1] == "num":
        return "-" + tokens[1]
    if tokens[-1] == "class" and tokens[-2] == ".":
        return "".join(tokens)
    if all(k == "id" or t == "." for k, t in zip(kinds, tokens, strict=True)):
        return "".join(tokens)  # a constant's name, kept opaque
    return None


def split_args(tokens: list[str], kinds: list[str]) -> list[tuple[list[str], list[str]]]:
    out, depth, at = [], 0, 0
    for i, t in enumerate(tokens):
        if kinds[i] == "op":
            depth += (t in "([{<") - (t in ")]}>") if t not in ("->", "<=", ">=") else 0
            if t == "," and depth <= 0:
                out.append((tokens[at:i], kinds[at:i]))
                at = i + 1
    if at < len(tokens):
        out.append((tokens[at:], kinds[at:]))
    return out


class Parser:
    def __init__(self, path: str, source: str, want: dict[str, tuple[str, ...]] | None = None) -> None:
        self.path, self.t, self.want = path, Tokens(source), want
        self.bodies = want is None or bool(BODIES & want.keys())
        self.rows: list[tuple] = []
        self.package = ""

    def add(self, kind: str, name: str | None, owner: str | None, a: int, b: int, detail: dict) -> None:
        t, columns = self.t, ("hash", "detail") if self.want is None else self.want.get(kind)
        if columns is None:
            return
        last = min(b, len(t.text)) - 1
        self.rows.append((self.path, kind, name, owner, t.line[a] if t.line else 1, t.line[last] if t.line else 1, t.span_hash(a, b) if "hash" in columns else None, dump(detail) if "detail" in columns else None))

    def run(self) -> list[tuple]:
        t, i, n = self.t, 0, len(self.t.text)
        while i < n:
            w = t.text[i]
            if w in ("package", "import"):
                j = i
                while j < n and t.text[j] != ";":
                    j += 1
                words = t.text[i + 1 : j]
                static = bool(words) and words[0] == "static"
                name = "".join(words[static:])
                if w == "package":
                    self.package = name
                    self.add("package", name, None, i, j, {})
                else:
                    wild = name.endswith(".*")
                    self.add("import", None if wild else name.rsplit(".", 1)[-1], None, i, j, {"fqn": name.removesuffix(".*"), "static": static, "wildcard": wild})
                i = j + 1
            elif w == ";":
                i += 1
            else:
                nxt = self.member(i, n, None, None)
                i = nxt if nxt > i else i + 1
        return self.rows

    def annotations(self, i: int) -> tuple[int, list[tuple[int, int, str, list]], list[str]]:
        """Annotations and modifiers from i on."""
        t, notes, words = self.t, [], []
        while i < len(t.text):
            if t.text[i] == "@" and t.text[i + 1 : i + 2] != ["interface"]:
                a, i = i, i + 1
                j = i
                while j + 1 < len(t.text) and t.text[j + 1] == ".":
                    j += 2
                name, i = "".join(t.text[i : j + 1]), j + 1
                args: list = []
                if i < len(t.text) and t.text[i] == "(":
                    e = t.close(i)
                    for own, kinds in split_args(t.text[i + 1 : e], t.kind[i + 1 : e]):
                        key, value, vk = ("value", own, kinds) if own[1:2] != ["="] else (own[0], own[2:], kinds[2:])
                        args.append((key, literal(value, vk), all(k == "text" or x in "{,}" for x, k in zip(value, vk, strict=True))))
                    i = e + 1
                notes.append((a, i, name, args))
            elif t.text[i] in MODIFIERS or t.text[i] == "non" and t.text[i + 1 : i + 3] == ["-", "sealed"]:
                words.append(t.text[i])
                i += 1 if t.text[i] in MODIFIERS else 3
            else:
                break
        return i, notes, words

    def note_rows(self, notes: list, owner: str, owner_kind: str, words: list[str], declarators: int = 1, nested: int = 0, anonymous: bool = False) -> None:
        for a, b, name, args in notes:
            self.add("annotation", name, owner, a, b, {"owner_kind": owner_kind, "args": {k: v for k, v, _ in args}, "literal": all(v is not None for _, v, _ in args), "texts": [k for k, v, text in args if text], "n_args": len(args), "static": "static" in words, "count": sum(x[2] == name for x in notes), "declarators": declarators, "nested": nested, "anonymous": anonymous})

    def member(self, i: int, end: int, owner: str | None, owner_kind: str | None, anonymous: bool = False) -> int:
        """Parses the member that starts at i; returns what follows it."""
        t = self.t
        start = i
        i, notes, words = self.annotations(i)
        if i >= end:
            return end
        w = t.text[i]
        if w == "@" or w in TYPE_WORDS and t.kind[i + 1 : i + 2] == ["id"] and t.text[i + 2 : i + 3] != ["="]:
            return self.type_decl(start, i, end, owner, notes, words)
        if w == "{":
            if owner:
                self.body(i, t.close(i), f"{owner}.<init>", owner, {})
            return t.close(i) + 1
        if owner is None or w in SHUT or w == ";":
            return i + 1
        generic = w == "<"
        if generic:
            i = t.angle(i)
        a = i
        while i < end and t.text[i] not in ("(", "=", ";", ",", "{"):
            i = t.angle(i) if t.text[i] == "<" else i + 1
        if i >= end:
            return end
        nested = owner.count(".")
        if t.text[i] in ("(", "{"):  # "{": a compact canonical constructor
            name, kind = t.text[i - 1], "method" if i - 1 > a else "constructor"
            params, j = (self.params(i, t.close(i)), t.close(i) + 1) if t.text[i] == "(" else ([], i)
            throws = []
            while j < end and t.text[j] not in ("{", ";", "default"):
                if t.text[j] == "throws":
                    k = j + 1
                    while k < end and t.text[k] not in ("{", ";"):
                        k += 1
                    throws = [joined(x) for x, _ in split_args(t.text[j + 1 : k], t.kind[j + 1 : k])]
                    j = k
                else:
                    j += 1
            while j < end and t.text[j] not in ("{", ";"):
                j += 1
            has_body = j < end and t.text[j] == "{"
            stop = t.close(j) + 1 if has_body else j + 1
            qual = f"{owner}.{name if kind == 'method' else owner.rsplit('.', 1)[-1]}"
            returns = joined(t.text[a : i - 1]) if kind == "method" else None
            detail = {"return_type": returns, "params": params, "throws": throws, "modifiers": words, "generic": generic, "varargs": bool(params) and params[-1]["varargs"], "arity": len(params), "owner_kind": owner_kind}
            self.add(kind, qual, owner, start, stop, detail)
            self.note_rows(notes, qual, kind, words, nested=nested, anonymous=anonymous)
            for use, text in [("return", returns), *[("param", p["type"]) for p in params]]:
                self.type_uses(text, use, qual, a, i)
            if has_body:
                self.body(j, stop - 1, qual, owner, {p["name"]: p["type"] for p in params})
            return stop
        # fields
        b = i - 1
        type_text = joined(t.text[a:b])
        names, j = [t.text[b]], i
        while j < end and t.text[j] != ";":
            if t.text[j] == ",":
                names.append(t.text[j + 1] if j + 1 < end else "")
                j += 1
            elif t.text[j] in OPEN:
                j = t.close(j) + 1
            elif t.text[j] == "=":
                j += 1
                while j < end and t.text[j] not in (",", ";"):
                    j = t.close(j) + 1 if t.text[j] in OPEN else t.angle(j) if t.text[j] == "<" and t.kind[j + 1 : j + 2] == ["id"] and t.text[j - 1] in ("new",) else j + 1
            else:
                j += 1
        if b <= a:
            return j + 1
        const = {"static", "final"} <= set(words) or owner_kind == "interface"
        for name in names:
            self.add("field", f"{owner}.{name}", owner, start, min(j + 1, end), {"type": type_text, "node_kind": "constant" if const else "field", "modifiers": words})
            self.note_rows(notes, f"{owner}.{name}", "field", words, len(names), nested, anonymous)
            self.type_uses(type_text, "field", f"{owner}.{name}", a, b)
        return j + 1

    def params(self, a: int, b: int) -> list[dict]:
        out = []
        for own, _ in split_args(self.t.text[a + 1 : b], self.t.kind[a + 1 : b]):
            while own and (own[0] == "final" or own[0] == "@"):
                if own[0] == "final":
                    own = own[1:]
                    continue
                own = own[2:]
                while own[:1] == ["."]:
                    own = own[2:]
                if own[:1] == ["("]:
                    depth = 0
                    for k, x in enumerate(own):
                        depth += (x == "(") - (x == ")")
                        if depth == 0:
                            own = own[k + 1 :]
                            break
            if len(own) >= 2:
                more = "..." in own
                out.append({"type": joined([x for x in own[:-1] if x != "..."]) + ("[]" if more else ""), "name": own[-1], "varargs": more})
        return out

    def type_decl(self, start: int, i: int, end: int, owner: str | None, notes: list, words: list[str]) -> int:
        t = self.t
        kind = "interface" if t.text[i] == "@" else {"record": "class"}.get(t.text[i], t.text[i])
        i += 2 if t.text[i] == "@" else 1
        name = t.text[i]
        record = t.text[i - 1] == "record"
        qual = f"{owner}.{name}" if owner else name
        i += 1
        heads: dict[str, list[str]] = {"extends": [], "implements": [], "permits": []}
        header: list[dict] = []
        if i < end and t.text[i] == "<":
            i = t.angle(i)
        if i < end and t.text[i] == "(":
            header, i = self.params(i, t.close(i)), t.close(i) + 1
        while i < end and t.text[i] != "{":
            word, a = t.text[i], i + 1
            j = a
            while j < end and t.text[j] not in ("{", "extends", "implements", "permits"):
                j = t.angle(j) if t.text[j] == "<" else j + 1
            if word in heads:
                heads[word] += [joined(x) for x, _ in split_args(t.text[a:j], t.kind[a:j])]
            i = j if j > i else i + 1
        if i >= end:
            return end
        stop = t.close(i)
        self.add("type", qual, owner, start, stop + 1, {"node_kind": kind, "package": self.package, "modifiers": words, "record": record, **heads})
        self.note_rows(notes, qual, kind, words, nested=qual.count("."))
        for p in header:
            self.add("field", f"{qual}.{p['name']}", qual, start, i, {"type": p["type"], "node_kind": "field", "modifiers": ["private", "final"]})
            self.type_uses(p["type"], "record_component", f"{qual}.{p['name']}", start, i)
        j = i + 1
        if kind == "enum":
            while j < stop and t.text[j] != ";":
                j = t.close(j) + 1 if t.text[j] in OPEN else j + 1
            j += 1
        while j < stop:
            nxt = self.member(j, stop, qual, kind)
            j = nxt if nxt > j else j + 1
        return stop + 1

    def type_uses(self, text: str | None, use: str, user: str, a: int, b: int) -> None:
        for name in type_names(text):
            self.add("type_use", name, user, a, max(b, a + 1), {"use_kind": use})

    def body(self, a: int, b: int, caller: str, owner: str, known: dict[str, str]) -> None:
        """Calls and field uses of a body. What a lambda or an anonymous class holds runs later, so it is only a reason."""
        if not self.bodies:
            return
        t = self.t
        local = dict(known)
        later: list[tuple[int, int, str]] = []
        i = a + 1
        while i < b:
            w, k = t.text[i], t.kind[i]
            if w == "->" and t.text[i + 1 : i + 2] == ["{"]:
                later.append((i + 1, t.close(i + 1), "java_lambda_deferred_context_not_modeled"))
            elif w == "->":
                j, depth = i + 1, 0
                while j < b:
                    if t.text[j] in OPEN:
                        j = t.close(j)
                    elif t.text[j] in (",", ";") or t.text[j] in SHUT:
                        break
                    j += 1
                del depth
                later.append((i + 1, j, "java_lambda_deferred_context_not_modeled"))
            elif w == "::":
                self.add("deferred", None, caller, i, i + 1, {"reason": "java_method_reference_relationship_not_modeled"})
            elif w == "new":
                j = i + 1
                while j < b and t.text[j] not in ("(", "[", "{", ";"):
                    j = t.angle(j) if t.text[j] == "<" else j + 1
                if j < b and t.text[j] == "(" and t.text[t.close(j) + 1 : t.close(j) + 2] == ["{"]:
                    e = t.close(j) + 1
                    later.append((e, t.close(e), "java_anonymous_class_body_deferred_context_not_modeled"))
            elif k == "id" and w not in CONTROL and i + 1 < b and t.kind[i + 1] == "id" and t.text[i + 2 : i + 3] and t.text[i + 2] in ("=", ";", ":", ",") and t.text[i - 1] in ("{", "}", ";", "(", "final", ")"):
                local[t.text[i + 1]] = w
            elif k == "id" and t.text[i + 1 : i + 2] == ["<"] and t.text[i - 1] in ("{", "}", ";", "(", "final"):
                e = t.angle(i + 1)
                if e + 1 < b and t.kind[e] == "id" and t.text[e + 1] in ("=", ";", ":"):
                    local[t.text[e]] = joined(t.text[i:e])
            i += 1
        for x, y, reason in later:
            self.add("deferred", None, caller, x, y + 1, {"reason": reason})

        def deferred(i: int) -> bool:
            return any(x <= i <= y for x, y, _ in later)

        for i in range(a + 1, b):
            if t.kind[i] != "id" or deferred(i) or t.text[i - 1] == "@":
                continue
            w, prev = t.text[i], t.text[i - 1]
            if t.text[i + 1 : i + 2] == ["("] and (w in ("this", "super") or w not in CONTROL):
                args = split_args(t.text[i + 2 : t.close(i + 1)], t.kind[i + 2 : t.close(i + 1)])
                first = literal(*args[0]) if args and args[0][1] == ["text"] else None
                detail = {"argc": len(args), "args": [arg_type(x, k, local) for x, k in args], "base": None, "first": first}
                if w in ("this", "super"):
                    if prev != ".":
                        self.add("call", "<init>", caller, i, t.close(i + 1) + 1, detail | {"shape": w + "_constructor", "owner": owner})
                    continue
                j = i
                while t.text[j - 1] == "." and t.kind[j - 2] == "id":
                    j -= 2
                chain = [x for x in t.text[j:i] if x != "."]
                if t.text[j - 1] == "new":
                    self.add("call", ".".join([*chain, w]), caller, i, t.close(i + 1) + 1, detail | {"shape": "new", "owner": owner})
                elif t.text[j - 1] == ".":
                    shape = "chained" if t.text[j - 2] == ")" and not chain else "other"
                    self.add("call", w, caller, i, t.close(i + 1) + 1, detail | {"shape": shape, "owner": owner, "inner": self.inner_call(j - 2, local) if shape == "chained" else None})
                elif not chain:
                    self.add("call", w, caller, i, t.close(i + 1) + 1, detail | {"shape": "bare", "owner": owner})
                elif chain in (["this"], ["super"]):
                    self.add("call", w, caller, i, t.close(i + 1) + 1, detail | {"shape": chain[0], "owner": owner})
                elif len(chain) == 1 or chain[0] == "this" and len(chain) == 2:
                    v = chain[-1]
                    self.add("call", w, caller, i, t.close(i + 1) + 1, detail | {"shape": "variable", "owner": owner, "base": v, "base_type": local.get(v) if chain[0] != "this" else None})
                else:
                    self.add("call", w, caller, i, t.close(i + 1) + 1, detail | {"shape": "other", "owner": owner})
            elif w not in CONTROL and t.text[i + 1 : i + 2] != ["("] and (prev != "." or t.text[i - 2] == "this") and w not in PRIMITIVE and (w not in local or prev == "."):
                after = t.text[i + 1] if i + 1 < b else ""
                before = t.text[i - 3] if prev == "." else prev
                step = after in ("++", "--") or before in ("++", "--")
                compound = len(after) >= 2 and after[-1] == "=" and after not in ("==", "<=", ">=", "!=")
                for kind in ["read", "write"] if compound or step else ["write"] if after == "=" else ["read"]:
                    self.add("field_use", w, caller, i, i + 1, {"use": kind, "owner": owner, "this": prev == "."})

    def inner_call(self, shut: int, local: dict[str, str]) -> dict | None:
        t = self.t
        opened = next((o for o, s in t.match.items() if s == shut), None)
        if opened is None or t.kind[opened - 1] != "id":
            return None
        name, base = t.text[opened - 1], None
        if t.text[opened - 2] == "." and t.kind[opened - 3] == "id" and t.text[opened - 4] != ".":
            base = t.text[opened - 3]
        return {"name": name, "base": base, "base_type": local.get(base) if base else None, "argc": len(split_args(t.text[opened + 1 : shut], t.kind[opened + 1 : shut]))}


def arg_type(tokens: list[str], kinds: list[str], local: dict[str, str]) -> str | None:
    """The type of an argument that shows it: a literal, a new, a cast or a typed name."""
    if not tokens:
        return None
    if len(tokens) == 1:
        x, k = tokens[0], kinds[0]
        if k == "text":
            return "String"
        if k == "char":
            return "char"
        if x in ("true", "false"):
            return "boolean"
        if k == "num":
            return "long" if x[-1] in "lL" else "float" if x[-1] in "fF" and not x.startswith("0x") else "double" if "." in x or x[-1] in "dD" and not x.startswith("0x") else "int"
        return local.get(x)
    if tokens[0] == "new" and "(" in tokens:
        return joined(tokens[1 : tokens.index("(")])
    if tokens[0] == "(" and ")" in tokens and tokens.index(")") + 1 < len(tokens) and kinds[1] == "id":
        return joined(tokens[1 : tokens.index(")")])
    return None


NAME = re.compile(r"[^\W\d][\w$]*(?:\.[^\W\d][\w$]*)*")


def type_names(text: str | None) -> list[str]:
    """The non-primitive types that a type's text names, in order."""
    return [n for n in NAME.findall(text or "") if n not in PRIMITIVE and n not in ("extends", "super", "final")]


def parse_type(text: str) -> dict:
    """raw, erased, simple_name, array_dims, varargs, primitive, type_arguments, wildcard of a type's text."""
    raw = text.strip()
    varargs = raw.endswith("...")
    body = raw.removesuffix("...").strip()
    dims = int(varargs)
    while body.endswith("[]"):
        body, dims = body[:-2].strip(), dims + 1
    wildcard = None
    if body.startswith("?"):
        wildcard = "extends" if " extends " in body else "super" if " super " in body else "unbounded"
        body = body[1:].strip().removeprefix("extends").removeprefix("super").strip()
    head, _, rest = body.partition("<")
    args: list[str] = []
    if rest:
        depth, at = 0, 0
        inner = rest[: rest.rfind(">")]
        for i, ch in enumerate(inner + ","):
            depth += (ch == "<") - (ch == ">")
            if ch == "," and depth == 0:
                args.append(inner[at:i].strip())
                at = i + 1
    erased = head.strip()
    return {"raw": raw, "erased": erased, "simple_name": erased.rsplit(".", 1)[-1], "array_dims": dims, "varargs": varargs, "primitive": erased in PRIMITIVE - {"var"}, "type_arguments": args, "wildcard": wildcard}


def _read(path: str, text: str, want: dict[str, tuple[str, ...]] | None = None) -> Parser:
    p = Parser(path, text, want)
    try:
        p.run()
    except (IndexError, RecursionError):
        pass  # broken sources end early; rows so far stand
    return p


def java_rows(files: DataFrame, seconds: float = SECONDS, want: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """files (path, text): all rows of all files, or of the kinds in want, with those of hash and detail that are asked for. A file that can't
    be read to its end gives what was read; one that takes longer than it may is one row of kind failed."""
    ship(files.sparkSession)
    own = spread(files.select("path", "text").where("path like '%.java'"), "path")
    return mapped(own, lambda path, text: _read(path, text, want).rows, SCHEMA, seconds, lambda path, reason: (path, "failed", reason, None, 1, 1, None, "{}"))
