"""Symbols and relationships from source text: one Arrow pass per file set, a row per fact.

Output of ``extract``: tag (symbol, edge, diagnostic) with the columns of both records, null where they do not apply. A
file that a parser refuses yields one diagnostic row and nothing else; no exception leaves the pass. Languages other than
Python, JavaScript, TypeScript and Go yield nothing. Null and empty texts yield nothing.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = ("tag string, file_id string, path string, id string, name string, qualified_name string, kind string, line int, end_line int, analyzer string, confidence string, parent_id string, "
          "signature string, exported boolean, source_id string, target_id string, target_name string, receiver_type_hint string")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def stable_id(namespace: str, *parts) -> str:
    return f"{namespace}_{hashlib.sha1(chr(31).join(map(str, (namespace, *parts))).encode()).hexdigest()[:16]}"


def symbol(path, name, qualified, kind, line, end, analyzer, confidence, *, parent=None, signature=None, exported=None, ident=None) -> dict:
    return {"tag": "symbol", "path": path, "id": ident or stable_id("symbol", path, kind, qualified, line), "name": name, "qualified_name": qualified, "kind": kind, "line": line, "end_line": end,
            "analyzer": analyzer, "confidence": confidence, "parent_id": parent, "signature": signature, "exported": not name.startswith("_") if exported is None else exported}


def edge(path, source, kind, target_name, line, analyzer, confidence, *, target=None, hint=None) -> dict:
    key = target if kind == "contains" and target else f"{target_name}{chr(31)}{hint}" if kind == "import" and hint and analyzer == "python-ast" else target_name
    return {"tag": "edge", "path": path, "id": stable_id("rel", kind, source, key, path, line), "source_id": source, "target_id": target, "target_name": target_name, "kind": kind, "line": line,
            "analyzer": analyzer, "confidence": confidence, "receiver_type_hint": hint}


def diagnostic(path, code, message, line=None) -> dict:
    return {"tag": "diagnostic", "path": path, "id": stable_id("diag", path, code, line), "name": code, "target_name": message, "line": line}


# -- Python ---------------------------------------------------------------------------------------------------------------


def _chain(node: ast.AST) -> str | None:
    """a.b.c of names and attributes only."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(parts)])


def python_facts(file_id: str, path: str, text: str) -> list[dict]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [diagnostic(path, "python-syntax-error", str(e)[:200], getattr(e, "lineno", None))]
    out: list[dict] = []

    def scope(body, owner: str, prefix: str, in_class: bool) -> None:
        # Only bodies are walked: decorators and defaults give no calls.
        todo = list(reversed(body))
        while todo:
            n = todo.pop()
            if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                klass = isinstance(n, ast.ClassDef)
                kind = "class" if klass else "method" if in_class else "async-function" if isinstance(n, ast.AsyncFunctionDef) else "function"
                qualified = f"{prefix}.{n.name}" if prefix else n.name
                s = symbol(path, n.name, qualified, kind, n.lineno, n.end_lineno, "python-ast", "exact", parent=None if owner == file_id else owner, signature=None if klass else ast.unparse(n.args))
                out.append(s)
                out.append(edge(path, owner, "contains", qualified, n.lineno, "python-ast", "exact", target=s["id"]))
                scope(n.body, s["id"], qualified, klass)
                continue
            if isinstance(n, ast.Import):
                for a in n.names:
                    out.append(edge(path, owner, "import", a.name, n.lineno, "python-ast", "exact", hint=f"binding:{a.asname or a.name.split('.')[0]}"))
            elif isinstance(n, ast.ImportFrom):
                for a in n.names:
                    out.append(edge(path, owner, "import", f"{n.module or ''}.{a.name}".strip("."), n.lineno, "python-ast", "exact", hint=f"binding:{a.asname or a.name}"))
            elif isinstance(n, ast.Call) and (name := _chain(n.func)):
                out.append(edge(path, owner, "calls", name, n.lineno, "python-ast", "heuristic"))
            todo.extend(reversed(list(ast.iter_child_nodes(n))))

    scope(tree.body, file_id, "", False)
    return out


# -- JavaScript and TypeScript ----------------------------------------------------------------------------------------------

_JS_IMPORT = re.compile(r"""\bimport\s+(?:type\s+)?(?:[\w*{}\s,$]+?\s+from\s+)?["']([^"']+)["']|\brequire\(\s*["']([^"']+)["']\s*\)|\bexport\s+[\w*{}\s,$]+?\s+from\s+["']([^"']+)["']""")
_JS_DECLARE = [
    ("class", re.compile(r"^[ \t]*(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", re.M)),
    ("function", re.compile(r"^[ \t]*(export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(\([^\n{]*\))?", re.M)),
    ("function", re.compile(r"^[ \t]*(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(\([^)\n]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>", re.M)),
]


def _line_at(starts: list[int], pos: int) -> int:
    return bisect.bisect_right(starts, pos)


def javascript_facts(file_id: str, path: str, text: str) -> list[dict]:
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out, seen = [], set()
    for m in _JS_IMPORT.finditer(text):
        out.append(edge(path, file_id, "import", m[1] or m[2] or m[3], _line_at(starts, m.start()), "javascript-regex", "heuristic"))
    for kind, pattern in _JS_DECLARE:
        for m in pattern.finditer(text):
            line = _line_at(starts, m.start(2))
            if (m[2], line) in seen:
                continue
            seen.add((m[2], line))
            s = symbol(path, m[2], m[2], kind, line, line, "javascript-regex", "heuristic", signature=m[3] if m.re.groups > 2 else None, exported=bool(m[1]))
            out += [s, edge(path, file_id, "contains", m[2], line, "javascript-regex", "heuristic", target=s["id"])]
    return out


# -- Go ---------------------------------------------------------------------------------------------------------------------

_GO_TOKEN = re.compile(r"""//[^\n]*|/\*[\s\S]*?\*/|`[^`]*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+'|[^\W\d]\w*|\n|\S""")
_GO_WORDS = frozenset("""break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var
append cap clear close complex copy delete imag len make max min new panic print println real recover any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64
rune string uint uint8 uint16 uint32 uint64 uintptr""".split())


def _go_tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, word, line): comments dropped, literals opaque."""
    out, line = [], 1
    for m in _GO_TOKEN.finditer(text):
        w = m[0]
        if w == "\n":
            out.append(("nl", w, line))
            line += 1
        elif w.startswith(("//", "/*")):
            line += w.count("\n")
        else:
            kind = "lit" if w[0] in "`\"'" else "id" if w[0].isalpha() or w[0] == "_" else "op"
            out.append((kind, w, line))
            line += w.count("\n")
    return out


def go_facts(file_id: str, path: str, text: str) -> list[dict]:
    toks = [t for t in _go_tokens(text) if t[0] != "nl"]
    close: dict[int, int] = {}
    stack = []
    for i, (_, w, line) in enumerate(toks):
        if w in "([{" and len(w) == 1:
            stack.append(i)
        elif w in ")]}" and len(w) == 1:
            if not stack or "([{".index(toks[stack[-1]][1]) != ")]}".index(w):
                return [diagnostic(path, "go-unbalanced", f"unexpected {w}", line)]
            close[stack.pop()] = i
    if stack:
        return [diagnostic(path, "go-unbalanced", "unclosed delimiter", toks[stack[-1]][2])]
    if len(toks) < 2 or toks[0][1] != "package":
        return [diagnostic(path, "go-package-missing", "no package clause", 1)]
    package, n, i = toks[1][1], len(toks), 2
    analyzer = f"go-lexical[package={package}]"
    out: list[dict] = []
    functions: dict[str, str] = {}
    bodies: list[tuple[str, int, int, set[str]]] = []

    def declare(name, qualified, kind, a, b, confidence, signature):
        ident = stable_id("symbol", path, package, qualified, kind, " ".join(signature.split()))
        out.append(symbol(path, name, qualified, kind, toks[a][2], toks[b][2], analyzer, confidence, signature=signature, exported=name[:1].isupper(), ident=ident))
        out.append(edge(path, file_id, "contains", name, toks[a][2], analyzer, confidence, target=ident))
        return ident

    def words(a, b):
        return " ".join(w for _, w, _ in toks[a:b])

    while i < n:
        w = toks[i][1]
        if w == "import":
            j, end = (i + 2, close[i + 1]) if i + 1 < n and toks[i + 1][1] == "(" else (i + 1, i + 3)
            while j < min(end, n):
                alias = None
                if toks[j][0] != "lit":
                    alias, j = toks[j][1], j + 1
                if j < n and toks[j][0] == "lit":
                    module = toks[j][1].strip("\"`")
                    out.append(edge(path, file_id, "import", module, toks[j][2], analyzer, "syntax-exact"))
                    out.append(edge(path, file_id, "go-import-alias", f"{alias or module.rsplit('/', 1)[-1]}={module}", toks[j][2], analyzer, "syntax-exact"))
                    if end == i + 3 and alias is None:
                        j += 1
                        break
                j += 1
            i = max(j, end) if i + 1 < n and toks[i + 1][1] == "(" else j
            if i < n and toks[i][1] == ")":
                i += 1
            continue
        if w == "type":
            group = i + 1 < n and toks[i + 1][1] == "("
            j, end = (i + 2, close[i + 1]) if group else (i + 1, n)
            while j < end and toks[j][0] == "id":
                name, k = toks[j][1], j + 1
                if k < n and toks[k][1] == "[" and k + 1 < n and toks[k + 1][0] == "id":
                    k = close[k] + 1
                what = toks[k][1] if k < n else ""
                if what in ("struct", "interface") and k + 1 < n and toks[k + 1][1] == "{":
                    last = close[k + 1]
                    declare(name, name, what, j, last, "syntax-exact", f"type {name} {what}")
                    if what == "interface":
                        m = k + 2
                        while m < last:
                            if toks[m][0] == "id" and toks[m + 1][1] == "(":
                                declare(toks[m][1], f"{name}.{toks[m][1]}", "interface-method", m, close[m + 1], "syntax-exact", words(m, close[m + 1] + 1))
                                m = close[m + 1]
                            m += 1
                else:
                    last = k
                    declare(name, name, "type", j, k if k < n else j, "syntax-heuristic", f"type {name}")
                j = last + 1
                if not group:
                    break
                line = toks[last][2]
                while j < end and toks[j][2] == line:
                    j = close.get(j, j) + 1
            i = close[i + 1] + 1 if group else j
            continue
        if w == "func" and i + 1 < n:
            j, owner = i + 1, None
            binds: set[str] = set()
            if toks[j][1] == "(":
                names = [t[1] for t in toks[j + 1 : close[j]] if t[0] == "id"]
                owner = names[-1] if names else None
                binds.update(names[:-1])
                j = close[j] + 1
            if j < n and toks[j][0] == "id":
                name = toks[j][1]
                k = j + 1
                while k < n and toks[k][1] != "{" and not (toks[k][2] > toks[k - 1][2] and toks[k - 1][1] in (")", "]")):
                    if toks[k][1] == "(":
                        for a in range(k + 1, close[k]):
                            if toks[a][0] == "id" and toks[a - 1][1] in "(,":
                                binds.add(toks[a][1])
                    k = close.get(k, k) + 1
                last = close[k] if k < n and toks[k][1] == "{" else k - 1
                qualified = f"{owner}.{name}" if owner else name
                ident = declare(name, qualified, "method" if owner else "function", i, last, "syntax-exact", words(i, k))
                if owner is None:
                    functions[name] = ident
                if k < n and toks[k][1] == "{":
                    bodies.append((ident, k, last, binds))
                i = last + 1
                continue
        i = close.get(i, i) + 1
    for ident, a, b, binds in bodies:
        local = set(binds)
        for k in range(a + 1, b):
            kind, w, line = toks[k]
            if kind == "op" and w == ":" and toks[k + 1][1] == "=":
                back = k - 1
                while back > a and (toks[back][0] == "id" or toks[back][1] == ",") and toks[back][2] == line:
                    if toks[back][0] == "id":
                        local.add(toks[back][1])
                    back -= 1
            if kind != "id" or w in _GO_WORDS or toks[k - 1][1] in (".", "func"):
                continue
            chain, m = [w], k + 1
            while m + 1 < b and toks[m][1] == "." and toks[m + 1][0] == "id":
                chain.append(toks[m + 1][1])
                m += 2
            if m < b and toks[m][1] == "[" and close[m] + 1 < b and toks[close[m] + 1][1] == "(":
                m = close[m] + 1
            if m < b and toks[m][1] == "(":
                shadowed = chain[0] in local
                target = functions.get(chain[0]) if len(chain) == 1 and not shadowed else None
                out.append(edge(path, ident, "calls", ".".join(chain), line, analyzer, "syntax-shadowed-unresolved" if shadowed else "syntax-exact" if target else "syntax-unresolved", target=target))
    return out


ANALYZERS = {".py": python_facts, ".pyi": python_facts, ".js": javascript_facts, ".jsx": javascript_facts, ".mjs": javascript_facts, ".cjs": javascript_facts, ".ts": javascript_facts, ".tsx": javascript_facts, ".go": go_facts}


def file_facts(file_id: str, path: str, text: str) -> list[dict]:
    """Facts of one file; whatever fails inside a parser becomes a diagnostic."""
    f = ANALYZERS.get("." + path.rsplit(".", 1)[-1].lower())
    if f is None or not text:
        return []
    try:
        return f(file_id, path, text)
    except Exception as e:  # noqa: BLE001
        return [diagnostic(path, "analyzer-failed", f"{type(e).__name__}: {e}"[:200])]


def extract(files: DataFrame) -> DataFrame:
    """files (file_id, path, text) -> rows of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, p, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                for f in file_facts(i, p or "", t):
                    f["file_id"] = i
                    rows.append(f)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[s.split()[1]]) for c, s in zip(COLUMNS, SCHEMA.split(", "))], COLUMNS)

    return files.select("file_id", "path", "text").where("text is not null").mapInArrow(run, SCHEMA)


# -- entry markers, boundaries and public structure --------------------------------------------------------------------------

ENTRY_FILES = ["__main__.py", "main.py", "app.py", "cli.py", "server.py", "main.go", "main.ts", "main.tsx", "index.ts", "index.tsx", "index.js", "cli.ts", "cli.tsx", "server.ts", "server.js", "main.js"]


def entry_line(path: str, text: str | None) -> int | None:
    """The line that declares a file executable: shebang, main guard, uvicorn.run, app.listen or Go's main; conventional names only."""
    if not text or path.rsplit("/", 1)[-1].lower() not in ENTRY_FILES:
        return None
    if text.startswith("#!"):
        return 1
    if path.endswith(".py"):
        try:
            body = ast.parse(text).body
        except (SyntaxError, ValueError):
            return None
        for s in body:
            if isinstance(s, ast.If) and isinstance(t := s.test, ast.Compare) and isinstance(t.left, ast.Name) and t.left.id == "__name__" and isinstance(t.comparators[0], ast.Constant) and t.comparators[0].value == "__main__":
                return s.lineno
            if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and _chain(s.value.func) == "uvicorn.run":
                return s.lineno
        return None
    if path.endswith(".go"):
        if not re.search(r"^\s*package\s+main\b", text, re.M):
            return None
        m = re.search(r"^\s*func\s+main\s*\(", text, re.M)
    else:
        m = re.search(r"\b(?:app|server)\s*\.\s*listen\s*\(", text)
    return text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1 if m else None


#: Factories whose objects are known to serve routes or commands (fixed values).
FACTORIES = {"fastapi.FastAPI": "http", "fastapi.APIRouter": "http", "flask.Flask": "http", "flask.Blueprint": "http", "starlette.applications.Starlette": "http", "starlette.routing.Router": "http",
             "argparse.ArgumentParser": "cli", "click.Group": "cli", "typer.Typer": "cli"}
VERBS = ["get", "post", "put", "patch", "delete", "head", "options"]


def python_boundaries(path: str, text: str | None) -> list[tuple[str, str, int]]:
    """(kind, label, line) of routes and commands whose receiver is proven: bound once at module level to a known factory.

    A documented subset of the full provenance analysis: straight-line module code only; a rebound receiver proves nothing.
    """
    try:
        body = ast.parse(text or "").body
    except (SyntaxError, ValueError):
        return []
    imports: dict[str, str] = {}
    bound: dict[str, list[str | None]] = {}
    for s in body:
        if isinstance(s, ast.Import):
            for a in s.names:
                imports[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(s, ast.ImportFrom) and s.module and not s.level:
            for a in s.names:
                imports[a.asname or a.name] = f"{s.module}.{a.name}"
    for n in ast.walk(ast.Module(body, [])):
        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
            bound.setdefault(n.id, []).append(None)
    for s in body:
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(s.value, ast.Call) and (c := _chain(s.value.func)):
            head, _, rest = c.partition(".")
            full = ".".join(filter(None, [imports.get(head, head), rest]))
            bound[s.targets[0].id][-1] = FACTORIES.get(full)
    proven = {k: v[0] for k, v in bound.items() if len(v) == 1 and v[0]}
    out = []
    for s in body:
        calls = [(d, s.lineno) for d in s.decorator_list] if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) else [(s.value, s.lineno)] if isinstance(s, ast.Expr) else []
        for c, line in calls:
            if not (isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute) and isinstance(c.func.value, ast.Name) and c.args and isinstance(c.args[0], ast.Constant) and isinstance(c.args[0].value, str)):
                continue
            what, member, label = proven.get(c.func.value.id), c.func.attr, c.args[0].value
            if what == "http" and label.startswith("/"):
                if member in VERBS:
                    out.append(("http-route", f"{member.upper()} {label}", line))
                elif member in ("route", "api_route", "add_api_route", "add_url_rule"):
                    given = next((k.value for k in c.keywords if k.arg == "methods"), None)
                    names = [e.value for e in given.elts if isinstance(e, ast.Constant)] if isinstance(given, (ast.List, ast.Tuple)) else ["GET"]
                    out += [("http-route", f"{m.upper()} {label}", line) for m in names]
            elif what == "cli" and member in ("command", "add_parser") and re.fullmatch(r"[A-Za-z0-9_.:-]+", label):
                out.append(("cli-command", label, line))
    return out


_JS_FACTORY = re.compile(r"""^(?:const|let|var)\s+(\w+)\s*=\s*(?:require\(\s*["'](express|fastify|koa-router|commander|yargs)["']\s*\)\(?[^\n;]*|(?:new\s+)?(express|Router|Fastify|fastify|Command)\([^\n;]*\))\s*;?\s*$""", re.M)
_JS_CALL = re.compile(r"""^(\w+)\.(get|post|put|patch|delete|head|options|command)\(\s*["']([^"'\n]+)["']""", re.M)


def javascript_boundaries(path: str, text: str | None) -> list[tuple[str, str, int]]:
    """Routes and commands at module level on receivers bound once to a known factory; a documented subset, as above."""
    text = text or ""
    made: dict[str, int] = {}
    for m in re.finditer(r"^(?:const|let|var)\s+(\w+)\s*=|^(\w+)\s*=(?!=)", text, re.M):
        made[m[1] or m[2]] = made.get(m[1] or m[2], 0) + 1
    proven = {m[1]: "cli" if (m[2] or m[3]) in ("commander", "yargs", "Command") else "http" for m in _JS_FACTORY.finditer(text) if made.get(m[1]) == 1}
    out = []
    for m in _JS_CALL.finditer(text):
        what, line = proven.get(m[1]), text.count("\n", 0, m.start()) + 1
        if what == "http" and m[2] != "command" and m[3].startswith("/"):
            out.append(("http-route", f"{m[2].upper()} {m[3]}", line))
        elif what == "cli" and m[2] == "command":
            out.append(("cli-command", m[3].split()[0], line))
    return out


def python_structure_digest(text: str | None) -> str | None:
    """Digest of signatures, bases, class keywords and properties, decorators and imports of a file; bodies do not count. Null where it does not parse."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return None
    lines: list[str] = []

    def walk(body, prefix):
        for n in body:
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                lines.append(f"{prefix}{ast.unparse(n)}")
            elif isinstance(n, ast.ClassDef):
                lines.append(f"{prefix}class {n.name}({', '.join(map(ast.unparse, n.bases))}) {[(k.arg, ast.unparse(k.value)) for k in n.keywords]} {[ast.unparse(d) for d in n.decorator_list]}")
                for c in n.body:
                    if isinstance(c, (ast.Assign, ast.AnnAssign)):
                        kind = ast.unparse(c.annotation) if isinstance(c, ast.AnnAssign) else None
                        lines.extend(f"{prefix}{n.name} property {t.id}: {kind}" for t in (c.targets if isinstance(c, ast.Assign) else [c.target]) if isinstance(t, ast.Name))
                walk(n.body, prefix + n.name + ".")
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                lines.append(f"{prefix}{type(n).__name__} {n.name}({ast.unparse(n.args)}) -> {ast.unparse(n.returns) if n.returns else ''} {[ast.unparse(d) for d in n.decorator_list]}")

    walk(tree.body, "")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def per_file(files: DataFrame, f, schema: str) -> DataFrame:
    """f(path, text) -> rows (tuples) for every file; schema names file_id first."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [_TYPES[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [(i, *r) for i, p, t in zip(*(b.column(k).to_pylist() for k in range(3))) for r in f(p or "", t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    return files.select("file_id", "path", "text").mapInArrow(run, schema)
