"""Source files to entities and raw relationships in Arrow batches; one parser for each language family."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillgraph.schemas import ENTITY, fields

KINDS = {name: kind for name, kind in fields(ENTITY) if name not in ("file_path", "language")}
FIELDS = list(KINDS)
#: What adds one to cyclomatic complexity: branches, loops, cases, handlers and short-circuit operators.
BRANCH = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?|\?(?![.:?])")
CALL = re.compile(r"(?<![\w.])(new\s+)?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
WORDS = frozenset("if for while switch catch return function typeof await super constructor import".split())
CLASS = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:<[^{]*?>)?(?:\s+extends\s+([\w$.]+))?(?:<[^{]*?>)?(?:\s+implements\s+([\w$.,\s<>]+?))?\s*\{", re.M)
INTERFACE = re.compile(r"^\s*(?:export\s+)?(?:interface\s+([A-Za-z_$][\w$]*)[^{=]*\{|type\s+([A-Za-z_$][\w$]*)(?:<[^=]*>)?\s*=)", re.M)
FUNCTION = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\(((?:[^()]|\([^()]*\))*)\)\s*(?::\s*([^{=]+?))?\s*\{", re.M)
ARROW = re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(async\s+)?(?:\(((?:[^()]|\([^()]*\))*)\)|([A-Za-z_$][\w$]*))\s*(?::\s*([^=]+?))?\s*=>", re.M)
METHOD = re.compile(r"^[ \t]*((?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*)([A-Za-z_$#][\w$]*)\s*(?:<[^(]*>)?\(((?:[^()]|\([^()]*\))*)\)\s*(?::\s*([^{;=]+?))?\s*\{", re.M)
PROPERTY = re.compile(r"^[ \t]*((?:(?:public|private|protected|static|readonly|declare)\s+)*)([A-Za-z_$#][\w$]*)\s*[?!]?\s*(?::\s*[^=;({]+)?\s*(?:=[^>][^;\n]*)?;", re.M)
VARIABLE = re.compile(r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::\s*([^=;]+?))?\s*=\s*(?!.*=>)([^;\n]*)", re.M)
IMPORT = re.compile(r"^\s*import\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\*\s+as\s+([\w$]+)|\{([^}]*)\})?\s*(?:from\s+)?['\"]([^'\"]+)['\"]", re.M)
EXPORT = re.compile(r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:class|function\s*\*?|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)|^\s*export\s*\{([^}]*)\}", re.M)
BRACKET = re.compile(r"[{}]")
DOC = re.compile(r"/\*\*((?:(?!\*/).)*)\*/\s*$", re.S)


def blanked(code: str) -> str:
    """The code with comments and texts as spaces, so that places stay."""
    return re.sub(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", lambda m: re.sub(r"[^\n]", " ", m[0]), code, flags=re.S)


def closing(code: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`."""
    depth = 0
    for m in BRACKET.finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


@lru_cache(maxsize=4)
def line_starts(code: str) -> list[int]:
    return [m.end() for m in re.finditer("\n", code)]


def line_of(code: str, at: int) -> int:
    """The number of the line, from 1, that a place is in."""
    return bisect_right(line_starts(code), at) + 1


def entity(path: str, kind: str, name: str, code: str, start: int, end: int, **more: Any) -> dict[str, Any]:
    line, last = line_of(code, start), line_of(code, end)
    base = dict.fromkeys(FIELDS) | {"id": f"{path}:{kind}:{name}:{line}", "entity_type": kind, "name": name, "line": line, "end_line": last, "column": start - (code.rfind("\n", 0, start) + 1), "line_count": last - line + 1, "content": code[start:end]}
    return base | more


def split_parameters(text: str | None) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text or "":
        depth += (c in "<({[") - (c in ">)}]")
        if c == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [p for p in [*out, part.strip()] if p]


def parse_script(path: str, code: str) -> tuple[list[dict], list[tuple[str, str, str, int]]]:
    """Entities of TypeScript or JavaScript, and (source id, kind, name, line) of raw relationships."""
    plain, out, raw = blanked(code), [], []
    doc = lambda at: (m[1].replace("*", " ").strip() if (from_ := code.rfind("/**", 0, at)) >= 0 and (m := DOC.search(code, from_, at)) else None)

    def function(name: str, start: int, body: int, end: int, params: str | None, result: str | None, marks: str, parent: str | None) -> None:
        own = plain[body:end]
        fid = f"{path}:Function:{name}:{line_of(plain, start)}"
        sees = "private" if "private" in marks or name.startswith(("_", "#")) else "protected" if "protected" in marks else "public"
        names = split_parameters(params)
        signature = f"{name}({', '.join(names)})" + (f": {result.strip()}" if result else "")
        out.append(entity(path, "Function", name, code, start, end, signature=signature, parameters=names, complexity=1 + len(BRANCH.findall(own)), visibility=sees, is_static="static" in marks, is_async="async" in marks, documentation=doc(start), parent_class=parent))
        for c in CALL.finditer(own):
            if c[2].split(".")[0] not in WORDS and c[2] != name:
                raw.append((fid, "CALLS", c[2].removeprefix("this."), line_of(plain, body + c.start())))

    classes = []
    for m in CLASS.finditer(plain):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        body = m.end() - 1
        end = closing(plain, body)
        classes.append((body, end))
        implements = [re.sub(r"<.*", "", i).strip() for i in (m[3] or "").split(",") if i.strip()]
        out.append(entity(path, "Class", m[1], code, start, end, extends=m[2], implements=implements, documentation=doc(start), visibility="public"))
        at = body + 1
        while (k := METHOD.search(plain, at, end)) is not None:
            open_, stop = k.end() - 1, closing(plain, k.end() - 1)
            for p in PROPERTY.finditer(plain, at, k.start()):
                out.append(entity(path, "Variable", p[2], code, p.start(), p.end(), parent_class=m[1], is_static="static" in p[1], visibility="private" if "private" in p[1] else "public"))
            if k[2] not in WORDS or k[2] == "constructor":
                function(k[2], k.start() + len(k[0]) - len(k[0].lstrip()), open_, stop, code[k.start(3) : k.end(3)], k[4], k[1], m[1])
            at = stop
        for p in PROPERTY.finditer(plain, at, end):
            out.append(entity(path, "Variable", p[2], code, p.start(), p.end(), parent_class=m[1], is_static="static" in p[1], visibility="private" if "private" in p[1] else "public"))
    outside = lambda at: all(not (a < at < b) for a, b in classes)
    for m in FUNCTION.finditer(plain):
        if outside(m.start()):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            function(m[2], start, m.end() - 1, closing(plain, m.end() - 1), code[m.start(3) : m.end(3)], m[4], m[1] or "", None)
    for m in ARROW.finditer(plain):
        if outside(m.start()):
            after = m.end() + len(plain[m.end() :]) - len(plain[m.end() :].lstrip())
            end = closing(plain, after) if plain[after : after + 1] == "{" else (plain.find("\n", after) + 1 or len(plain)) - 1
            function(m[1], m.start() + len(m[0]) - len(m[0].lstrip()), after, max(after, end), m[3] if m[3] is not None else m[4], m[5], m[2] or "", None)
    for m in INTERFACE.finditer(plain):
        end = closing(plain, m.end() - 1) if m[1] else (plain.find(";", m.end()) + 1 or len(plain))
        out.append(entity(path, "Interface" if m[1] else "Type", m[1] or m[2], code, m.start() + len(m[0]) - len(m[0].lstrip()), end))
    for m in VARIABLE.finditer(plain):
        out.append(entity(path, "Constant" if "const" in m[0][:14] else "Variable", m[1], code, m.start(), m.end(), signature=(m[2] or "").strip() or None))
    for m in IMPORT.finditer(code):
        names = [(n.split(" as ")[0].strip(), n.split(" as ")[-1].strip()) for n in (m[3] or "").split(",") if n.strip()]
        names += ([("default", m[1])] if m[1] else []) + ([("*", m[2])] if m[2] else [])
        for imported, local in names or [("", "")]:
            out.append(entity(path, "Import", local or m[4], code, m.start(), m.end(), signature=f"{imported}|{local}|{m[4]}"))
    for m in EXPORT.finditer(plain):
        for n in [m[1]] if m[1] else [x.split(" as ")[-1].strip() for x in m[2].split(",") if x.strip()]:
            out.append(entity(path, "Export", n, code, m.start(), m.end(), signature="default" if "default" in m[0] else "named"))
    return out, raw


def parse_python(path: str, code: str) -> tuple[list[dict], list[tuple[str, str, str, int]]]:
    """The same for Python, by its own syntax tree."""
    tree, rows, out, raw = ast.parse(code), code.splitlines(keepends=True), [], []
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r))
    span = lambda n: (starts[n.lineno - 1] + n.col_offset, min(len(code), starts[(n.end_lineno or n.lineno) - 1] + (n.end_col_offset or 0)))
    branches = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)

    def visit(node: ast.AST, parent: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                names = [a.arg for a in (*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs) if a.arg not in ("self", "cls")]
                c = 1 + sum(isinstance(x, branches) for x in ast.walk(n)) + sum(len(x.values) - 1 for x in ast.walk(n) if isinstance(x, ast.BoolOp))
                e = entity(path, "Function", n.name, code, *span(n), signature=f"{n.name}({', '.join(names)})", parameters=names, complexity=c, visibility="private" if n.name.startswith("_") else "public", is_async=isinstance(n, ast.AsyncFunctionDef), is_static=any(getattr(d, "id", "") == "staticmethod" for d in n.decorator_list), documentation=ast.get_docstring(n), parent_class=parent)
                out.append(e)
                for x in ast.walk(n):
                    if isinstance(x, ast.Call):
                        raw.append((e["id"], "CALLS", ast.unparse(x.func).removeprefix("self."), x.lineno))
                visit(n, parent)
            elif isinstance(n, ast.ClassDef):
                bases = [ast.unparse(b) for b in n.bases]
                out.append(entity(path, "Class", n.name, code, *span(n), extends=bases[0] if bases else None, implements=bases[1:], documentation=ast.get_docstring(n), visibility="public"))
                visit(n, n.name)
            elif isinstance(n, ast.Import | ast.ImportFrom):
                module = getattr(n, "module", None)
                for a in n.names:
                    spec = "." * getattr(n, "level", 0) + (module or "") if isinstance(n, ast.ImportFrom) else a.name
                    out.append(entity(path, "Import", a.asname or a.name, code, *span(n), signature=f"{a.name if isinstance(n, ast.ImportFrom) else '*'}|{a.asname or a.name}|{spec}"))
            elif isinstance(n, ast.Assign | ast.AnnAssign):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        out.append(entity(path, "Constant" if t.id.isupper() else "Variable", t.id, code, *span(n), parent_class=parent))
            else:
                visit(n, parent)

    visit(tree, None)
    return out, raw


PARSERS: dict[str, Callable[[str, str], tuple[list[dict], list[tuple[str, str, str, int]]]]] = {"typescript": parse_script, "javascript": parse_script, "python": parse_python}


def parse(path: str, language: str, code: str) -> tuple[list[dict], list[tuple[str, str, str, int]], str | None]:
    """Entities, raw relationships and the fault if the file can't be parsed; unknown languages have none."""
    parser = PARSERS.get(language)
    if parser is None or not code:
        return [], [], None
    try:
        return *parser(path, code), None
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], [], f"{type(e).__name__}: {e}"[:200]


#: Rows and characters that an output batch holds at most, but for the last file's.
BATCH_ROWS, BATCH_CHARS = 5_000, 4_000_000
#: What a call is reported with, by the callee's name.
RELATION = "src string, rel_type string, name string, line int"


def column(values: tuple, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # half of a surrogate pair, written as an escape in a text
        return pa.array([v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for v in values], kind)


def table(files: DataFrame, rows_of: Callable[[str, str, str], Iterable[tuple]], ddl: str) -> DataFrame:
    """file_path and language of files (path, language, content) with a row for each that rows_of yields."""
    schema = StructType.fromDDL(f"file_path string, language string, {ddl}")
    fields_ = list(to_arrow_schema(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(zip(*rows, strict=True), fields_, strict=True)], schema=pa.schema(fields_))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for path, language, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(path, language, *r) for r in rows_of(path, language, code)]
                size += len(code or "")
                if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
                    if out:
                        yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)

    return files.select("path", "language", "content").mapInArrow(work, schema)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt evenly over several tasks a core, for what costs much more to parse than to read: a table of few bytes is read by one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def entities(files: DataFrame) -> DataFrame:
    """files (path, language, content) as entities."""
    return table(files, lambda *f: (tuple(e[k] for k in FIELDS) for e in parse(*f)[0]), ", ".join(f"`{f}` {kind}" for f, kind in KINDS.items()))


def raw_relations(files: DataFrame) -> DataFrame:
    return table(files, lambda *f: parse(*f)[1], RELATION).drop("language")


def imports(entities_: DataFrame) -> DataFrame:
    """id, file_path, imported, local, spec of Import entities."""
    part = F.split("signature", r"\|")
    return entities_.filter("entity_type = 'Import'").select("id", "file_path", part[0].alias("imported"), part[1].alias("local"), part[2].alias("spec"))


def exports(entities_: DataFrame) -> DataFrame:
    """file_path, name, entity_id, is_default: Export entities with what they name in their file."""
    named = entities_.filter("entity_type NOT IN ('Export', 'Import')").groupBy("file_path", "name").agg(F.min("id").alias("entity_id"))
    return entities_.filter("entity_type = 'Export'").select("file_path", "name", (F.col("signature") == "default").alias("is_default")).distinct().join(named, ["file_path", "name"])
