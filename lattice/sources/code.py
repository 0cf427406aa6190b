"""Symbols, imports, calls and base classes of source files, in one pass over the texts.

Python is parsed by its own grammar; other languages by patterns over text without comments and
strings. Every record has one schema, and edges are resolved by joins afterwards.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.operators.joins import contains_join
from lattice.session import scratch

_COLUMNS = ["project", "path", "lang", "what", "name", "extra", "line"]
RECORD = "project STRING, path STRING, lang STRING, what STRING, name STRING, extra STRING, line BIGINT"

# Calls that say nothing about a program, by language.
NOISE = {
    "python": "print len range int str float list dict set isinstance hasattr getattr type super enumerate zip sorted open bool tuple map filter any all min max abs repr id vars next iter reversed round",
    "typescript": "log parseInt parseFloat String Number Boolean Array Object Promise setTimeout require console Error Map Set JSON Date Math RegExp",
    "swift": "print fatalError precondition debugPrint assert",
    "kotlin": "println print listOf mapOf setOf arrayOf emptyList emptyMap",
    "rust": "println eprintln format panic todo unimplemented vec assert assert_eq assert_ne dbg write writeln Some None Ok Err Box Arc Rc Vec String",
    "go": "Println Printf Sprintf Fprintf Errorf Fatal Fatalf Log Logf Panicf New Error make append len cap close delete copy panic recover",
    "java": "println printf format toString equals hashCode valueOf parseInt parseDouble getName getClass System String Integer Long Boolean List Map",
    "ruby": "puts print p pp raise require require_relative attr_reader attr_writer attr_accessor include extend new to_s to_i to_f nil? empty? each map select",
    "c": "printf fprintf sprintf snprintf scanf malloc calloc realloc free memcpy memset strlen strcmp strcpy assert exit abort sizeof",
    "cpp": "printf fprintf sprintf snprintf malloc calloc free memcpy memset strlen strcmp assert exit abort cout cerr endl move forward make_shared make_unique static_cast dynamic_cast reinterpret_cast",
}
_ALIAS = {"tsx": "typescript"}
_KEYWORDS = frozenset("if for while switch catch return sizeof function func fn def class new else elif when match guard in is not and or do try with as await async yield throw defined unless until case where using typeof delete void".split())

#: Patterns of definitions: (kind, pattern with a name group). Names are those of the language's grammar nodes.
_SYMBOLS = {
    "typescript": (("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>\w+)")),
    "swift": (("function", r"^[^\n/]*?\bfunc\s+(?P<n>\w+)"), ("protocol", r"^[^\n/]*?\bprotocol\s+(?P<n>\w+)"), ("class", r"^[^\n/]*?\b(?:class|struct|enum|actor)\s+(?!func\b|var\b)(?P<n>\w+)")),
    "kotlin": (("function", r"^[^\n/]*?\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<n>\w+)"), ("class", r"^[^\n/]*?\b(?:class|interface|object)\s+(?P<n>\w+)")),
    "rust": (("function", r"^[^\n/]*?\bfn\s+(?P<n>\w+)"), ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(?P<n>\w+)"), ("protocol", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)")),
    "go": (("function", r"^func\s+(?:\([^)]*\)\s*)?(?P<n>\w+)"), ("class", r"^type\s+(?P<n>\w+)")),
    "java": (("protocol", r"^[^\n/(]*?\binterface\s+(?P<n>\w+)"), ("class", r"^[^\n/(]*?\b(?:class|enum)\s+(?P<n>\w+)"), ("function", r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?[\w.<>\[\],?]+\s+(?P<n>\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?[{;]")),
    "ruby": (("function", r"^\s*def\s+(?:self\.)?(?P<n>[\w?!=]+)"), ("class", r"^\s*(?:class|module)\s+(?P<n>\w+)")),
    "c": (("function", r"^[A-Za-z_][\w\s*]*?\b(?P<n>\w+)\s*\([^;{}]*\)\s*\{"), ("class", r"^\s*(?:typedef\s+)?(?:struct|enum)\s+(?P<n>\w+)\s*\{")),
    "cpp": (("class", r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|enum(?:\s+class)?)\s+(?P<n>\w+)[^;{}]*\{"), ("function", r"^[A-Za-z_][\w\s*&:<>,~]*?\b(?P<n>~?\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{")),
}
_IMPORTS = {
    "typescript": r"""^\s*(?:import|export)\b[^;'"\n]*?(?:from\s*)?(?P<n>['"][^'"]+['"])""",
    "swift": r"^\s*(?:@\w+\s+)?import\s+(?:\w+\s+)?(?P<n>\w+)",
    "kotlin": r"^\s*import\s+(?P<n>[\w.]+)",
    "rust": r"^\s*(?:pub\s+)?use\s+(?P<n>[\w:]+)",
    "go": r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?(?P<n>"[^"\s]+")\s*$""",
    "java": r"^\s*import\s+(?:static\s+)?(?P<n>[\w.]+)",
    "ruby": r"""^\s*require(?:_relative)?\s*\(?\s*(?P<n>['"][^'"]+['"])""",
    "c": r"""^\s*#\s*include\s+(?P<n>["<][^">]+[">])""",
    "cpp": r"""^\s*#\s*include\s+(?P<n>["<][^">]+[">])""",
}
_BASES = {
    "typescript": r"\bclass\s+(?P<n>\w+)(?:<[^>{]*>)?\s+extends\s+(?P<b>[\w.]+)",
    "swift": r"\b(?:class|struct|enum|actor|protocol)\s+(?P<n>\w+)(?:<[^>{]*>)?\s*:\s*(?P<b>[\w.,\s]+?)\s*(?:\{|where)",
    "kotlin": r"\b(?:class|object)\s+(?P<n>\w+)(?:<[^>{]*>)?(?:\s*\([^)]*\))?\s*:\s*(?P<b>[\w.,\s()]+?)\s*(?:\{|$)",
    "java": r"\bclass\s+(?P<n>\w+)(?:<[^>{]*>)?\s+extends\s+(?P<b>[\w.]+)",
    "ruby": r"^\s*class\s+(?P<n>\w+)\s*<\s*(?P<b>[\w:]+)",
    "cpp": r"\b(?:class|struct)\s+(?P<n>\w+)\s*(?:final\s*)?:\s*(?P<b>[\w:,\s<>]+?)\s*\{",
}
_PYTHON_NOISE = frozenset(NOISE["python"].split())
#: What has no nodes of interest below, and is none: values of fields that are no nodes, names, constants, contexts and operators.
_LEAVES = frozenset({str, int, float, complex, bytes, bool, type(None), type(...), ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias, *[k for base in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for k in base.__subclasses__()]})
_CALL = re.compile(r"(?<![\w.])(?:[\w\])]+\s*(?:\.|::|->)\s*)*(?P<n>[A-Za-z_]\w*[?!]?)\s*\(")
_C_LIKE = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_HASH = re.compile(r"#[^\n]*")


def bare(text: str, lang: str) -> str:
    """Without comments; their newlines stay, so that lines keep their numbers."""
    pattern = _HASH if lang == "ruby" else _C_LIKE
    return pattern.sub(lambda m: "\n" * m.group().count("\n"), text)


def parse_file(text: str | None, lang: str, deep: bool = True) -> list[tuple[str, str, str | None, int]]:
    """(what, name, extra, line): symbol with its kind, import, call, inherit with the base."""
    text = text or ""
    return _python(text, deep) if lang == "python" else _patterns(text, _ALIAS.get(lang, lang), deep)


def _inner(tree: ast.AST) -> list[ast.AST]:
    """The nodes of ``ast.walk`` in its order, but for those that have no others below."""
    out = [tree]
    for node in out:
        for field in node._fields:
            v = getattr(node, field, None)
            if type(v) is list:
                out += [x for x in v if type(x) not in _LEAVES]
            elif type(v) not in _LEAVES:
                out.append(v)
    return out


def _python(text: str, deep: bool) -> list[tuple[str, str, str | None, int]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[str, str, str | None, int]] = []
    seen: set[tuple[str, str]] = set()

    def once(what: str, name: str, line: int) -> None:
        if (what, name) not in seen:
            seen.add((what, name))
            out.append((what, name, None, line))

    noise = _PYTHON_NOISE
    for node in _inner(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("symbol", node.name, "function", node.lineno))
        elif isinstance(node, ast.ClassDef):
            out.append(("symbol", node.name, "class", node.lineno))
            if deep:
                out += [("inherit", node.name, b.id, node.lineno) for b in node.bases if isinstance(b, ast.Name)]
        elif deep and isinstance(node, ast.Import):
            for a in node.names:
                once("import", a.name, node.lineno)
        elif deep and isinstance(node, ast.ImportFrom):
            once("import", "." * node.level + (node.module or ""), node.lineno)
        elif deep and isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name and name not in noise:
                once("call", name, node.lineno)
    return out


def _patterns(text: str, lang: str, deep: bool) -> list[tuple[str, str, str | None, int]]:
    code = bare(text, lang)
    line = lambda at: code.count("\n", 0, at) + 1
    out: list[tuple[str, str, str | None, int]] = []
    defined: set[int] = set()
    for kind, pattern in _SYMBOLS.get(lang, ()):
        for m in re.finditer(pattern, code, re.M):
            if m["n"] not in _KEYWORDS and m.start("n") not in defined:
                defined.add(m.start("n"))
                out.append(("symbol", m["n"], kind, line(m.start("n"))))
    if not deep:
        return out
    names: set[str] = set()
    if lang in _IMPORTS:
        for m in re.finditer(_IMPORTS[lang], code, re.M):
            if m["n"] not in names:
                names.add(m["n"])
                out.append(("import", m["n"], None, line(m.start("n"))))
    skip = set(NOISE.get(lang, "").split()) | _KEYWORDS
    called: set[str] = set()
    for m in _CALL.finditer(code):
        if m["n"] not in skip and m["n"] not in called and m.start("n") not in defined:
            called.add(m["n"])
            out.append(("call", m["n"], None, line(m.start("n"))))
    if lang in _BASES:
        for m in re.finditer(_BASES[lang], code, re.M):
            for b in m["b"].split(","):
                base = re.sub(r"\(.*|<.*", "", b).replace("public", "").replace("private", "").replace("protected", "").replace("virtual", "").strip().split("::")[-1].split(".")[-1]
                if base:
                    out.append(("inherit", m["n"], base, line(m.start("n"))))
    return out


def parse(tree: DataFrame, deep: bool = True) -> DataFrame:
    """RECORD rows of (project, path, lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_file(text, lang, deep) for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)]
            file = pa.array(np.repeat(np.arange(b.num_rows), [len(r) for r in found]))
            what, name, extra, line = zip(*chain.from_iterable(found), strict=True) if len(file) else ((), (), (), ())
            own = [b.column(c).take(file) for c in ("project", "path", "lang")]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(x, pa.string()) for x in (what, name, extra)], pa.array(line, pa.int64())], _COLUMNS)

    return tree.select("project", "path", "lang", "text").mapInArrow(run, RECORD)


def stored(records: DataFrame, *what: str) -> DataFrame:
    """The records of these kinds, written once below the checkpoint folder: edges read them several times, and texts are parsed once."""
    where = scratch(records.sparkSession, "records")
    records.where(F.col("what").isin(*what)).write.option("compression", "zstd").parquet(where)
    return records.sparkSession.read.parquet(where)


def _distinct_ids(records: DataFrame) -> bool:
    """Whether ids of files and symbols tell projects, paths and names apart: none has a bar or is null. A pass over the records."""
    odd = F.lit(False)
    for c in ("project", "path", "name"):
        odd = odd | F.col(c).isNull() | F.contains(c, F.lit("|"))
    return records.where(odd).isEmpty()


def symbols(records: DataFrame) -> DataFrame:
    """Symbol nodes; of one name in a file the last line counts."""
    s = records.where(F.col("what") == "symbol").groupBy("name", "project", F.col("path").alias("file")).agg(F.max(F.struct("line", "extra")).alias("x"))
    return s.select(F.concat_ws("|", "project", "file", "name").alias("id"), "name", "project", "file", F.col("x.extra").alias("kind"), F.col("x.line").alias("line"))


def classify_import(name: Column, lang: Column) -> tuple[Column, Column]:
    """(internal, name) of an import as written: relative and own-crate paths are internal; others are packages by their registry's name."""
    plain = F.regexp_replace(name, r"""^['"<]|['">]$""", "")
    dotted = F.split(name, r"\.")[0]
    scoped = F.array_join(F.slice(F.split(plain, "/"), 1, 2), "/")
    ts = lang.isin("typescript", "tsx")
    inside = (
        F.when(lang == "python", F.startswith(name, F.lit("."))).when(ts, F.startswith(plain, F.lit(".")) | F.startswith(plain, F.lit("/"))).when(lang == "rust", F.rlike(name, F.lit("^(crate|self|super)(::|$)")))
        .when(lang == "ruby", F.startswith(plain, F.lit("./")) | F.startswith(plain, F.lit("../"))).when(lang.isin("c", "cpp"), F.startswith(name, F.lit('"'))).otherwise(F.lit(False))
    )
    outside = (
        F.when(lang == "python", dotted).when(ts, F.when(F.startswith(plain, F.lit("@")), scoped).otherwise(F.split(plain, "/")[0])).when(lang == "rust", F.split(name, "::")[0]).when(lang == "java", dotted).otherwise(plain)
    )
    return inside, F.when(inside, F.when(lang.isin("python", "rust"), name).otherwise(plain)).otherwise(outside)


def import_fragment(name: Column, lang: Column, faithful: bool = False) -> Column:
    """The piece of a path that an internal import names; empty if it names none.

    Dots in front go and others become slashes. Unless ``faithful``, crate paths are read as paths and the endings of quoted files kept.
    """
    old = F.replace(F.regexp_replace(name, r"^\.+", ""), F.lit("."), F.lit("/"))
    if faithful:
        return old
    rust = F.replace(F.regexp_replace(name, "^(crate|self|super)(::)?", ""), F.lit("::"), F.lit("/"))
    path = F.regexp_replace(F.regexp_replace(name, r"^(\.{0,2}/)+", ""), r"\.(ts|tsx|js|jsx|rb)$", "")
    return F.when(lang == "python", old).when(lang == "rust", rust).otherwise(path)


def import_edges(records: DataFrame, files: DataFrame, packages: DataFrame, faithful: bool = False) -> tuple[DataFrame, DataFrame]:
    """IMPORTS edges to files of the project whose path holds the fragment, and to known packages."""
    inside, name = classify_import(F.col("name"), F.col("lang"))
    i = records.where(F.col("what") == "import").select(F.concat_ws("|", "project", "path").alias("src"), "project", "lang", inside.alias("inside"), name.alias("target"))
    own = i.where("inside").select("src", "project", import_fragment(F.col("target"), F.col("lang"), faithful).alias("fragment"))
    both = contains_join(files.select(F.col("id").alias("dst"), "path", "project"), "path", own, "fragment", by=["project"]).where(F.col("src") != F.col("dst"))
    out = i.where(~F.col("inside")).join(packages.select(F.col("id").alias("dst"), F.col("name").alias("target")), "target")
    return both.select("src", "dst").distinct(), out.select("src", "dst").distinct()


def call_edges(records: DataFrame, nodes: DataFrame, again: bool = False) -> DataFrame:
    """CALLS edges to every symbol of the name in another file of the project.

    ``again``: the records are ``stored``. Then, if ids tell everything apart, calls are made distinct and not their edges.
    """
    c = records.where(F.col("what") == "call").select("project", "path", "name")
    once = again and _distinct_ids(records)
    c = c.distinct() if once else c
    s = nodes.select("project", F.col("name"), F.col("id").alias("dst"), "file")
    out = c.join(s, ["project", "name"]).where(F.col("path") != F.col("file")).select(F.concat_ws("|", "project", "path").alias("src"), "dst")
    return out if once else out.distinct()


def inherit_edges(records: DataFrame, nodes: DataFrame, again: bool = False) -> DataFrame:
    """INHERITS edges between symbols of the names in a project, child and parent not one symbol.

    They are as many as the classes of a name times those that name it as their base. ``again``: the records are ``stored``. Then, if ids
    tell everything apart, children are made distinct and not the edges, which go through no exchange.
    """
    r = records.where(F.col("what") == "inherit").select("project", "path", F.col("name").alias("child"), F.col("extra").alias("parent"))
    a = nodes.select("project", F.col("file").alias("path"), F.col("name").alias("child"), F.col("id").alias("src"))
    b = nodes.select("project", F.col("name").alias("parent"), F.col("id").alias("dst"))
    if again and _distinct_ids(records):
        left = r.distinct().join(a, ["project", "path", "child"]).select("project", "parent", "src")
        return left.join(b, ["project", "parent"]).where(F.col("src") != F.col("dst")).select("src", "dst")
    return r.join(a, ["project", "path", "child"]).join(b, ["project", "parent"]).where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
