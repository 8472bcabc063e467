"""Line and statement extraction from file contents, without leaving the JVM.

All functions keep whole texts: a file is split into lines inside its row, and only matching lines
become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scale import top_n

# Line prefixes that open a symbol, and the symbol's kind, in the order they are tried.
LINE_PREFIXES = (("export function ", "function"), ("function ", "function"), ("export class ", "class"), ("class ", "class"),
                 ("export const ", "const"), ("const ", "const"), ("fn ", "function"), ("pub fn ", "function"),
                 ("def ", "function"), ("struct ", "struct"), ("enum ", "enum"), ("trait ", "trait"))


def strip(text: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lstrip(text: Column | str) -> Column:
    return F.regexp_replace(text, r"^\s+", "")


def lines_of(content: Column) -> Column:
    """Lines of a text without line ends; a final line end opens no line."""
    parts = F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))
    return F.when(F.endswith(content, F.lit("\n")) | (content == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def code_span(content: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (counted from one)."""
    return F.array_join(F.slice(F.split(content, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def line_symbols(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Symbols opened by a line prefix: (path, name, type, line); ``limit`` keeps the first per file."""
    prefixes = "|".join(p for p, _ in LINE_PREFIXES)
    hits = F.filter(F.transform(lines_of(F.col("content")), lambda x, i: F.struct((i + 1).alias("line"), strip(x).alias("text"))),
                    lambda s: s["text"].rlike(f"^({prefixes})"))
    rows = files.select("path", F.explode(hits).alias("h")).select("path", "h.line", "h.text")
    kind, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
    for prefix, label in reversed(LINE_PREFIXES):
        hit = F.startswith(F.col("text"), F.lit(prefix))
        kind = F.when(hit, label).otherwise(kind)
        rest = F.when(hit, F.substring("text", len(prefix) + 1, 2**30)).otherwise(rest)
    rows = rows.select("path", F.regexp_extract(rest, r"([\p{L}\p{N}_$]+)", 1).alias("name"), kind.alias("type"), "line")
    rows = rows.filter("name <> ''")
    return top_n(rows, ["path"], [F.col("line")], limit) if limit else rows


def dependency_hints(files: DataFrame, limit: int = 8) -> DataFrame:
    """First import-like lines per file with their remainder."""
    def rest(x: Column) -> Column:
        return (F.when(F.startswith(x, F.lit("import ")), strip(F.substring(x, 8, 2**30)))
                .when(F.startswith(x, F.lit("from ")), strip(F.substring(x, 6, 2**30)))
                .when(F.startswith(x, F.lit("use ")), F.regexp_replace(strip(F.substring(x, 5, 2**30)), ";+$", "")))
    found = F.filter(F.transform(lines_of(F.col("content")), lambda x: rest(strip(x))), lambda v: v.isNotNull())
    return files.select("path", F.posexplode(F.slice(found, 1, limit)).alias("position", "hint"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """Sections opened by heading lines with objective, references and line range.

    Sections are built inside the row, so the lines of a file are not repeated per section.
    """
    prepared = files.select("path", lines_of(F.col("content")).alias("ls"))
    heads = F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(r"^\s*#"), i + 1)), lambda v: v.isNotNull())
    prepared = prepared.withColumn("heads", heads)

    def section(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("heads", k + 1) - 1, F.greatest(F.size("ls"), start))
        body = F.slice("ls", start + 1, F.greatest(end - start, F.lit(0)))
        prose = F.get(F.filter(body, lambda x: x.rlike(r"^\s*[^\s*-]")), F.lit(0))
        refs = F.slice(F.filter(body, lambda x: x.rlike(r"\S")), 1, 4)
        return F.struct(
            strip(F.regexp_replace(F.get("ls", start - 1), "^#+", "")).alias("heading"),
            F.coalesce(strip(prose), F.lit("Section reference.")).alias("objective"),
            F.transform(refs, lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), "^-+", ""), r"^\*+", ""))).alias("key_references"),
            start.alias("start_line"), end.alias("end_line"))

    return prepared.select("path", F.explode(F.transform("heads", section)).alias("s")).select("path", "s.*").filter("heading <> ''")


def api_contracts(files: DataFrame) -> DataFrame:
    """Endpoints of interface files: (path, service, version, method, endpoint)."""
    low = F.lower("path")
    picked = files.filter(low.rlike(r"\.(yaml|yml|graphql|proto)$") | low.contains("openapi")).select(
        "path", lines_of(F.col("content")).alias("ls"))
    parts = F.split("path", "/")
    service = F.when(F.size(parts) > 1, parts[0]).otherwise("unknown_service")
    version = F.filter(F.transform(F.filter("ls", lambda x: F.lower(x).contains("version")),
                                   lambda x: strip(F.coalesce(F.get(F.split(x, ":"), F.lit(1)), F.lit("v1")))), lambda v: v != "")
    proto, graphql = F.endswith(low, F.lit(".proto")), F.endswith(low, F.lit(".graphql"))
    rpc = F.transform(F.filter("ls", lambda x: F.startswith(lstrip(x), F.lit("rpc "))),
                      lambda x: F.struct(F.lit("RPC").alias("method"), F.coalesce(F.get(F.filter(F.split(strip(x), r"\s+"), lambda w: w != ""), F.lit(1)), F.lit("Unknown")).alias("endpoint")))
    types = F.transform(F.filter("ls", lambda x: lstrip(x).rlike("^type (Query|Mutation)")),
                        lambda x: F.struct(F.lit("GRAPHQL").alias("method"), strip(x).alias("endpoint")))
    http = F.transform(F.filter("ls", lambda x: F.startswith(strip(x), F.lit("/api/"))),
                       lambda x: F.struct(F.lit("HTTP").alias("method"), F.regexp_replace(strip(x), ":+$", "").alias("endpoint")))
    found = F.when(proto, rpc).when(graphql, types).otherwise(http)
    return picked.select("path", service.alias("service"), F.coalesce(F.get(version, F.lit(0)), F.lit("v1")).alias("version"),
                         F.explode(found).alias("e")).select("path", "service", "version", "e.method", "e.endpoint")


def _binding(part: Column, sep: str) -> Column:
    """(source, local) of one name in a binding list; without an alias both are the same."""
    halves = F.split(part, sep, 2)
    source = strip(halves[0])
    return F.struct(source.alias("source_symbol"), strip(F.coalesce(F.get(halves, F.lit(1)), halves[0])).alias("local_name"))


def _names(inner: Column, sep: str = " as ") -> Column:
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: strip(F.regexp_replace(strip(p), "^(type )+", ""))), lambda p: p != "")
    return F.filter(F.transform(parts, lambda p: _binding(p, sep)), lambda b: b["local_name"] != "")


def import_bindings(statements: DataFrame) -> DataFrame:
    """Names bound by import and require statements: (file, specifier, local_name, source_symbol).

    Handles Python ``from``/``import``, script imports (named, default, namespace) and ``require``
    with and without destructuring. A namespace binding has no source symbol.
    """
    s = strip(F.regexp_replace("statement", "\n", " "))
    rows = statements.select("file", s.alias("s"))
    empty = F.array().cast("array<struct<source_symbol:string,local_name:string>>")

    def one(source: Column, local: Column) -> Column:
        return F.when(local != "", F.array(F.struct(source.alias("source_symbol"), local.alias("local_name")))).otherwise(empty)

    quoted = F.regexp_extract("s", r"""['"]([^'"]+)['"]""", 1)
    py_from = F.col("s").rlike("^from .+ import ")
    py_spec = strip(F.regexp_extract("s", "^from (.+?) import ", 1))
    py_inner = F.regexp_replace(strip(F.regexp_extract("s", "^from .+? import (.*)$", 1)), r"^\(+|\)+$", "")
    js = F.col("s").rlike("^import .+ from ")
    clause = strip(F.regexp_extract("s", "^import (.+?) from ", 1))
    head = strip(F.regexp_replace(strip(F.regexp_extract(clause, r"^([^{]*)\{", 1)), ",$", ""))
    named = F.concat(one(F.lit("default"), F.when(head == "type", "").otherwise(head)), _names(F.regexp_extract(clause, r"\{(.*)\}", 1)))
    star = one(F.lit(None).cast("string"), strip(F.regexp_extract(clause, r"^\* as (.*)$", 1)))
    default = one(F.lit("default"), strip(F.regexp_replace(clause, "^(type )+", "")))
    plain = F.col("s").rlike("^import ") & ~F.col("s").rlike("""["'{*]| from """)
    modules = F.transform(_names(F.regexp_extract("s", "^import (.*)$", 1)),
                          lambda b: F.struct(F.lit(None).cast("string").alias("source_symbol"), b["local_name"].alias("local_name")))
    req = F.col("s").rlike(r"^(const|let|var) .*= require\(")
    bound = strip(F.regexp_extract("s", r"^(?:const|let|var) (.*?)= require\(", 1))
    destructured = _names(F.regexp_extract(bound, r"^\{(.*)\}$", 1), ":| as ")
    required = F.when(bound.rlike(r"^\{.*\}$"), destructured).when(bound.rlike(r"^\["), empty).otherwise(one(F.lit("default"), bound))
    bindings = (F.when(py_from, _names(py_inner)).when(js, F.when(clause.contains("{"), named).when(F.startswith(clause, F.lit("* as ")), star).otherwise(default))
                .when(plain, modules).when(req, required))
    spec = (F.when(py_from, py_spec).when(js | req, quoted)
            .when(plain, F.regexp_extract("s", r"^import ([^\s]+)", 1)))
    return rows.select("file", spec.alias("specifier"), F.explode(bindings).alias("b")).filter("specifier <> ''").select(
        "file", "specifier", "b.local_name", "b.source_symbol")
