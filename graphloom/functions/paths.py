"""Column expressions over file paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Language of each file extension.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust"}
# Directories and suffixes that are never indexed.
HEAVY_DIRS = (".venv", "venv", "env", "__pycache__", "site-packages", "node_modules", "target", "dist", "build", ".cache",
              ".git", ".idea", ".vscode", "coverage", "tmp")
SKIP_SUFFIXES = (".log", ".lock", ".min.js", ".d.ts", ".png", ".pdf", ".exe")
DOC_SUFFIXES = (".md", ".txt", ".rst", ".adoc")
# Endings tried for an import without extension, in order.
ENDINGS = {"script": (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", ""),
           "python": (".py", "/__init__.py", ""), "rust": (".rs", "/mod.rs", "")}


def _any(*texts: str) -> str:
    return "|".join(t.replace(".", r"\.") for t in texts)


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))]


def content_kind(path: Column, query: Column | None = None) -> Column:
    """Document or code by suffix; without a path by words of the query."""
    by_path = F.when(F.lower(path).rlike(rf"({_any(*DOC_SUFFIXES)})$"), "document").otherwise("code")
    if query is None:
        return by_path
    by_query = F.when(F.lower(query).rlike("readme|docs|document|markdown|section"), "document").otherwise("code")
    return F.when(path.isNotNull() & (path != ""), by_path).otherwise(by_query)


def is_excluded(path: Column) -> Column:
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    return low.rlike(rf"(^|/)({_any(*HEAVY_DIRS)})/") | low.rlike(rf"({_any(*SKIP_SUFFIXES)})$")


def module_of(path: Column) -> Column:
    """Struct (name, path): the directory below src or lib, else the first segment, else root."""
    parts = F.split(path, "/")
    n, first = F.size(parts), parts[0]
    inner = (n >= 3) & first.isin("src", "lib")
    name = F.when(inner, F.get(parts, 1)).when(n >= 2, first).otherwise("root")
    full = F.when(inner, F.concat_ws("/", first, F.get(parts, 1))).when(n >= 2, first).otherwise("root")
    return F.struct(name.alias("name"), full.alias("path"))


def module_key(path: Column) -> Column:
    """Two segments below well-known roots, else the first segment."""
    parts = F.split(path, "/")
    deep = (F.size(parts) >= 3) & parts[0].isin("src", "lib", "app", "packages", "apps", "services")
    return F.when(deep, F.concat_ws("/", parts[0], F.get(parts, 1))).otherwise(parts[0])


def workspace_boundary(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when((parts[0] == "packages") & (F.size(parts) >= 2), F.concat_ws("/", parts[0], F.get(parts, 1)))


def normalise_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    def step(acc: Column, part: Column) -> Column:
        return (F.when(part.isin("", "."), acc)
                .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
                .otherwise(F.array_append(acc, part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_base(importer: Column, specifier: Column) -> Column:
    """Path that an import names, as yet without an ending; null when it is not relative."""
    folder = F.regexp_replace(importer, "[^/]*$", "")
    dotted = (language(importer) == "python") & specifier.rlike(r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*$")
    return normalise_path(F.when(F.startswith(specifier, F.lit(".")), F.concat(folder, specifier))
                          .when(dotted, F.concat(folder, F.replace(specifier, F.lit("."), F.lit("/")))))


def import_kind(importer: Column) -> Column:
    """Which endings an import of this file may leave out."""
    lang = language(importer)
    return F.when(lang.isin("python", "rust"), lang).otherwise("script")


def with_endings(base: Column, kind: Column) -> Column:
    """Paths that ``import_base`` may stand for, in the order they are tried."""
    known = (F.when(kind == "python", base.rlike(r"\.py$")).when(kind == "rust", base.rlike(r"\.rs$"))
             .otherwise(base.rlike(r"\.(ts|tsx|js|jsx)$")))
    endings = {name: F.array(*[F.concat(base, F.lit(e)) for e in ends]) for name, ends in ENDINGS.items()}
    every = F.when(kind == "python", endings["python"]).when(kind == "rust", endings["rust"]).otherwise(endings["script"])
    return F.when(base != "", F.when(known, F.array(base)).otherwise(every))


def import_candidates(importer: Column, specifier: Column) -> Column:
    """Paths an import may mean, in the order they are tried; none when it is not relative."""
    # A variable of its own: the path is normalised once, not once for every ending.
    return F.get(F.transform(F.array(import_base(importer, specifier)), lambda base: with_endings(base, import_kind(importer))), F.lit(0))
