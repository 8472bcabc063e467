"""Module, file and repository summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.classify import (file_objective, file_objective_rich, importance, is_entry_path, is_test_path,
                                  risk_signals)
from .callgraph import best_anywhere
from .scale import top_n


def sample_list(rank: Column, value: Column, n: int, sep: str = ",") -> Column:
    """Join the ``n`` first values by rank; only those are collected."""
    kept = F.array_sort(F.collect_list(F.when(rank <= n, F.struct(rank.alias("r"), value.alias("v")))))
    return F.array_join(F.transform(kept, lambda s: s["v"]), sep)


def module_symbol_counts(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Symbols, entry-style symbols and functions per module."""
    entry = F.col("name").startswith("get") | F.col("name").startswith("set") | F.col("name").startswith("handle")
    return (symbols.join(modules.select("file", "module"), "file").groupBy("module").agg(
        F.count("*").alias("symbols"), F.count_if(entry).alias("entry_style"),
        F.count_if(F.col("type") == "function").alias("functions")))


def fan_out(module_edges: DataFrame) -> DataFrame:
    return module_edges.groupBy(F.col("from_module").alias("module")).agg(
        F.count_distinct("to_module").alias("targets"), F.count("*").alias("edges"))


def duplicate_lengths(symbols: DataFrame, min_length: int = 20, min_group: int = 2) -> DataFrame:
    """Functions whose length is shared by more than ``min_group`` functions.

    Group sizes are counted first and joined back, so a frequent length never sits in one task.
    """
    functions = symbols.filter(F.col("type") == "function").select(
        "symbol_id", "name", "file", (F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)) + 1).alias("length"))
    functions = functions.filter(F.col("length") > min_length)
    sizes = functions.groupBy("length").agg(F.count("*").alias("group_size")).filter(F.col("group_size") > min_group)
    return functions.join(sizes, "length")


def shared_libraries(repo_edges: DataFrame) -> DataFrame:
    """Repositories used by at least two others; each is a potential version mismatch."""
    return (repo_edges.groupBy(F.col("to_repo").alias("library"))
            .agg(F.count_distinct("from_repo").alias("dependents")).filter("dependents >= 2")
            .withColumn("label", F.lit("potential version mismatch")))


def hot_callees(calls: DataFrame, n: int = 5) -> DataFrame:
    return (calls.groupBy("callee_symbol").agg(F.count("*").alias("calls"))
            .orderBy(F.desc("calls"), "callee_symbol").limit(n))


def path_hints(files: DataFrame, path: str, n: int = 8) -> DataFrame:
    """Parent directories with the most files."""
    directory = F.regexp_replace(path, "/[^/]*$", "")
    return (files.groupBy(directory.alias("dir")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "dir").limit(n))


def source_support(files: DataFrame, path: str, extensions: Sequence[str], sample: int = 8) -> DataFrame:
    """Counts of parseable and other sources with the first paths of each."""
    tagged = files.select(F.col(path).alias("path"), F.col(path).rlike(rf"\.({'|'.join(extensions)})$").alias("supported"))
    counts = tagged.groupBy("supported").agg(F.count("*").alias("files"))
    first = top_n(tagged, ["supported"], [F.col("path")], sample, "_r").groupBy("supported").agg(
        sample_list(F.col("_r"), F.col("path"), sample).alias("sample"))
    return counts.join(first, "supported")


def collapse_beyond(modules: DataFrame, keep: int, names: int) -> DataFrame:
    """Keep the ``keep`` most important modules and fold the rest into one row.

    The kept rows come from a distributed top-k; the fold is an ordinary aggregate.
    """
    order = [F.desc("importance"), F.col("module")]
    head = modules.orderBy(*order).limit(keep + names)
    ranked = head.withColumn("k", F.row_number().over(W.orderBy(*order)))
    shown = ranked.select("module", "k")
    tagged = modules.join(shown, "module", "left").withColumn(
        "label", F.when(F.col("k") <= keep, F.col("module")).otherwise("other"))
    name_list = F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("k").isNotNull(), F.struct("k", F.col("module").alias("v"))))), lambda s: s["v"]), ",")
    return tagged.groupBy(F.col("label").alias("module")).agg(
        F.sum("files").alias("files"), F.max("importance").alias("importance"),
        F.count("*").alias("members"), name_list.alias("names"))


def recurring(counts: DataFrame, key: str, min_hits: int, top: int = 20) -> DataFrame:
    """Patterns seen at least ``min_hits`` times among the ``top`` most frequent."""
    return counts.orderBy(F.desc("hits"), key).limit(top).filter(F.col("hits") >= min_hits)


# ---- footprints, briefs and maps -----------------------------------------------------------

def top_symbols(symbols: DataFrame, n: int, order: Sequence[str] = ("start_line", "name", "symbol_id")) -> DataFrame:
    """First ``n`` symbol names of every file as an array (bounded by ``n``)."""
    first = top_n(symbols.select("file", *order), ["file"], [F.col(c) for c in order], n, "_r")
    return first.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda s: s["name"]).alias("names"))


def footprint(modules: DataFrame, symbols: DataFrame, n: int | None = None) -> DataFrame:
    """File, module, objective and up to eight symbols; ``n`` keeps the first files by path."""
    files = modules.select("file", "module")
    if n is not None:
        files = files.orderBy("file").limit(n)
    out = files.join(top_symbols(symbols, 8), "file", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return out.withColumn("objective", file_objective(F.col("file"), F.col("names")))


def repo_map(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """Module, file and symbol rows of the whole repository; the hierarchy is in the keys."""
    return modules.select("module", "file").join(symbols.select("file", "name", "type", "start_line", "end_line"), "file", "left")


def file_briefs(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Per file: objective, first six symbols and first eight called names."""
    deps = calls.select("file", "callee_symbol").distinct()
    first = top_n(deps, ["file"], [F.col("callee_symbol")], 8, "_r").groupBy("file").agg(
        sample_list(F.col("_r"), F.col("callee_symbol"), 8).alias("key_dependencies"))
    names = top_symbols(symbols, 6)
    return names.join(first, "file", "left").select(
        "file", file_objective(F.col("file"), F.col("names")).alias("objective"),
        F.array_join("names", ",").alias("top_symbols"), F.coalesce("key_dependencies", F.lit("")).alias("key_dependencies"))


def directory_briefs(symbols: DataFrame, per_dir: int = 20) -> DataFrame:
    """First files of each directory with their first four symbols."""
    names = top_symbols(symbols, 4)
    rows = names.select(F.regexp_replace("file", "/[^/]*$", "").alias("dir"), "file", F.array_join("names", ",").alias("top_symbols"))
    return top_n(rows, ["dir"], [F.col("file")], per_dir)


def symbol_briefs(symbols: DataFrame, calls: DataFrame, n: int = 6) -> DataFrame:
    """Preferred symbol per name with the first names it calls."""
    best = best_anywhere(symbols).select(F.col("any_id").alias("symbol_id"))
    s = symbols.join(best, "symbol_id", "left_semi").select("symbol_id", "name", "file", "start_line", "end_line")
    deps = calls.select(F.col("caller_symbol").alias("name"), "file", "callee_symbol").distinct()
    first = top_n(deps, ["name", "file"], [F.col("callee_symbol")], n, "_r").groupBy("name", "file").agg(
        sample_list(F.col("_r"), F.col("callee_symbol"), n).alias("touches"))
    return s.join(first, ["name", "file"], "left").withColumn("touches", F.coalesce("touches", F.lit("")))


def module_priority(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("test|spec"), 2).when(low.rlike("api|server|app"), 0).otherwise(1)


def project_files(modules: DataFrame, symbols: DataFrame, calls: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """Files of a project summary: priority, objective, purpose, top symbols and entry point flag.

    With a token budget only the first ``max((budget - 120) / 15, 5)`` files in module priority
    order remain, cut by a distributed top-k.
    """
    counts = calls.groupBy(F.col("callee_symbol").alias("name")).agg(F.count("*").alias("calls"))
    called = symbols.join(counts, "name", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    roots = called.filter((F.col("type") != "import") & (F.col("calls") == 0)).select("file").distinct().withColumn("is_root", F.lit(True))
    ranked = top_n(called.select("file", "name", "calls", "symbol_id"), ["file"], [F.desc("calls"), F.col("name"), F.col("symbol_id")], 6, "_r")
    names = ranked.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda s: s["name"]).alias("names"))
    files = modules.select("module", "file", module_priority(F.col("module")).alias("priority"))
    if max_tokens is not None:
        files = files.orderBy("priority", "module", "file").limit(max((max_tokens - 120) // 15, 5))
    out = files.join(names, "file", "left").join(roots, "file", "left")
    out = out.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    objective = file_objective_rich(F.col("file"), F.col("names"))
    stem = F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)
    primary = F.coalesce(F.get("names", F.lit(0)), stem)
    rest = F.slice(F.filter("names", lambda x: x != primary), 1, 3)
    tail = F.when(F.size(rest) > 0, F.concat(F.lit("; also "), F.array_join(rest, ", "))).otherwise("")
    lead = (F.when(F.col("objective") == "api_surface", "API surface, entry: ").when(F.col("objective") == "data_layer", "data layer, primary: ")
            .when(F.col("objective") == "ui_layer", "UI layer, primary: ").otherwise("application logic, primary: "))
    purpose = F.when(F.col("objective") == "tests", F.concat(F.lit("test suite for "), stem)).otherwise(F.concat(lead, primary, tail))
    out = out.withColumn("objective", objective).withColumn("purpose", purpose)
    return out.select("module", "file", "priority", "objective", "purpose", F.array_join("names", ",").alias("top_symbols"),
                      (is_entry_path(F.col("file")) | F.coalesce("is_root", F.lit(False))).alias("is_entry_point"))


def filter_summary(files: DataFrame, relevant: DataFrame) -> DataFrame:
    """Keep modules with at least one relevant file; without any match keep everything."""
    hit = files.join(relevant.select("file").distinct(), "file", "left_semi").select("module").distinct()
    none = hit.agg((F.count("*") == 0).alias("_none")).withColumn("_k", F.lit(1))
    marked = files.join(hit.withColumn("_hit", F.lit(True)), "module", "left").withColumn("_k", F.lit(1)).join(F.broadcast(none), "_k")
    return marked.filter(F.coalesce("_hit", F.lit(False)) | F.col("_none")).drop("_hit", "_none", "_k")


# What the support level of a module adds to its priority; without one it counts as a guess from the file system.
SUPPORT = {"indexed": 30, "unsupported_source": 20, "unsupported_source_group": 10, "filesystem_heuristic": 0}


def architecture_map(modules: DataFrame, symbols: DataFrame, calls: DataFrame, module_edges: DataFrame, recent: DataFrame,
                     support: DataFrame) -> DataFrame:
    """Module signals, importance and priority score; ``support`` is (module, support_level).

    Signals: risk words, recent change, fan-out of two or more, entry points, and no tests among
    two or more files.
    """
    called = calls.select(F.col("callee_symbol").alias("name")).distinct()
    entries = (symbols.filter("type <> 'import'").join(called, "name", "left_anti").join(modules.select("file", "module"), "file")
               .select("module", "name").distinct())
    points = top_n(entries, ["module"], [F.col("name")], 4, "_r").groupBy("module").agg(sample_list(F.col("_r"), F.col("name"), 4).alias("entry_points"))
    base = modules.groupBy("module").agg(F.min("module_path").alias("path"), F.count("*").alias("files"),
                                         F.max(is_test_path(F.col("file"))).alias("tested"))
    fan = module_edges.groupBy(F.col("from_module").alias("module")).agg(F.count("*").alias("fan_out"))
    out = (base.join(fan, "module", "left").join(points, "module", "left")
           .join(recent.select("module").distinct().withColumn("active", F.lit(True)), "module", "left")
           .join(support.select("module", "support_level"), "module", "left"))
    level = F.coalesce("support_level", F.lit("filesystem_heuristic"))
    worth = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SUPPORT.items() for x in pair]), level), F.lit(0))
    out = out.withColumns({"fan_out": F.coalesce("fan_out", F.lit(0).cast("bigint")), "entry_points": F.coalesce("entry_points", F.lit(""))})
    more = F.array_compact(F.array(
        F.when(F.col("active"), F.lit("high_activity")), F.when(F.col("fan_out") >= 2, F.lit("high_fanout")),
        F.when(F.col("entry_points") != "", F.lit("entry_points")), F.when((F.col("files") >= 2) & ~F.col("tested"), F.lit("weak_test_coverage"))))
    out = out.withColumn("signals", F.concat(risk_signals(F.concat_ws("/", "module", "path")), more))
    out = out.withColumn("importance", importance(F.col("signals")))
    rank = F.when(F.col("importance") == "high", 3).when(F.col("importance") == "medium", 2).otherwise(1)
    return out.select("module", "path", "files", "fan_out", "entry_points", F.array_join("signals", ",").alias("signals"),
                      "importance", level.alias("support_level"), (rank * 100 + worth + F.size("signals")).cast("bigint").alias("score"))
