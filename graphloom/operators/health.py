"""Code-health and architecture rules, improvement plans, test gaps and stage analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import is_test_path_strict
from ..functions.text import nesting_depth
from .callgraph import reciprocal
from .scale import any_text_contains, positions
from .summaries import duplicate_lengths, module_symbol_counts


def _issue(df: DataFrame, path: Column, symbol: Column, kind: str, severity: str, value: Column) -> DataFrame:
    return df.select(path.alias("file_path"), symbol.alias("symbol"), F.lit(kind).alias("issue_type"),
                     F.lit(severity).alias("severity"), value.cast("string").alias("detail"))


def last_definition(symbols: DataFrame) -> DataFrame:
    """File of the latest symbol per name."""
    return symbols.groupBy("name").agg(F.max_by("file", "symbol_id").alias("def_file"))


def file_graph(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct file pairs connected by calls between defined names."""
    d = last_definition(symbols)
    a = d.withColumnsRenamed({"name": "caller_symbol", "def_file": "from_file"})
    b = d.withColumnsRenamed({"name": "callee_symbol", "def_file": "to_file"})
    return calls.select("caller_symbol", "callee_symbol").distinct().join(a, "caller_symbol").join(b, "callee_symbol").select("from_file", "to_file").distinct()


def code_health(symbols: DataFrame, calls: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """Seven rules over symbols, calls, modules and file contents."""
    none = F.lit(None).cast("string")
    called = calls.select(F.col("callee_symbol").alias("name")).distinct()
    functions = symbols.filter("type = 'function'")
    span = F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)) + 1
    large = functions.filter(span > 120)
    uncalled = symbols.join(called, "name", "left_anti")
    dead = uncalled.filter((F.col("type") == "function") & ~F.col("name").startswith("test"))
    unused = uncalled.filter("type = 'import'")
    path = modules.groupBy("module").agg(F.min("module_path").alias("module_path"))
    big = module_symbol_counts(symbols, modules).filter("symbols > 80").join(path, "module")
    twins = duplicate_lengths(symbols)
    loops = reciprocal(file_graph(calls, symbols), "from_file", "to_file")
    deep = files.select("path", nesting_depth(F.col("content")).alias("depth")).filter("depth >= 6")
    parts = [_issue(large, F.col("file"), F.col("name"), "LargeFunction", "High", span),
             _issue(dead, F.col("file"), F.col("name"), "DeadCode", "Medium", F.lit("")),
             _issue(unused, F.col("file"), F.col("name"), "UnusedImport", "Low", F.lit("")),
             _issue(big, F.col("module_path"), none, "LargeModule", "High", F.col("symbols")),
             _issue(twins, F.col("file"), F.col("name"), "DuplicateLogic", "Medium", F.col("length")),
             _issue(loops, F.col("a"), none, "CircularDependency", "High", F.col("b")),
             _issue(deep, F.col("path"), none, "DeepNesting", "Medium", F.col("depth"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def architecture_issues(module_edges: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Five rules over the module graph: coupling, layering, cycles, size, missing interfaces."""
    out = module_edges.groupBy("from_module").agg(
        F.count_distinct("to_module").alias("n"), F.max(F.col("to_module").contains("api")).alias("to_api"))
    counts = module_symbol_counts(symbols, modules)
    loops = reciprocal(module_edges, "from_module", "to_module")
    row = lambda df, m, kind, d: df.select(F.col(m).alias("module"), F.lit(kind).alias("issue_type"), d.cast("string").alias("detail"))
    return (row(out.filter("n > 4"), "from_module", "TightCoupling", F.col("n"))
            .unionByName(row(out.filter(F.col("from_module").contains("domain") & F.col("to_api")), "from_module", "LayerViolation", F.lit("")))
            .unionByName(row(loops, "a", "CyclicModuleDependency", F.col("b")))
            .unionByName(row(counts.filter("symbols > 100"), "module", "GodModule", F.col("symbols")))
            .unionByName(row(counts.filter("entry_style > 30"), "module", "MissingInterface", F.col("entry_style"))))


# Plan type and benefit of each issue type.
PLAN_TYPES = {
    "DeadCode": ("RemoveDeadCode", "Reduce maintenance surface and build size"),
    "DuplicateLogic": ("DeduplicateCode", "Lower bug duplication and simplify updates"),
    "LargeFunction": ("SimplifyLogic", "Improve readability and reduce defect risk"),
    "DeepNesting": ("SimplifyLogic", "Improve readability and reduce defect risk"),
    "LargeModule": ("SplitModule", "Improve modularity and testability"),
    "CircularDependency": ("ExtractInterface", "Reduce coupling and improve layering"),
    "UnusedImport": ("ExtractInterface", "Reduce coupling and improve layering"),
    "LayerViolation": ("ExtractInterface", "Restore architectural boundaries"),
    "TightCoupling": ("ExtractInterface", "Reduce coupling and improve evolution speed"),
    "MissingInterface": ("ExtractInterface", "Improve abstraction and replaceability"),
    "CyclicModuleDependency": ("SplitModule", "Break cycles and simplify dependency flow"),
    "GodModule": ("SplitModule", "Reduce module size and ownership contention"),
}


def improvement_plans(code: DataFrame, architecture: DataFrame) -> DataFrame:
    """One plan per issue: (plan_id, improvement_type, target, expected_benefit)."""
    table = F.create_map(*[x for k, (t, b) in PLAN_TYPES.items() for x in (F.lit(k), F.struct(F.lit(t).alias("t"), F.lit(b).alias("b")))])
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    issue_id = F.concat_ws(":", "file_path", F.coalesce("symbol", F.lit("module")), "issue_type")
    a = code.select(F.concat(F.lit("imp_code_"), clean(issue_id)).alias("plan_id"), "issue_type", F.col("symbol").alias("target"))
    b = architecture.select(F.concat(F.lit("imp_arch_"), clean(F.col("module"))).alias("plan_id"), "issue_type", F.col("module").alias("target"))
    rows = a.unionByName(b)
    return rows.select("plan_id", table[F.col("issue_type")]["t"].alias("improvement_type"), "target",
                       table[F.col("issue_type")]["b"].alias("expected_benefit"))


def evolution_graph(plans: DataFrame, order: Sequence[str]) -> DataFrame:
    """Chain the plans in order: node ``ev_i`` depends on ``ev_{i-1}``. Equal plans follow each other in any order."""
    placed = positions(plans, order)
    return placed.select(
        F.concat(F.lit("ev_"), F.col("position").cast("string")).alias("node_id"),
        F.when(F.col("position") > 0, F.concat(F.lit("ev_"), (F.col("position") - 1).cast("string"))).alias("depends_on"),
        "position", *plans.columns)


def evolution_preview(graph: DataFrame, n: int = 20) -> DataFrame:
    """First nodes of the chain for a preview."""
    return graph.orderBy("position").limit(n)


def test_gaps(symbols: DataFrame) -> DataFrame:
    """Missing tests per symbol: none at all, or no edge-case or error tests by name.

    One test symbol with "test" in its name counts as a test of everything, as a plain substring
    check would have it.
    """
    low = symbols.select("symbol_id", "name", "file", F.lower("name").alias("_l"))
    tests = low.filter(is_test_path_strict(F.col("file"))).select(F.col("_l").alias("_t"))
    blanket = tests.agg(F.coalesce(F.max(F.col("_t").contains("test")), F.lit(False)).alias("_all")).withColumn("_k", F.lit(1))
    covered = any_text_contains(low, "_l", tests, "_t").withColumn("_c", F.lit(True))
    rows = low.join(covered, "_l", "left").withColumn("_k", F.lit(1)).join(F.broadcast(blanket), "_k")
    has = F.col("_all") | F.coalesce("_c", F.lit(False))
    gaps = F.when(~has, F.array(F.lit("NoTests"))).otherwise(F.array_compact(F.array(
        F.when(~F.col("_l").rlike("edge|boundary"), F.lit("MissingEdgeCases")), F.when(~F.col("_l").rlike("error|fail"), F.lit("MissingErrorTests")))))
    return rows.select("symbol_id", "name", "file", F.explode(gaps).alias("gap_type"))


# Stages of a delivery run in order.
STAGES = ("checkout", "build", "unit_tests", "integration_tests", "deploy")


def stage_analysis(failures: DataFrame) -> DataFrame:
    """Findings per failure and stage: slow stages, redundant builds, tests skipped by time-outs."""
    rows = failures.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in STAGES])))
    found = F.array_compact(F.array(
        F.when(F.col("stage").contains("integration"), F.lit("slow_stage")),
        F.when(F.col("stage").contains("build") & F.col("failure_stage").contains("test"), F.lit("redundant_build")),
        F.when(F.col("stage").contains("test") & F.lower("failure_message").contains("timeout"), F.lit("unused_test"))))
    return rows.select("failure_id", "stage", F.explode(found).alias("finding"))
