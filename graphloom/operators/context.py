"""Context assembly: planned, reasoning and hybrid context, edit plans and verification."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import module_of, workspace_boundary
from ..session import cut_lineage
from . import callgraph as cg
from .flow import control_flow, data_flow, logic_clusters
from .graph import k_hop
from .intervals import best_per_span, item_cost, merge_ranges, not_covered, prune_contained, within_budget
from .scale import first_per_key

SPAN = ["file", "start_line", "end_line"]
# Fixed value: tokens kept free for the prompt.
RESERVED = 1000
# Files that hold a name: one that more of them hold is looked for file by file.
COMMON = 64


def context_candidates(requests: DataFrame, symbols: DataFrame, calls: DataFrame, nodes: DataFrame, radius: int = 3,
                       callers: bool = False) -> DataFrame:
    """Spans for every request: target 0, its logic nodes 1, direct callees 2, further neighbours 3.

    ``requests`` is (request_id, symbol_id, radius); its radius bounds the neighbourhood per request.
    """
    seeds = requests.select(F.col("request_id").alias("seed"), F.col("symbol_id").alias("node"))
    limits = requests.select(F.col("request_id").alias("seed"), "radius")
    links = cg.call_links(calls, symbols, callers=callers)
    near = k_hop(seeds, links, radius, limits)
    # By merging: columns of a few values make a table look small, and its rows would go through the driver.
    symbols = symbols.hint("merge")
    place = symbols.select(F.col("symbol_id").alias("node"), *SPAN)
    target = requests.select("request_id", "symbol_id")
    s = symbols.select("symbol_id", *SPAN)
    own, called = cg.call_links(calls, symbols, callers=False) if callers else links
    direct = (target.join(own.select(F.col("src").alias("symbol_id"), F.col("dst").alias("_key")), "symbol_id")
              .join(called.select(F.col("src").alias("_key"), F.col("dst").alias("node")), "_key").select("request_id", "node"))
    rows0 = target.join(s, "symbol_id").select("request_id", *SPAN, F.lit(0).alias("priority"))
    rows1 = (target.join(nodes.select("symbol_id", "start_line", "end_line"), "symbol_id").join(s.select("symbol_id", "file"), "symbol_id")
             .select("request_id", *SPAN, F.lit(1).alias("priority")))
    rows2 = direct.join(place, "node").select("request_id", *SPAN, F.lit(2).alias("priority"))
    other = (near.filter("depth > 0").select(F.col("seed").alias("request_id"), "node")
             .join(direct.hint("merge"), ["request_id", "node"], "left_anti"))
    rows3 = other.join(place, "node").select("request_id", *SPAN, F.lit(3).alias("priority"))
    return rows0.unionByName(rows1).unionByName(rows2).unionByName(rows3)


def with_module_rank(items: DataFrame, requests: DataFrame, symbols: DataFrame, module_edges: DataFrame) -> DataFrame:
    """Attach the module rank: the target's module, modules it depends on, others."""
    symbols = symbols.hint("merge")
    home = requests.join(symbols.select("symbol_id", "file"), "symbol_id").select(
        "request_id", module_of(F.col("file"))["name"].alias("from_module"))
    scoped = module_edges.select("from_module", F.col("to_module").alias("module")).distinct().withColumn("scoped", F.lit(True))
    out = items.withColumn("module", module_of(F.col("file"))["name"]).join(home, "request_id").join(scoped, ["from_module", "module"], "left")
    rank = F.when(F.col("module") == F.col("from_module"), 0).when(F.col("scoped"), 1).otherwise(2)
    return out.withColumn("module_rank", rank).drop("from_module", "scoped", "module")


def planned_context(requests: DataFrame, symbols: DataFrame, calls: DataFrame, nodes: DataFrame, module_edges: DataFrame,
                    max_tokens: int = 3200, radius: int = 3, callers: bool = False) -> DataFrame:
    """Candidates without contained spans, ordered, up to the token budget of each request."""
    items = cut_lineage(context_candidates(requests, symbols, calls, nodes, radius, callers))
    kept = prune_contained(items, ["request_id", "file"])
    ranked = with_module_rank(kept, requests, symbols, module_edges).withColumn("cost", item_cost())
    order = [F.col(c) for c in ("priority", "module_rank", *SPAN)]
    return within_budget(ranked, ["request_id"], order, "cost", max(max_tokens - RESERVED, 0), 40)


def reasoning_context(requests: DataFrame, symbols: DataFrame, calls: DataFrame, nodes: DataFrame, radius: int = 1) -> DataFrame:
    """Merged logic spans of the target and its neighbours, flagged when the spans cover them."""
    home = requests.join(symbols.select("symbol_id", "file"), "symbol_id")
    ranges = home.join(nodes.select("symbol_id", "start_line", "end_line"), "symbol_id").select("request_id", *SPAN)
    spans = cut_lineage(merge_ranges(ranges, ["request_id", "file"]))
    seeds = requests.select(F.col("request_id").alias("seed"), F.col("symbol_id").alias("node"))
    near = cg.neighbourhood(calls, symbols, seeds, radius).filter("depth > 0").select(F.col("seed").alias("request_id"), "node")
    deps = cut_lineage(near.join(symbols.select(F.col("symbol_id").alias("node"), *SPAN), "node").select("request_id", *SPAN).distinct())
    open_deps = not_covered(deps, spans, ["request_id", "file"])
    kind = lambda df, k: df.select("request_id", *SPAN, F.lit(k).alias("kind"))
    covered = deps.join(open_deps, ["request_id", *SPAN], "left_anti")
    return kind(spans, "logic").unionByName(kind(open_deps, "dependency")).unionByName(kind(covered, "covered_dependency"))


def hybrid_context(planned: DataFrame, requests: DataFrame, symbols: DataFrame, nodes: DataFrame, max_tokens: int) -> DataFrame:
    """Score planned items with flow signals of the target, before anything is trimmed."""
    symbols = symbols.hint("merge")
    raw_chars = max(max_tokens * 4 - 1600, 800)
    n = lambda df, c: df.groupBy("symbol_id").agg(F.count("*").alias(c))
    base = (requests.select("request_id", "symbol_id").join(symbols.select("symbol_id", F.col("file").alias("focus")), "symbol_id")
            .join(n(control_flow(nodes), "cf"), "symbol_id", "left").join(n(data_flow(nodes), "df"), "symbol_id", "left")
            .join(n(logic_clusters(nodes), "cl"), "symbol_id", "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = planned.join(base, "request_id")
    score = (100 - F.col("priority") * 10 + F.when(F.col("used") * 3 <= raw_chars, 5).otherwise(0)
             + F.when((zero("cl") > 0) & (F.col("focus") == F.col("file")), 12).otherwise(0)
             + F.floor(F.least(zero("cf"), F.lit(20)) / 4) + F.floor(F.least(zero("df"), F.lit(20)) / 5) + F.least(zero("cl"), F.lit(6)))
    return rows.select("request_id", *SPAN, "priority", score.cast("bigint").alias("hybrid_score"))


def workspace_context(planned: DataFrame, repos: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Planned items per repository in scope; an empty scope means every repository.

    ``planned`` carries the repository of each item as ``repo``.
    """
    chosen = repos.select("name", "path")
    if scope is not None:
        keys = scope.select(F.col("entry").alias("_e")).distinct()
        wanted = chosen.select("name", F.explode(F.array("name", "path")).alias("_e")).join(keys, "_e", "left_semi").select("name").distinct()
        chosen = chosen.join(wanted, "name", "left_semi")
    return chosen.join(planned.withColumnRenamed("repo", "name"), "name")


def edit_context(targets: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Context of an edit: the symbol 0, symbols that call its name 1, resolved callers 2 for risky edits.

    ``targets`` is (request_id, name, risk).
    """
    best = cg.best_anywhere(symbols)
    place = symbols.select(F.col("symbol_id").alias("any_id"), *SPAN)
    own = targets.join(best, "name").join(place, "any_id").select("request_id", *SPAN, F.lit(0).alias("priority"))
    hit = (targets.select("request_id", F.col("name").alias("changed")).join(cg.impact(targets.select("name"), calls), "changed")
           .select("request_id", F.col("impacted_symbol").alias("name")).distinct())
    impacted = hit.join(best, "name").join(place, "any_id").select("request_id", *SPAN, F.lit(1).alias("priority"))
    risky = targets.filter("risk >= 0.4").join(best, "name").select("request_id", F.col("any_id").alias("symbol_id"))
    who = symbols.join(risky.select("symbol_id"), "symbol_id", "left_semi")
    callers = (risky.join(cg.callers_of(who, calls, symbols), "symbol_id").select("request_id", F.col("caller_id").alias("any_id"))
               .join(place, "any_id").select("request_id", *SPAN, F.lit(2).alias("priority")))
    return own.unionByName(impacted).unionByName(callers).distinct()


# ---- verification --------------------------------------------------------------------------

# Issue raised when a check is false, in reporting order.
ISSUES = {"exact_target_in_top_context": "top_context_file_does_not_contain_target_symbol",
          "exact_target_span_in_top_context": "top_context_span_does_not_overlap_target_symbol",
          "exact_dependencies_in_reported_files": "dependency_file_does_not_contain_reported_symbol",
          "exact_impact_scope_alignment": "impact_scope_misaligned",
          "exact_impact_scope_graph_alignment": "impact_scope_graph_misaligned",
          "exact_impact_scope_target_anchor": "impact_scope_not_anchored_to_target",
          "exact_impact_scope_graph_complete": "impact_scope_graph_incomplete",
          "workspace_boundary_alignment": "context_crosses_workspace_boundary"}
OPTIONAL = tuple(ISSUES)[2:]


def verify(requests: DataFrame, fallback_tool: str = "fuzzy_symbol_search") -> DataFrame:
    """Issues, status and readiness of every answered request; ``fallback_tool`` only guesses.

    Rows carry intent, selected_tool, has_target, has_top_file, candidate_aligned, refs, confidence,
    the three escalation flags and the nullable exact checks.
    """
    fallback = F.col("selected_tool") == fallback_tool
    raised: list[Column] = [
        F.when(~F.col("has_target") & ~fallback, "missing_target_symbol"),
        F.when(~F.col("has_top_file") & ~fallback & (F.col("refs") > 0), "missing_top_context_file"),
        F.when(~F.col("candidate_aligned"), "candidate_symbols_do_not_include_target")]
    raised += [F.when(F.col(check) == F.lit(False), issue) for check, issue in ISSUES.items()]
    raised.append(F.when((F.col("refs") == 0) & ~fallback, "no_context_refs"))
    issues = F.array_compact(F.array(*raised))
    status = (F.when(fallback, "fallback_search").when(F.array_contains("issues", "no_context_refs"), "no_context_refs")
              .when(F.size("issues") > 0, "needs_review")
              .when(F.col("low_confidence_raw") | (F.col("confidence") < 0.5), "low_confidence")
              .when(F.col("escalated") | F.col("raw_seed") | (F.col("confidence") < 0.75), "needs_review").otherwise("high_confidence"))
    checks: Mapping[str, Column] = {
        "target_symbol_present": F.col("has_target"), "top_context_present": F.col("has_top_file"),
        "candidate_target_aligned": F.col("candidate_aligned"), "context_refs_present": F.col("refs") > 0,
        "exact_target_in_top_context": F.col("exact_target_in_top_context"),
        "exact_target_span_in_top_context": F.col("exact_target_span_in_top_context")}
    every = {**checks, **{c: F.col(c) for c in OPTIONAL}}
    pick = lambda test: F.array_compact(F.array(*[F.when(test(v), n) for n, v in every.items()]))
    missing = F.array_compact(F.array(*[F.when(v.isNull(), n) for n, v in checks.items()]))
    out = requests.withColumn("issues", issues).withColumns({
        "status": status, "passed": pick(lambda v: v), "failed": pick(lambda v: ~v), "missing": missing})
    mutating = F.col("intent").isin("implement", "refactor")
    bundle = (F.when(~mutating, "not_applicable").when(fallback, "blocked").when(F.size("failed") > 0, "blocked")
              .when(F.size("missing") > 0, "needs_retry").otherwise("exact_ready"))
    out = out.withColumn("bundle_status", bundle)
    state = (F.when(~mutating, "not_applicable")
             .when((F.col("status") == "high_confidence") | (F.col("bundle_status") == "exact_ready"), "ready").otherwise("blocked"))
    out = out.withColumn("mutation_state", state)
    return out.withColumn("block_reason", F.when(F.col("mutation_state") == "blocked", F.coalesce(F.get("issues", F.lit(0)), F.col("status"))))


def impact_scope_alignment(scopes: DataFrame, files: DataFrame, names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Does the reported impact fit the index: (request_id, aligned, anchored).

    ``scopes`` is (request_id, target_symbol, top_file, anchor_symbol, anchor_file), ``files`` and
    ``names`` hold the impacted files and symbols. A file in another workspace or without any of the
    impacted symbols breaks the alignment; a file without outline leaves it unknown.
    """
    # A name's files are met, not a file's names, of which there may be many for each name that is asked for; only a
    # name of more than ``COMMON`` files is looked for in the files of the request.
    places = cut_lineage(symbols.filter("file IS NOT NULL").select(F.lower("name").alias("_n"), "file").distinct())
    common = places.groupBy("_n").count().filter(F.col("count") > COMMON).select("_n")
    asked = names.select("request_id", F.lower("symbol").alias("_n")).distinct()
    own = files.select("request_id", "file")
    rare = asked.join(places.join(common, "_n", "left_anti"), "_n").select("request_id", "file")
    often = own.join(places.join(common, "_n", "left_semi"), "file").join(asked.join(common, "_n", "left_semi"), ["request_id", "_n"]).select("request_id", "file")
    known = symbols.select("file").distinct().withColumn("_known", F.lit(True))
    yes, no = F.lit(True), F.lit(False)
    rows = own.join(known, "file", "left").select("request_id", "file", F.col("_known").isNotNull().alias("_known"), yes.alias("_own"), no.alias("_hit"))
    hits = rare.unionByName(often)
    rows = rows.unionByName(hits.select("request_id", "file", no.alias("_known"), no.alias("_own"), yes.alias("_hit")))
    rows = rows.groupBy("request_id", "file").agg(*[F.max(c).alias(c) for c in ("_known", "_own", "_hit")]).filter("_own")
    # One row a request: workspaces of its files and of its top file, and what its files and names tell.
    facts = {"_file": "string", "_top": "string", "_missed": "boolean", "_unknown": "boolean", "_named": "boolean"}

    def fact(df: DataFrame, **known: Column) -> DataFrame:
        return df.select("request_id", *[known.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in facts.items()])

    rows = fact(rows, _file=workspace_boundary(F.col("file")), _missed=F.col("_known") & ~F.col("_hit"), _unknown=~F.col("_known"))
    rows = rows.unionByName(fact(names, _named=yes)).unionByName(fact(scopes, _top=workspace_boundary(F.col("top_file"))))
    crossing = F.coalesce((F.min("_top") != F.max("_file")) | (F.max("_top") != F.min("_file")), F.lit(False))
    missed = F.max("_missed")
    bad = F.when(missed.isNotNull(), crossing | (missed & F.max("_named").isNotNull()))
    verdict = rows.groupBy("request_id").agg(bad.alias("_bad"), F.max("_unknown").alias("_unknown"))
    aligned = (F.when(F.col("_bad").isNull(), True).when(F.col("_bad"), False).when(F.col("_unknown"), F.lit(None).cast("boolean")).otherwise(True))
    anchored = (F.when(F.col("anchor_symbol").isNull(), F.lit(None).cast("boolean"))
                .when(F.lower("anchor_symbol") != F.lower("target_symbol"), False)
                .otherwise(F.col("anchor_file").eqNullSafe(F.col("top_file"))))
    return scopes.join(verdict, "request_id", "left").select("request_id", aligned.alias("aligned"), anchored.alias("anchored"))


# ---- error memory --------------------------------------------------------------------------

def similar_errors(asked: DataFrame, patterns: DataFrame, solutions: DataFrame, n: int = 3) -> DataFrame:
    """Known patterns for a new error: equal hash, else the most frequent of its kind.

    ``asked`` is (request_id, kind, hash). Each pattern comes with its newest working solution and
    the number of attempts that failed.
    """
    from .scale import top_n

    p = patterns.select("pattern_id", "kind", "hash", "hits")
    same = asked.join(p.drop("kind"), "hash").select("request_id", "pattern_id", "hits", F.lit("hash").alias("matched_by"))
    rest = asked.join(same.select("request_id"), "request_id", "left_anti")
    frequent = top_n(p, ["kind"], [F.desc("hits"), F.col("pattern_id")], n)
    by_kind = rest.select("request_id", "kind").join(frequent, "kind").select("request_id", "pattern_id", "hits", F.lit("kind").alias("matched_by"))
    found = top_n(same.unionByName(by_kind), ["request_id"], [F.desc("hits"), F.col("pattern_id")], n, "rank")
    known = solutions.groupBy("pattern_id").agg(
        F.max_by("solution", F.when(F.col("outcome") == "resolved", F.struct("ts_ms", "solution"))).alias("resolved_by"),
        F.count_if(F.col("outcome") == "failed").alias("failed_attempts"))
    return found.join(known, "pattern_id", "left").withColumn("failed_attempts", F.coalesce("failed_attempts", F.lit(0).cast("bigint")))
