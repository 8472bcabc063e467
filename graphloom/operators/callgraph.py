"""Call graph: resolving name edges to symbols, targets of calls, impact, module and debug graphs.

A name edge says who calls which name from which file, and, if known, where the callee lives.
Resolution joins edges to lookup tables with one row per key, so a frequent name never multiplies
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import is_test_path
from ..functions.paths import module_of
from ..session import cut_lineage
from .graph import k_hop, reached_counts
from .scale import first_per_key


def _type_rank() -> Column:
    return F.when(F.col("type") == "function", 0).when(F.col("type") == "class", 1).otherwise(2)


def best_in_file(symbols: DataFrame) -> DataFrame:
    """Preferred symbol per (name, file): functions, then classes, newest first."""
    return symbols.groupBy("name", "file").agg(
        F.min_by("symbol_id", F.struct(_type_rank().alias("t"), (-F.col("symbol_id")).alias("i"))).alias("local_id"))


def best_anywhere(symbols: DataFrame) -> DataFrame:
    """Preferred symbol per name."""
    return symbols.groupBy("name").agg(
        F.min_by("symbol_id", F.struct(_type_rank().alias("t"), (-F.col("symbol_id")).alias("i"))).alias("any_id"))


def resolve_callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Attach ``callee_id``: the symbol in the given file, else in the caller's file, else any.

    A given callee file is binding: without a match there the edge stays unresolved.
    """
    where = F.coalesce("callee_file", "file")
    local = best_in_file(symbols).select(F.col("name").alias("callee_symbol"), F.col("file").alias("_where"), "local_id")
    anywhere = best_anywhere(symbols).select(F.col("name").alias("callee_symbol"), "any_id")
    out = calls.withColumn("_where", where).join(local, ["callee_symbol", "_where"], "left").join(anywhere, "callee_symbol", "left")
    chosen = F.coalesce("local_id", F.when(F.col("callee_file").isNull(), F.col("any_id")))
    return out.withColumn("callee_id", chosen).drop("_where", "local_id", "any_id")


def resolve_callers(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Attach ``caller_id``: the symbol in the edge's file, else any symbol of that name."""
    local = best_in_file(symbols).select(F.col("name").alias("caller_symbol"), "file", "local_id")
    anywhere = best_anywhere(symbols).select(F.col("name").alias("caller_symbol"), "any_id")
    out = calls.join(local, ["caller_symbol", "file"], "left").join(anywhere, "caller_symbol", "left")
    return out.withColumn("caller_id", F.coalesce("local_id", "any_id")).drop("local_id", "any_id")


def callers_of(targets: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, caller_id) of the target symbols. An edge without callee file counts for every
    symbol of that name, one with a file only for the symbol in that file."""
    edges = resolve_callers(calls, symbols).select("callee_symbol", "callee_file", "caller_id").distinct()
    named = edges.filter("callee_file IS NULL").select(F.col("callee_symbol").alias("name"), "caller_id")
    filed = edges.filter("callee_file IS NOT NULL").select(
        F.col("callee_symbol").alias("name"), F.col("callee_file").alias("file"), "caller_id")
    t = targets.select("symbol_id", "name", "file")
    return (t.join(named, "name").select("symbol_id", "caller_id")
            .unionByName(t.join(filed, ["name", "file"]).select("symbol_id", "caller_id")).distinct())


def caller_counts(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Caller edges per symbol, counted per name and per (name, file) before the join."""
    edges = calls.select("caller_symbol", "file", "callee_symbol", "callee_file").distinct()
    by_name = edges.filter("callee_file IS NULL").groupBy(F.col("callee_symbol").alias("name")).agg(F.count("*").alias("n1"))
    by_file = edges.filter("callee_file IS NOT NULL").groupBy(
        F.col("callee_symbol").alias("name"), F.col("callee_file").alias("file")).agg(F.count("*").alias("n2"))
    joined = symbols.select("symbol_id", "name", "file").join(by_name, "name", "left").join(by_file, ["name", "file"], "left")
    return joined.select("symbol_id", (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("callers"))


def callee_counts(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolved callee edges per symbol."""
    return _callees_per_symbol(resolve_callees(calls.select("caller_symbol", "file", "callee_symbol", "callee_file").distinct(), symbols), symbols)


def _callees_per_symbol(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    n = resolved.filter("callee_id IS NOT NULL").groupBy(F.col("caller_symbol").alias("name"), "file").agg(F.count("*").alias("n"))
    return symbols.select("symbol_id", "name", "file").join(n, ["name", "file"], "left").select(
        "symbol_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("callees"))


def call_links(calls: DataFrame, symbols: DataFrame, callees: bool = True, callers: bool = True) -> list[DataFrame]:
    """The call graph as links for a search, resolved once.

    A hop leads from a symbol to its keys, its name and its name in its file, and from a key to symbols. Calls are tied to
    keys, so hubs and frequent names cost no more than the edges they have. Keys are numbers given once, even ones for a name
    in a file and odd ones for a name: names and files are shuffled where a call meets its lookup table and nowhere after.
    Lookup tables are joined by merging: their files are small for their rows, which must not go through the driver.
    """
    number = 2 * F.monotonically_increasing_id()
    local = cut_lineage(best_in_file(symbols.filter("name IS NOT NULL AND file IS NOT NULL")).withColumn("key", number)).hint("merge")
    anywhere = cut_lineage(best_anywhere(symbols.filter("name IS NOT NULL")).withColumn("key", number + 1)).hint("merge")
    owner = symbols.select(F.col("symbol_id").alias("src"), "name", "file")
    keys = owner.join(local, ["name", "file"]).select("src", F.col("key").alias("dst"))
    if callers:
        keys = keys.unionByName(owner.join(anywhere, "name").select("src", F.col("key").alias("dst")))

    target = local.select(F.col("name").alias("callee_symbol"), F.col("file").alias("_where"), "local_id", F.col("key").alias("_here"))
    named = anywhere.select(F.col("name").alias("callee_symbol"), "any_id", F.col("key").alias("_named"))
    found = (calls.select("caller_symbol", "file", "callee_symbol", "callee_file", F.coalesce("callee_file", "file").alias("_where"))
             .join(target, ["callee_symbol", "_where"], "left").join(named, "callee_symbol", "left"))
    open_target = F.col("callee_file").isNull()
    ends = found.select("caller_symbol", "file", F.coalesce("local_id", F.when(open_target, F.col("any_id"))).alias("callee_id"),
                        F.when(open_target, F.col("_named")).otherwise(F.col("_here")).alias("_to"))
    if not callers:
        ends = ends.filter("callee_id IS NOT NULL")
    ends = ends.join(local.select(F.col("name").alias("caller_symbol"), "file", "local_id", F.col("key").alias("_from")), ["caller_symbol", "file"], "left" if callers else "inner")
    links = [F.struct(F.col("_from").alias("src"), F.col("callee_id").alias("dst"))] if callees else []
    if callers:
        ends = ends.join(anywhere.select(F.col("name").alias("caller_symbol"), "any_id"), "caller_symbol", "left")
        links.append(F.struct(F.col("_to").alias("src"), F.coalesce("local_id", "any_id").alias("dst")))
    out = ends.select(F.inline(F.array(*links))).filter("src IS NOT NULL AND dst IS NOT NULL")
    return [cut_lineage(keys), cut_lineage(out.distinct())]


def neighbourhood(calls: DataFrame, symbols: DataFrame, seeds: DataFrame, radius: int,
                  callees: bool = True, callers: bool = True, limits: DataFrame | None = None) -> DataFrame:
    """(seed, node, depth) within ``radius`` hops; seeds is a table (seed, node)."""
    return k_hop(seeds, call_links(calls, symbols, callees, callers), radius, limits)


def neighbourhood_sizes(calls: DataFrame, symbols: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(seed, depth, nodes) within ``radius`` hops."""
    return reached_counts(seeds, call_links(calls, symbols), radius)


def seeds_by_name(names: DataFrame, symbols: DataFrame, seed: str = "name") -> DataFrame:
    """Resolve wanted names to (seed, node)."""
    wanted = names.select("name", F.col(seed).alias("seed")).distinct()
    return wanted.join(best_anywhere(symbols), "name").select("seed", F.col("any_id").alias("node"))


# ---- targets of calls ----------------------------------------------------------------------

def import_targets(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Resolve raw call names through the imports of their file.

    An exact import of the name wins; otherwise ``base.member`` with an imported base names the
    member in the base's file; otherwise the name stays local.
    """
    bound = imports.groupBy("file", "local_name").agg(F.max_by(F.struct("target_file", "source_symbol"), "position").alias("t"))
    dotted = F.regexp_replace(F.regexp_extract("raw_name", r"^(.*)\.[^.]*$", 1), r"[.?]+$", "")
    member = F.regexp_extract("raw_name", r"\.([^.]*)$", 1)
    prepared = calls.withColumns({"_base": dotted, "_member": member})
    exact = bound.select("file", F.col("local_name").alias("raw_name"), F.col("t").alias("_exact"))
    base = bound.select("file", F.col("local_name").alias("_base"), F.col("t").alias("_through"))
    joined = prepared.join(exact, ["file", "raw_name"], "left").join(base, ["file", "_base"], "left")
    through = F.col("_through").isNotNull() & (F.col("_member") != "")
    return joined.withColumns({
        "callee_symbol": F.when(F.col("_exact").isNotNull(), F.coalesce("_exact.source_symbol", "raw_name"))
        .when(through, F.col("_member")).otherwise(F.col("raw_name")),
        "callee_file": F.when(F.col("_exact").isNotNull(), F.col("_exact.target_file")).when(through, F.col("_through.target_file")),
    }).drop("_base", "_member", "_exact", "_through")


def annotate_local_targets(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """A callee defined in the calling file points to that file, whatever was known before."""
    local = symbols.select("file", F.col("name").alias("callee_symbol")).distinct().withColumn("_l", F.lit(True))
    return calls.join(local, ["file", "callee_symbol"], "left").withColumn(
        "callee_file", F.when(F.col("_l"), F.col("file")).otherwise(F.col("callee_file"))).drop("_l")


def chase_reexports(targets: DataFrame, named: DataFrame, star: DataFrame, defaults: DataFrame, hops: int = 4) -> DataFrame:
    """Follow re-exports for at most ``hops`` steps: (callee_symbol, callee_file) -> final pair.

    In each file the first statement that names the symbol or re-exports everything decides.
    """
    n = named.groupBy("file", "exported_name").agg(
        F.min(F.struct("position", "source_name", "target_file")).alias("n"))
    s = star.groupBy("file").agg(F.min(F.struct("position", "target_file")).alias("s"))
    d = defaults.groupBy("file").agg(F.min_by("name", "position").alias("d"))
    n = n.select(F.col("file").alias("_f"), F.col("exported_name").alias("_n"), "n")
    s = s.select(F.col("file").alias("_f"), "s")
    d = d.select(F.col("file").alias("_f"), "d")
    out = targets.withColumns({"_n": F.col("callee_symbol"), "_f": F.col("callee_file")})
    for _ in range(hops):
        out = out.join(n, ["_f", "_n"], "left").join(s, "_f", "left").join(d, "_f", "left")
        is_default = (F.col("_n") == "default") & F.col("d").isNotNull()
        by_name = F.col("n").isNotNull() & (F.col("s").isNull() | (F.col("n.position") <= F.col("s.position")))
        name = F.when(is_default, F.col("d")).when(by_name, F.col("n.source_name")).otherwise(F.col("_n"))
        file = (F.when(is_default, F.col("_f")).when(by_name, F.col("n.target_file"))
                .when(F.col("s").isNotNull(), F.col("s.target_file")).otherwise(F.col("_f")))
        out = out.withColumns({"_nn": name, "_ff": file}).drop("_n", "_f", "n", "s", "d")
        out = out.withColumnsRenamed({"_nn": "_n", "_ff": "_f"})
    return out.withColumnsRenamed({"_n": "final_symbol", "_f": "final_file"})


# ---- impact --------------------------------------------------------------------------------

def uncalled_symbols(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols whose name is never called."""
    return symbols.join(calls.select(F.col("callee_symbol").alias("name")).distinct(), "name", "left_anti")


def impact(changed: DataFrame, calls: DataFrame) -> DataFrame:
    """Direct callers of each changed name with their file and whether it is a test."""
    hits = changed.select(F.col("name").alias("callee_symbol")).distinct().join(calls, "callee_symbol")
    return hits.select(F.col("callee_symbol").alias("changed"), F.col("caller_symbol").alias("impacted_symbol"), "file",
                       is_test_path(F.col("file")).alias("is_test")).distinct()


def impact_in_file(changed: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Callers of the changed symbol of one file; unknown targets fall back to their name alone.

    ``changed`` is (name, file); names match without regard to case.
    """
    lower = symbols.withColumn("_l", F.lower("name"))
    target = first_per_key(lower, ["file", "_l"], [F.col("start_line"), F.col("name"), F.col("symbol_id")])
    wanted = changed.select(F.col("name").alias("changed"), "file", F.lower("name").alias("_l")).distinct()
    found = wanted.join(target.select("file", "_l", "symbol_id", "name"), ["file", "_l"], "left")
    known = found.filter("symbol_id IS NOT NULL")
    callers = callers_of(known.select("symbol_id", "name", "file").distinct(), calls, symbols)
    info = symbols.select(F.col("symbol_id").alias("caller_id"), F.col("name").alias("impacted_symbol"), F.col("file").alias("impacted_file"))
    first = known.join(callers, "symbol_id").join(info, "caller_id").select("changed", "file", "impacted_symbol", "impacted_file")
    rest = found.filter("symbol_id IS NULL").select("changed", "file")
    by_name = impact(rest.select(F.col("changed").alias("name")), calls).select(
        "changed", "impacted_symbol", F.col("file").alias("impacted_file"))
    return first.unionByName(rest.join(by_name, "changed").select("changed", "file", "impacted_symbol", "impacted_file")).distinct()


# ---- derived graphs ------------------------------------------------------------------------

def module_graph(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Module pairs connected by calls; a name belongs to the first file that defines it."""
    first = first_per_key(symbols, ["name"], [F.col("file"), F.col("start_line")]).select("name", F.col("file").alias("first_file"))
    joined = (calls.join(first.withColumnsRenamed({"name": "callee_symbol", "first_file": "to_file"}), "callee_symbol")
              .join(first.withColumnsRenamed({"name": "caller_symbol", "first_file": "from_file"}), "caller_symbol", "left"))
    source = module_of(F.coalesce("from_file", "file"))["name"]
    pairs = joined.select(source.alias("from_module"), module_of(F.col("to_file"))["name"].alias("to_module")).distinct()
    return pairs.filter("from_module <> to_module")


def named_edges(edges: DataFrame, nodes: DataFrame, ident: str, name: str) -> DataFrame:
    """Edges by id -> edges by name."""
    a = nodes.select(F.col(ident).alias("src"), F.col(name).alias("from_name"))
    b = nodes.select(F.col(ident).alias("dst"), F.col(name).alias("to_name"))
    return edges.join(a, "src").join(b, "dst").select("from_name", "to_name").distinct()


def reciprocal(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Pairs connected both ways, smaller name first."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    low = F.least("a", "b")
    both = e.filter("a <> b").groupBy(low.alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    return both.filter("n = 2").select("a", "b")


def ownership_edges(typed: DataFrame) -> DataFrame:
    """Owner -> item and trait -> implementation edges of typed symbols."""
    links = F.array_compact(F.array(
        F.when(F.col("kind").isin("ImplBlock", "Method"), F.col("owner_name")),
        F.when(F.col("kind") == "ImplBlock", F.col("trait_name"))))
    return typed.select(F.explode(links).alias("caller_symbol"), F.col("name").alias("callee_symbol"), "file",
                        F.col("file").alias("callee_file"))


def organisation_graph(repos: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per repository and dependency; repositories without any keep one row."""
    return repos.select("name").join(edges.select(F.col("from_repo").alias("name"), F.col("to_repo").alias("depends_on")).distinct(), "name", "left")


def sdk_usage(repos: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: shared libraries it uses and how many others it could use.

    Every repository may use every shared library but itself; that set is the product of two lists,
    so it is given by its size instead of being written out.
    """
    shared = edges.groupBy("to_repo").agg(F.count_distinct("from_repo").alias("n")).filter("n >= 2").select("to_repo")
    used = edges.join(shared, "to_repo", "left_semi").groupBy(F.col("from_repo").alias("name")).agg(F.count_distinct("to_repo").alias("used"))
    own = shared.select(F.col("to_repo").alias("name"), F.lit(1).alias("own"))
    total = shared.agg(F.count("*").alias("total")).withColumn("k", F.lit(1))
    base = repos.select("name").distinct().join(used, "name", "left").join(own, "name", "left").withColumn("k", F.lit(1))
    return base.join(F.broadcast(total), "k").select(
        "name", F.coalesce("used", F.lit(0).cast("bigint")).alias("used"),
        (F.col("total") - F.coalesce("own", F.lit(0))).alias("available"))


def service_graph(repos: DataFrame, module_edges: DataFrame) -> DataFrame:
    """(service, dependency): service-like modules of a repository point to the services of their targets."""
    name = F.when(F.col("name").contains("service"), F.col("name")).otherwise(F.concat("name", F.lit("_service")))
    own = module_edges.filter(F.col("from_module").contains("api") | F.col("from_module").contains("service"))
    deps = own.select("repo_id", F.concat("to_module", F.lit("_service")).alias("depends_on")).distinct()
    return repos.select("repo_id", name.alias("service")).join(deps, "repo_id", "left").select("service", "depends_on").distinct()


def stage_of(repo: Column) -> Column:
    """Position in a staged roll-out: libraries, services, clients, others."""
    return (F.when(repo.rlike("lib|sdk"), 0).when(repo.rlike("service|api"), 1).when(repo.rlike("client|app"), 2).otherwise(3))


def staged_order(repos: DataFrame, name: str) -> DataFrame:
    """Repositories in the order they are updated, with the stage of each."""
    names = F.array(*[F.lit(s) for s in ("libraries", "services", "clients", "others")])
    out = repos.select(F.col(name).alias("repository"), stage_of(F.col(name)).alias("stage_rank"))
    return out.withColumn("stage", F.get(names, F.col("stage_rank"))).orderBy("stage_rank", "repository")


def adaptive_radius(symbols: DataFrame, calls: DataFrame, nodes: DataFrame, max_tokens: int, base_logic: int = 1, base_dependency: int = 1) -> DataFrame:
    """Search radii per symbol from its fan-out, its logic nodes and the token budget."""
    counts = nodes.groupBy("symbol_id").agg(F.count("*").alias("logic_nodes"))
    s = (callee_counts(calls, symbols).join(caller_counts(calls, symbols), "symbol_id").join(counts, "symbol_id", "left")
         .withColumns({"fan_out": F.col("callees") + F.col("callers"), "logic_nodes": F.coalesce("logic_nodes", F.lit(0).cast("bigint"))}))
    tight, wide = max_tokens <= 1200, max_tokens > 2600
    logic, dep = (1, 1) if tight else (max(base_logic, 1), max(base_dependency, 1))
    dep_radius = F.when(F.col("fan_out") > 12, min(dep, 1)).otherwise(dep)
    logic_radius = F.when(F.col("logic_nodes") > 24, min(logic, 1)).otherwise(logic)
    if wide:
        dep_radius = F.when(F.col("fan_out") > 12, min(dep, 1)).when(F.col("fan_out") < 4, min(max(dep, 2), 3)).otherwise(dep)
        logic_radius = F.when(F.col("logic_nodes") > 24, min(logic, 1)).when(F.col("logic_nodes") < 8, min(max(logic, 2), 3)).otherwise(logic)
    return s.select("symbol_id", "fan_out", "logic_nodes", logic_radius.alias("logic_radius"), dep_radius.alias("dependency_radius"))


# ---- failures ------------------------------------------------------------------------------

def debug_graph(frames: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(event_id, node, depth) within two hops of the symbols named in a failure's stack."""
    seeds = seeds_by_name(frames.select(F.col("symbol").alias("name"), "event_id"), symbols, "event_id")
    return neighbourhood(calls, symbols, seeds, 2).withColumnRenamed("seed", "event_id")


def rank_root_causes(graph: DataFrame, frames: DataFrame, events: DataFrame, patches: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Score every symbol of a debug graph as the cause of its failure; the best one gets 1.

    ``frames`` is (event_id, symbol), ``events`` (event_id, ts_s), ``patches`` (symbol, ts_s).
    """
    graph = cut_lineage(graph)
    info = symbols.join(graph.select(F.col("node").alias("symbol_id")), "symbol_id", "left_semi")
    nodes = graph.join(info.select(F.col("symbol_id").alias("node"), F.col("name").alias("symbol"), "file"), "node")
    named = cut_lineage(frames.select("event_id", "symbol").distinct())
    on_stack = named.withColumn("on_stack", F.lit(True))
    edges = calls.select("caller_symbol", "file", "callee_symbol", "callee_file")
    # Only calls of names that a wanted symbol has, and calls by symbols of the graphs, are resolved.
    wanted = cut_lineage(named.join(symbols.select(F.col("name").alias("symbol"), F.col("symbol_id").alias("callee_id")), "symbol").select("event_id", "callee_id").distinct())
    asked = symbols.join(wanted.select(F.col("callee_id").alias("symbol_id")), "symbol_id", "left_semi").select(F.col("name").alias("callee_symbol")).distinct()
    near = (resolve_callees(edges.join(asked, "callee_symbol", "left_semi"), symbols).join(wanted, "callee_id")
            .select("event_id", F.col("caller_symbol").alias("symbol"), "file").distinct().withColumn("near_stack", F.lit(True)))
    own = edges.join(info.select(F.col("name").alias("caller_symbol"), "file"), ["caller_symbol", "file"], "left_semi").distinct()
    degree = _callees_per_symbol(resolve_callees(own, symbols), info).withColumnRenamed("symbol_id", "node")
    changes = patches.groupBy("symbol").agg(F.count("*").alias("changes"), F.max("ts_s").alias("last_s"))
    s = (nodes.join(on_stack, ["event_id", "symbol"], "left").join(near, ["event_id", "symbol", "file"], "left")
         .join(degree, "node").join(changes, "symbol", "left").join(events.select("event_id", "ts_s"), "event_id"))
    proximity = F.when(F.col("on_stack"), 1.0).when(F.col("near_stack"), 0.7).otherwise(0.35)
    age = F.greatest(F.col("ts_s") - F.col("last_s"), F.lit(0)) / 86400.0
    recency = F.coalesce(1.0 / (1.0 + age), F.lit(0.2))
    frequency = F.coalesce(F.least(F.col("changes") / 10.0, F.lit(1.0)), F.lit(0.1))
    depth = F.when(F.col("callees") == 0, 1.0).otherwise(F.greatest(1.0 / (1.0 + F.col("callees")), F.lit(0.1)))
    scored = s.select("event_id", "node", "symbol", (proximity * 0.45 + recency * 0.2 + frequency * 0.2 + depth * 0.15).alias("score"))
    return max_normalised(scored, "event_id", "score", "probability")


def max_normalised(df: DataFrame, key: str, score: str, out: str) -> DataFrame:
    """Divide by the largest score of the key; groups are reduced to one row before the join."""
    top = df.groupBy(key).agg(F.max(score).alias("_top"))
    return df.join(top, key).withColumn(out, F.round(F.when(F.col("_top") > 0, F.col(score) / F.col("_top")).otherwise(F.col(score)), 6)).drop("_top", score)
