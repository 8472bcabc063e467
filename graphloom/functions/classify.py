"""Column expressions that label nodes, files, paths, tasks and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


# Label of a logic node by its type.
NODE_LABELS = {"Loop": "iteration", "Try": "risky_operation", "Catch": "error_recovery", "Finally": "error_recovery",
               "Return": "result_exit", "Call": "side_effect_call", "Await": "async_wait", "Throw": "error_exit",
               "Switch": "multi_branch", "Case": "multi_branch"}

# Block name of a node label.
BLOCKS = {"guard_clause": "decision_block", "branch_decision": "decision_block", "multi_branch": "decision_block",
          "iteration": "iteration_block", "error_recovery": "error_path", "error_exit": "error_path",
          "risky_operation": "error_path", "async_wait": "side_effects", "side_effect_call": "side_effects",
          "state_update": "state_changes", "value_assignment": "state_changes", "result_exit": "result_path"}

# Keywords of each risk area.
RISK_WORDS = {"security": "auth|login|jwt|token|security", "payments": "billing|payment|invoice|stripe",
              "infrastructure": "infra|db|database|migration|deploy|config"}

# Token weights of each intent.
INTENT_WEIGHTS = {
    "debug": {3: "fix bug error failure failing broken issue crash crashes fails failed debug diagnose investigate repair fault wrong",
              2: "trace triage stuck regression"},
    "refactor": {3: "refactor rewrite restructure cleanup simplify extract rename migrate modularize",
                 2: "optimize improve harden stabilize"},
    "implement": {3: "add implement create build introduce support enable allow update extend",
                  2: "change wire generate make"},
    "understand": {3: "explain understand describe document clarify summarize overview inspect", 2: "what why how show"},
}
INTENT_ORDER = ("debug", "refactor", "implement", "understand")
FAILURE_WORDS = ("fail", "failure", "error", "bug", "crash", "broken")

# Default token budget of each intent.
INTENT_BUDGETS = {"debug": 1600, "refactor": 2000, "implement": 1400, "understand": 800}


def mapped(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[key], F.lit(default))


def node_label(node_type: Column, text: Column) -> Column:
    low = F.lower(text)
    return (F.when(node_type == "Conditional", F.when(low.rlike("return|throw"), "guard_clause").otherwise("branch_decision"))
            .when(node_type == "Assignment", F.when(low.rlike("state|cache"), "state_update").otherwise("value_assignment"))
            .otherwise(mapped(node_type, NODE_LABELS, "logic")))


def cluster_label(label: Column) -> Column:
    return mapped(label, BLOCKS, "logic_block")


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def edit_kind(text: Column) -> Column:
    """Requested edit: rename before signature change before refactoring, else plain change."""
    low = F.lower(text)
    return (F.when(low.contains("rename"), "RenameSymbol").when(low.rlike("signature|parameter"), "ChangeSignature")
            .when(low.contains("refactor"), "RefactorFunction").otherwise("ModifyLogic"))


def file_objective(path: Column, symbols: Column) -> Column:
    """Purpose of a file by path keywords, then by symbol names."""
    low = F.lower(path)
    names = F.array_join(F.transform(symbols, F.lower), " ")
    return (F.when(low.rlike("test|spec"), "tests").when(low.rlike("api|server|route"), "api_surface")
            .when(low.rlike("store|repo|db"), "data_layer").when(low.rlike("ui|component|view"), "ui_layer")
            .when(names.rlike("render|component"), "ui_layer").otherwise("application_logic"))


def file_objective_rich(path: Column, symbols: Column) -> Column:
    low = F.lower(path)
    names = F.array_join(F.transform(symbols, F.lower), " ")
    return (F.when(low.rlike("test|spec"), "tests")
            .when(low.rlike("route|handler|controller|api|server|endpoint"), "api_surface")
            .when(low.rlike("store|repo|db|model|migration|schema|seed"), "data_layer")
            .when(low.rlike(r"component|widget|view|\.tsx$|\.jsx$"), "ui_layer")
            .when(names.rlike("render|component|view"), "ui_layer").when(names.rlike("handler|route|endpoint"), "api_surface")
            .when(names.rlike("store|repo|query|insert|update|delete"), "data_layer").otherwise("application_logic"))


def is_entry_path(path: Column) -> Column:
    return F.lower(path).rlike(r"main|/app\.|index\.|server\.|entrypoint|entry\.|app\.tsx?$|app\.js$")


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike("test|spec")


def is_test_path_strict(path: Column) -> Column:
    return F.lower(path).rlike(r"test|_spec\.rs$|\.spec\.ts$|\.test\.ts$")


def risk_signals(text: Column) -> Column:
    """Risk areas whose keywords occur in the text."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(rx), F.lit(name)) for name, rx in RISK_WORDS.items()]))


def importance(signals: Column) -> Column:
    high = F.arrays_overlap(signals, F.array(*[F.lit(s) for s in (*RISK_WORDS, "high_fanout", "entry_points")]))
    return F.when(high, "high").when(F.size(signals) == 0, "low").otherwise("medium")


def simple_intent(text: Column) -> Column:
    low = F.lower(text)
    return (F.when(low.rlike("fix|bug|error"), "debug").when(low.rlike("refactor|rewrite|optimize"), "refactor")
            .when(low.rlike("how does|explain"), "understand").otherwise("locate"))


def intent_scores(text: Column) -> dict[str, Column]:
    """Weighted token and phrase score per intent."""
    low = F.lower(text)
    toks = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    scores = {}

    def hits(vocabulary: str) -> Column:
        return F.size(F.filter(toks, lambda w: w.isin(*vocabulary.split())))

    for intent, weights in INTENT_WEIGHTS.items():
        total: Column = F.lit(0)
        for weight, vocabulary in weights.items():
            total = total + hits(vocabulary) * weight
        scores[intent] = total
    failing = low.rlike("|".join(FAILURE_WORDS))

    def bonus(cond: Column, points: int) -> Column:
        return F.when(cond, points).otherwise(0)

    has = lambda *phrases: low.rlike("|".join(phrases))
    scores["debug"] = (scores["debug"] + bonus(has("root cause", "why is"), 3)
                       + bonus(has("explain why") & failing, 4) + bonus(has("why") & failing, 2)
                       + bonus(has("fix and explain", "fix and refactor", "debug and refactor", "diagnose and rewrite",
                                   "diagnose and refactor"), 2))
    scores["understand"] = scores["understand"] + bonus(has("how does", "what does"), 3)
    scores["refactor"] = scores["refactor"] + bonus(has("refactor and optimize", "rewrite for reuse"), 2)
    return scores


def weighted_intent(text: Column) -> Column:
    """Intent with the highest score; ties follow a fixed order and no evidence means understand."""
    scores = intent_scores(text)
    best = F.greatest(*[scores[i] for i in INTENT_ORDER])
    out = F.when(best <= 0, "understand")
    for intent in INTENT_ORDER:
        out = out.when(scores[intent] == best, intent)
    return out


def with_effective_label(nodes: DataFrame) -> DataFrame:
    """Attach node and block labels to logic nodes."""
    out = nodes.withColumn("node_label", node_label(F.col("node_type"), F.col("text")))
    return out.withColumn("block", cluster_label(F.col("node_label")))
