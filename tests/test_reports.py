"""Route report, experiment rates and the leading fixture against plain loops."""

import random
from collections import defaultdict

from graphloom.operators import outcomes as oc, quality as ql

EPS = ql.EPSILON


def fixture_rows(seed):
    rng = random.Random(seed)
    rows = []
    for suite in ("a", "b"):
        for run in sorted(rng.sample(range(9000), 14)):
            quiet = rng.random() < 0.4
            for fixture in "xyz":
                if rng.random() < 0.85:
                    rates = [0.0 if quiet else rng.choice([0.0, 0.25, 0.5, None]) for _ in ql.FIXTURE_MODES]
                    rows.append((suite, run, fixture, rng.choice([0, 1, 3]), *rates))
    return rows


def leaders(rows, n=3):
    entries = defaultdict(dict)
    for suite, run, fixture, cases, *rates in rows:
        entries[suite].setdefault(run, {})
        if cases:
            rate, at = max(((r or 0.0), i) for i, r in enumerate(rates))
            entries[suite][run][fixture] = (rate, ql.FIXTURE_MODES[at]) if rate > EPS else (0.0, None)
    out = []
    for suite, by_run in entries.items():
        order = sorted(by_run)
        for i, run in enumerate(order):
            past = order[max(0, i - n):i]
            now = {f: e for f, e in by_run[run].items() if e[1]}
            if now:
                f = min(now, key=lambda f: (-now[f][0], f))
                before = [by_run[p][f][0] for p in past if f in by_run[p]]
                trail = sum(before) / len(before) if before else 0.0
                d = (now[f][0] - trail) * 100
                trend = "new" if trail <= EPS else "worsening" if d > 1 else "improving" if d < -1 else "flat"
                out.append((suite, run, f, now[f][1], round(now[f][0], 6), trend, round(d, 6)))
            else:
                old = [(by_run[p][f][0], i - k, f, by_run[p][f][1]) for k, p in enumerate(order) if p in past for f in by_run[p] if by_run[p][f][0] > ql.REPORTED_RATE]
                if old:
                    rate, _, f, mode = max(old)
                    out.append((suite, run, f, mode, 0.0, "cleared", round(-rate * 100, 6)))
    return sorted(out)


def test_leading_fixture_equals_loops(spark):
    schema = "suite string, run_id long, fixture string, mutation_case_count long, " + ", ".join(f"{m}_rate double" for m in ql.FIXTURE_MODES)
    seen = set()
    for seed in range(3):
        rows = fixture_rows(seed)
        got = ql.leading_fixture(spark.createDataFrame(rows, schema)).select("suite", "run_id", "fixture", "mode", "rate", "trend", "delta_points").collect()
        assert sorted(map(tuple, got)) == leaders(rows)
        seen |= {r.trend for r in got}
    assert seen == {"new", "worsening", "improving", "flat", "cleared"}
    assert ql.leading_fixture(spark.createDataFrame([], schema)).count() == 0


def test_route_report_with_nulls_and_missing_intents(spark):
    flags = [f for f in dict.fromkeys([*oc.CASE_FLAGS, *oc.MUTATION_FLAGS]) if f not in ("exact_ready", "blocked")]
    schema = "intent string, bundle_status string, state string, latency_ms double, approx_tokens long, " + ", ".join(f"{f} boolean" for f in flags)
    rows = [("implement", "exact_ready", "blocked", 1.0, 10, *[True] * len(flags)), ("refactor", "partial", None, 9.0, 20, *[None] * len(flags)),
            ("debug", "exact_ready", "blocked", 0.25, 30, *[True] * len(flags)), (None, None, None, 0.5, 40, *[False] * len(flags)),
            ("", "exact_ready", "ready", 0.75, 5, *[False] * len(flags))]
    got = {r.scope: r for r in oc.route_report(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"overall", "implement", "refactor", "debug"}
    whole = got["overall"]
    assert (whole.case_count, whole.mutation_case_count, whole.max_tokens, whole.avg_tokens) == (5, 2, 40, 21.0)
    assert (whole.high_confidence_rate, whole.mutation_high_confidence_rate, whole.mutation_exact_ready_rate, whole.mutation_blocked_rate) == (0.4, 0.5, 0.5, 0.5)
    assert (got["debug"].intent_match_rate, got["debug"].mutation_exact_ready_rate, got["debug"].p95_latency_ms) == (1.0, 0.0, 0.25)
    assert got["refactor"].mutation_ready_rate == 0.0 and whole.p95_latency_ms == 9.0


def test_experiment_rates(spark):
    schema = ("suite string, tokens_without long, tokens_with long, file_mentions long, impacted_files long, hits_without long, hits_with long, terms_found long, "
              "terms_expected long, retrieval_ms long, executed boolean, validated boolean, tests_passed boolean, target_match boolean, heavy_first boolean, "
              "escalated boolean, escalation_skipped boolean, trimmed boolean")
    rows = [("s", 100, 130, 9, 0, 2, 3, 3, 4, 7, True, True, False, True, None, False, False, True),
            ("s", 100, 120, 1, 2, 1, 0, 0, 2, 8, False, True, False, False, True, False, True, None),
            ("none", 0, 5, 0, 0, 0, 2, 0, 0, 1, True, None, True, True, False, True, False, False)]
    got = {r.suite: r for r in oc.experiment_rates(spark.createDataFrame(rows, schema)).collect()}
    s, none = got["s"], got["none"]
    assert (s.success_without_pct, s.success_with_pct, s.validated_success_pct, s.validated_pct, s.heavy_first_pct) == (50.0, 50.0, 50.0, 100.0, 50.0)
    assert (s.context_coverage_pct, s.avg_retrieval_ms, s.misdirection_pct, s.savings_pct) == (50.0, 7, 50.0, -25.0)
    assert (s.step_savings_pct, s.regression_alert) == (25.0, False)  # 12 steps without, 9 with
    assert (none.savings_pct, none.context_coverage_pct, none.validated_pct, none.regression_alert) == (0.0, 0.0, 0.0, False)
