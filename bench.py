"""Headline queries on local[$BENCH_CPUS], each timed to a noop write after a warm run.

Prints one JSON line. `ingest` is the one-off cost of building the ledger, `train_gradient_boosting` that of one model;
neither has a warm run. `blended_risk` scores with models that its first run trained.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerloom.operators import rules  # noqa: E402
from ledgerloom.operators.features import build_features  # noqa: E402
from ledgerloom.plans import learning_queries, load  # noqa: E402
from ledgerloom.plans.registry import QUERIES  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402
from ledgerloom.sources.ledger import ledger  # noqa: E402

NAMED = [
    "monthly_income_expenses",
    "monthly_summary",
    "category_breakdown",
    "budget_status",
    "recurring_payments",
    "financial_health",
    "forecast_next_month",
    "explorer_totals",
    "balance_drain_pairs",
    "duplicate_charges",
    "spend_spikes",
    "top_risk",
    "metrics_by_model",
    "archetype_recall",
    "cohort_recall",
    "temporal_stability",
    "calibration_curve",
    "running_balances",
    "session_totals",
    "trailing_request_count",
    "similar_vectors",
    "similar_transactions",
    "blended_risk",
    "stream_daily_windows",
]


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory=os.environ.get("BENCH_MEMORY", "12g"))
    load()
    started = time.perf_counter()
    rows = ledger(spark, sf_dir).count()
    ingest = time.perf_counter() - started
    times = {} if only else {"ingest": round(ingest, 3)}
    jobs = {
        "rule_risk_flags": lambda: rules.rule_risk_flags(ledger(spark, sf_dir)),
        "features": lambda: build_features(ledger(spark, sf_dir)),
        **{name: (lambda name=name: QUERIES[name](spark, sf_dir)) for name in NAMED},
    }
    if not only or "train_gradient_boosting" in only:
        started = time.perf_counter()
        learning_queries.model(spark, sf_dir, "gradient_boosting")
        times["train_gradient_boosting"] = round(time.perf_counter() - started, 3)
    for name, job in jobs.items():
        if only and name not in only:
            continue
        noop(job())
        started = time.perf_counter()
        noop(job())
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "ingest": round(ingest, 3),
                "ledger_rows": rows,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
