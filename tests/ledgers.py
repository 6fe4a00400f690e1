"""Small ledgers written out by hand or drawn at random."""

import datetime

import numpy as np

from ledgerloom.sources.ledger import LEDGER

BASE = dict(
    type="SHOP", amount=10.0, nameOrig="A", oldbalanceOrg=0.0, newbalanceOrig=0.0, nameDest="M1", oldbalanceDest=0.0,
    newbalanceDest=0.0, merchant="M1", category="dining", is_focal_user=True, isFraud=0, isFlaggedFraud=0, is_anomaly=0,
    anomaly_type="", persona_id="A", persona_archetype="retiree", account_type="checking", merchant_region="R00_portland",
    transaction_region="R00_portland", home_region="R00_portland", category_group="discretionary", subcategory="restaurants",
    fraud_archetype="", simulation_year=2025,
)


def ledger(spark, rows):
    out = []
    for i, r in enumerate(sorted(rows, key=lambda r: r["step"])):
        moment = datetime.datetime(2025, 1, 1) + datetime.timedelta(hours=int(r["step"]))
        full = {**BASE, "row_id": i, "datetime": moment.strftime("%Y-%m-%dT%H:%M"), "date": moment.strftime("%Y-%m-%d"), "label_reported_at_step": r["step"], **r}
        out.append(tuple(full[f.name] for f in LEDGER.fields))
    return spark.createDataFrame(out, LEDGER)


def random_rows(seed, n, accounts=6, steps=200, hot_share=0.0):
    rng = np.random.default_rng(seed)
    types = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "SALARY", "SHOP", "SUBSCRIPTION", "TRANSFER"]
    rows = []
    for _ in range(n):
        k = 0 if rng.random() < hot_share else int(rng.integers(accounts))
        kind = str(rng.choice(types))
        amount = float(rng.integers(1, 40)) * 50.0
        old = amount * float(rng.integers(1, 5))
        rows.append(
            dict(
                step=int(rng.integers(steps)), type=kind, amount=amount, nameOrig=f"U{k}", persona_id=f"U{k}",
                oldbalanceOrg=old, newbalanceOrig=old + amount if kind in ("SALARY", "CASH_IN") else old - amount,
                nameDest=f"U{rng.integers(accounts)}" if kind == "TRANSFER" else f"M{rng.integers(4)}",
                merchant=f"M{rng.integers(4)}", category=str(rng.choice(["dining", "groceries", "transfer", "savings"])),
                is_focal_user=bool(rng.random() < 0.7), isFraud=int(rng.random() < 0.1),
            )
        )
    return rows
