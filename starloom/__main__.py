"""Command line: generate, land, conform, model, demo, verify, ask, docs, reset and smoke. Counts are printed as JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from starloom import docs
from starloom.operators import checks as K
from starloom.operators import history as H
from starloom.plans.bank import QUESTIONS, Pipeline
from starloom.sources.extracts import integers
from starloom.sources.generator import BATCHES, Bank
from starloom.sources.store import Store, session


def verify(p: Pipeline) -> dict[str, dict[str, int]]:
    """Fault counts of every check that the specs imply, over the tables as stored."""
    t = p.tables()
    out: dict[str, dict[str, int]] = {}
    for name, spec in p.specs.items():
        if spec.layer == "bronze":
            continue
        key = [*spec.business_key, *["effective_from"] * (spec.history == "scd2")]
        out[name] = {"repeated": K.grain(t[name], key).first()["repeated"], "columns": len(K.column_faults(t[name], spec))}
        if spec.history == "scd2":
            out[name] |= K.ranges(t[name], list(spec.business_key)).first().asDict()
            out[name] |= K.idle_versions(t[name], list(spec.business_key), spec.tracked).first().asDict()
        if spec.absence_means_deletion:
            gone = H.snapshot_deletions(t[spec.source_spec], list(spec.business_key))
            out[name]["unexplained"] = K.current_rows(t[name], list(spec.business_key), gone).first()["unexplained"]
        if spec.relationships:
            targets = {r.column: "date_key" for r in spec.relationships if r.to.endswith("dim_date")}
            links = K.relationship_checks(spec, t[name], t.frames, targets).collect()
            out[name]["orphans"] = sum(r["orphan"] for r in links)
            if name in ("gold_fact_transaction", "gold_fact_daily_balance"):
                out[name]["missing"] = sum(r["missing"] for r in links)
        if spec.layer == "silver":
            out[name]["drift"] = len(p.store.drift(spec))
            out[name]["lost"] = K.keys_lost(t[spec.source_spec], t[name], list(spec.business_key)).first()["lost"]
    facts, balance, life, account = t["gold_fact_transaction"], t["gold_fact_daily_balance"], t["gold_fact_account_lifecycle"], t["gold_dim_account"]
    out["gold_fact_transaction"] |= {"outside": K.resolved_in_time(facts, t["gold_dim_party"], "party_sk", "txn_ts").first()["outside"], "lost": K.keys_lost(t["silver_transaction"], facts, ["txn_id"]).first()["lost"]}
    # Sums and counts of each account against the layer below, so that a movement that got lost shows.
    silver = t["silver_transaction"].select("account_id", "amount", F.when(F.col("txn_type") != "OPENING", 1).otherwise(0).alias("n"))
    moved = balance.select("account_id", F.col("movement").alias("amount"), F.col("txn_count").alias("n"))
    out["gold_fact_daily_balance"] |= {"unreconciled": K.reconcile(moved, silver, ["account_id"], ["amount", "n"]).count()} | K.outside_life(balance, account, "account_id", "open_date", "close_date").first().asDict()
    horizon = balance.agg(F.max("date_key")).first()[0]
    out["gold_fact_account_lifecycle"] |= K.milestones(life, ["opened_date_key", "first_txn_date_key", "last_txn_date_key", "closed_date_key"], F.lit(horizon)).first().asDict()
    return out


def populations(p: Pipeline) -> dict[str, int]:
    """How much of what the model is for is there: inferred members, facts on earlier versions, late and uncategorised ones, quiet days."""
    t = p.tables()
    facts = t["gold_fact_transaction"]
    unknown = t["gold_dim_merchant_category"].where("merchant_category_code = 'UNKNOWN'").select("merchant_category_sk")
    return {
        "inferred": t["gold_dim_account"].where("is_inferred").count(),
        "historic": K.resolved_in_time(facts, t["gold_dim_party"], "party_sk", "txn_ts").first()["historic"],
        "uncategorised": facts.join(unknown, "merchant_category_sk", "left_semi").count(),
        "versions": t["gold_dim_party"].count(),
    } | K.populations(facts, late=F.col("settlement_lag_days") > 0).first().asDict() | {"quiet": K.populations(t["gold_fact_daily_balance"], quiet=F.col("txn_count") == 0).first()["quiet"]}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="starloom", description=__doc__)
    parser.add_argument("command", choices=("generate", "land", "conform", "model", "demo", "verify", "ask", "docs", "reset", "smoke"))
    parser.add_argument("--raw", default="raw", help="folder of extracts")
    parser.add_argument("--root", default="store", help="folder of tables")
    parser.add_argument("--batch", action="append", help="batch to process; all by default")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--parties", type=int, default=2000)
    parser.add_argument("--now", default="2026-04-01 00:00:00", help="the clock of the run")
    parser.add_argument("--file", help="page with generated parts")
    parser.add_argument("--check", action="store_true", help="with docs: only say whether the page is current")
    a = parser.parse_args(args)
    batches = a.batch or list(BATCHES)
    if a.command == "generate":
        print(json.dumps(Bank(a.seed, a.parties).write(a.raw)))
        return 0
    spark = session()
    p = Pipeline(Store(spark, a.root), a.now)
    if a.command == "smoke":
        print(json.dumps({r["bucket"]: r["count"] for r in integers(spark, 1000, 7).groupBy("bucket").count().collect()}))
    elif a.command == "docs":
        current = docs.refresh(a.file, p.specs, a.check)
        print(json.dumps({"current": current}))
        return int(a.check and not current)
    elif a.command == "reset":
        for spec in p.specs.values():
            p.store.drop(spec)
            spark.sql(f"DROP TABLE IF EXISTS {spec.table}") if spark.catalog.databaseExists(spec.layer) else None
    elif a.command == "verify":
        found = verify(p)
        print(json.dumps({"faults": found, "populations": populations(p)}))
        return int(any(v for x in found.values() for v in x.values()))
    elif a.command == "ask":
        for name, question in QUESTIONS.items():
            print(name)
            question(p.tables()).show(truncate=False)
    else:
        counts: dict[str, dict[str, int]] = {}
        for batch in batches:
            if a.command in ("land", "demo"):
                p.land(a.raw, batch)
            if a.command in ("conform", "demo"):
                p.conform(batch)
            if a.command == "demo":
                counts[batch] = {n: df.count() for n, df in p.model().frames.items()} | populations(p)
        if a.command == "model":
            counts["model"] = {n: df.count() for n, df in p.model().frames.items()}
        print(json.dumps(counts or {"batches": batches}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
