"""The bank model from extracts to star schema. Every build step is a pure function of frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.columns import category_code, date_key, unknown_key
from starloom.operators import dimensions as D
from starloom.operators import facts as X
from starloom.operators import history as H
from starloom.operators.clean import coerce, deduplicate
from starloom.operators.upsert import upsert_latest
from starloom.schema import columns, require
from starloom.sources.extracts import batch_of, read_extract
from starloom.sources.store import Store
from starloom.spec import Spec, bank_model

def _real() -> Column:
    """Opening entries set a balance; they are no activity."""
    return F.col("txn_type") != "OPENING"


@dataclass(frozen=True)
class Tables:
    """Frames by table name, built or read."""

    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def plus(self, name: str, df: DataFrame) -> Tables:
        return Tables(self.frames | {name: df})


def dim_party(t: Tables, now: Column) -> DataFrame:
    return D.versioned_dimension(t["silver_party"], "party_sk", ["party_id"], now)


def dim_account(t: Tables, now: Column) -> DataFrame:
    rows = D.keyed_dimension(t["silver_account"], "account_sk", ["account_id"], t["silver_transaction"], ("product_type", "status"))
    return rows.withColumn("updated_at", F.coalesce("updated_at", now))


def _categorised(t: Tables) -> DataFrame:
    """Transactions with their account's product and category code; the account side holds one row a key."""
    product = t["silver_account"].select("account_id", "product_type")
    code = category_code(F.col("merchant_category"), F.col("txn_type"), F.col("product_type"))
    return t["silver_transaction"].join(product, "account_id", "left").withColumn("merchant_category_code", code)


def dim_merchant_category(t: Tables, now: Column) -> DataFrame:
    return D.category_dimension(_categorised(t), "merchant_category_code", "merchant_category_sk", "merchant_category_name").withColumn("updated_at", now)


def dim_date(t: Tables, now: Column) -> DataFrame:
    span = D.bounds((t["silver_transaction"], "txn_ts", "posted_ts"), (t["silver_account"], "open_date", "close_date"))
    return D.date_dimension(span).withColumn("updated_at", now)


def fact_transaction(t: Tables, now: Column) -> DataFrame:
    """Members as they were when the transaction happened; the party is that of the account's present owner."""
    account = t["gold_dim_account"].select("account_id", "account_sk", F.col("party_id").alias("owner"))
    known = _categorised(t).join(account, "account_id", "left")
    dated = X.asof_join(known, t["gold_dim_party"], {"owner": "party_id"}, "txn_ts", ["party_sk"])
    coded = dated.join(t["gold_dim_merchant_category"].select("merchant_category_code", "merchant_category_sk"), "merchant_category_code", "left")
    return coded.select("txn_id", F.coalesce("party_sk", unknown_key()).alias("party_sk"), "account_sk", "merchant_category_sk", date_key(F.to_date("txn_ts")).alias("date_key"), "txn_ts", "posted_ts", F.datediff("posted_ts", "txn_ts").alias("settlement_lag_days"), "amount", "currency", "txn_type")


def fact_daily_balance(t: Tables, now: Column) -> DataFrame:
    span = D.bounds((t["silver_transaction"], "txn_ts", "posted_ts"))
    account = t["gold_dim_account"].select("account_sk", "account_id", "open_date", "close_date")
    spine = X.date_spine(account, span, "open_date", "close_date").select("account_sk", "account_id", date_key("full_date").alias("date_key"))
    moved = X.daily_movements(t["silver_transaction"], "account_id", "txn_ts", "amount", _real())
    return X.periodic_snapshot(spine, moved, "account_id").withColumn("updated_at", now)


def fact_account_lifecycle(t: Tables, now: Column) -> DataFrame:
    account = t["gold_dim_account"].where(~F.col("is_inferred")).select("account_sk", "account_id", "open_date", "close_date", F.col("status").alias("current_status"))
    return X.accumulating_snapshot(account, t["silver_transaction"], "account_id", "txn_ts", "amount", _real(), "open_date", "close_date", F.to_date(now)).withColumn("updated_at", now)


#: Gold tables in the order of what they need.
BUILDERS: dict[str, Callable[[Tables, Column], DataFrame]] = {
    "gold_dim_party": dim_party,
    "gold_dim_account": dim_account,
    "gold_dim_merchant_category": dim_merchant_category,
    "gold_dim_date": dim_date,
    "gold_fact_transaction": fact_transaction,
    "gold_fact_daily_balance": fact_daily_balance,
    "gold_fact_account_lifecycle": fact_account_lifecycle,
}


@dataclass(frozen=True)
class Pipeline:
    """The model over a store. ``now`` stands for the clock in every table, so reruns agree."""

    store: Store
    now: str = "2026-04-01 00:00:00"
    specs: dict[str, Spec] = field(default_factory=bank_model)

    @property
    def _now(self) -> Column:
        return F.lit(self.now).cast("timestamp")

    def land(self, root: str, batch_id: str) -> None:
        """Bronze: replace one batch of every source with what ``root/<batch>/<entity>.csv`` holds; refused by a table that has drifted."""
        for spec in self.specs.values():
            if spec.layer == "bronze":
                rows = read_extract(self.store.spark, spec, f"{root}/{batch_id}/{spec.source_file}.csv", batch_id, self._now)
                self.store.replace_batch(rows, spec, batch_id)

    def conform(self, batch_id: str, most_deleted: float = H.MOST_DELETED) -> None:
        """Silver: bring one landed batch into the typed tables, each published once."""
        for spec in self.specs.values():
            if spec.layer != "silver":
                continue
            bronze = self.store.read(self.specs[spec.source_spec])
            incoming = coerce(batch_of(bronze, batch_id), spec)
            stored = self.store.ensure(spec).read(spec)
            if spec.history == "scd2":
                H.refuse_empty(incoming, spec)
                landed = coerce(bronze, spec, "_batch_id")
                if spec.absence_means_deletion and not stored.isEmpty():
                    H.guard_deletions(stored, H.snapshot_deletions(landed, list(spec.business_key)), list(spec.business_key), most_deleted)
                result = H.advance(stored, landed, spec, batch_id)
            else:
                result = upsert_latest(stored, deduplicate(incoming, spec), list(spec.business_key), spec.sequence_by)
            self.store.publish(result, spec)

    def model(self) -> Tables:
        """Gold: rebuild every table from silver in order of need, publish each, and return all frames."""
        t = Tables({n: self.store.read(s) for n, s in self.specs.items() if s.layer == "silver"})
        for name, build in BUILDERS.items():
            spec = self.specs[name]
            t = t.plus(name, self.store.publish(require(_ordered(build(t, self._now), spec), spec), spec))
        return t

    def tables(self) -> Tables:
        """All tables as stored."""
        return Tables({n: self.store.read(s) for n, s in self.specs.items()})

    def advance(self, root: str, batch_id: str) -> Tables:
        """All layers for one batch."""
        self.land(root, batch_id)
        self.conform(batch_id)
        return self.model()


def _ordered(df: DataFrame, spec: Spec) -> DataFrame:
    return df.select(*[F.col(a.name).cast(a.data_type).alias(a.name) for a in columns(spec)])


def _spend(t: Tables, dim: str, key: str, by: str) -> DataFrame:
    """Number and absolute sum of debits by an attribute of a dimension, largest first."""
    debits = t["gold_fact_transaction"].where("txn_type = 'DEBIT'").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("amount")).alias("spent"))
    named = debits.join(t[dim].select(key, by), key).groupBy(by).agg(F.sum("n").alias("txns"), F.round(F.sum("spent"), 0).alias("total_spend"))
    return named.orderBy(F.desc("total_spend"), by)


def spend_by_category(t: Tables) -> DataFrame:
    """The five merchant categories with the largest spend; debits are summed by key before the join."""
    return _spend(t, "gold_dim_merchant_category", "merchant_category_sk", "merchant_category_name").limit(5)


def spend_by_segment_at_the_time(t: Tables) -> DataFrame:
    """Spend by the segment that each customer was in when spending."""
    return _spend(t, "gold_dim_party", "party_sk", "segment")


def latest_balance_by_product(t: Tables) -> DataFrame:
    """Accounts and mean closing balance of each product on the last day of the snapshot."""
    balance = t["gold_fact_daily_balance"]
    last = balance.join(F.broadcast(balance.agg(F.max("date_key").alias("date_key"))), "date_key")
    by_product = last.join(t["gold_dim_account"].select("account_sk", "product_type"), "account_sk").groupBy("product_type")
    return by_product.agg(F.count(F.lit(1)).alias("accounts"), F.round(F.avg("closing_balance"), 0).alias("avg_balance")).orderBy(F.desc("avg_balance"), "product_type")


def closed_accounts_tenure(t: Tables) -> DataFrame:
    """How many accounts of each product closed, after how many days and transactions on average."""
    closed = t["gold_fact_account_lifecycle"].where("closed_date_key is not null")
    by_product = closed.join(t["gold_dim_account"].select("account_sk", "product_type"), "account_sk").groupBy("product_type")
    means = [F.round(F.avg(c)).alias(n) for c, n in (("days_open", "avg_days_open"), ("txn_count", "avg_txns"))]
    return by_product.agg(F.count(F.lit(1)).alias("closed_accounts"), *means).orderBy(F.desc("closed_accounts"), "product_type")


#: Business questions over the gold tables.
QUESTIONS: dict[str, Callable[[Tables], DataFrame]] = {f.__name__: f for f in (spend_by_category, latest_balance_by_product, spend_by_segment_at_the_time, closed_accounts_tenure)}
