"""The bank model end to end on generated extracts with planted defects."""

import itertools

import pytest
from pyspark.sql import functions as F

from starloom.operators import checks as K
from starloom.operators import history as H
from starloom.plans.bank import QUESTIONS, Pipeline
from starloom.sources.extracts import MissingColumns, read_extract
from starloom.sources.generator import BATCHES, Bank
from starloom.schema import stated_grain, struct
from starloom.sources.store import SchemaDrift, Store
from starloom.operators.clean import coerce
from starloom.streaming.batches import each_batch, land_and_rebuild


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    bank = Bank(seed=7, parties=30)
    defects = bank.write(root)
    assert all(defects.values()), defects
    return str(root)


def content(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def built(spark, raw, tmp_path_factory):
    p = Pipeline(Store(spark, str(tmp_path_factory.mktemp("store"))))
    inferred = []
    for batch in BATCHES:
        t = p.advance(raw, batch)
        new = t["gold_dim_account"].where("is_inferred").select("product_type", "status", "party_id").collect()
        assert {tuple(r) for r in new} <= {("UNKNOWN", "UNKNOWN", None)}
        inferred.append(len(new))
    return p, t, inferred


def test_generator_is_deterministic(tmp_path):
    Bank(seed=3, parties=10).write(tmp_path / "a")
    Bank(seed=3, parties=10).write(tmp_path / "b")
    files = sorted((tmp_path / "a").rglob("*.csv"))
    assert len(files) == 9 and all(f.read_bytes() == (tmp_path / "b" / f.relative_to(tmp_path / "a")).read_bytes() for f in files)


def test_extracts(spark, tmp_path):
    spec = Pipeline(Store(spark, str(tmp_path))).specs["bronze_party"]
    names = spec.columns
    (tmp_path / "x.csv").write_text(",".join(["consent", *reversed(names)]) + "\n" + ",".join(["Y", *[f"v_{n}" for n in reversed(names)]]) + "\n")
    got = read_extract(spark, spec, str(tmp_path / "x.csv"), "b1").first()
    assert all(got[n] == f"v_{n}" for n in names) and got["_rescued_data"] == '{"consent":"Y"}' and got["_batch_id"] == "b1"
    (tmp_path / "y.csv").write_text(",".join(names[1:]) + "\n")
    with pytest.raises(MissingColumns, match=names[0]):
        read_extract(spark, spec, str(tmp_path / "y.csv"), "b1")
    (tmp_path / "z.csv").write_text(",".join(names) + "\n" + "," * (len(names) - 1) + "\n")
    assert read_extract(spark, spec, str(tmp_path / "z.csv"), "b1").first()["_rescued_data"] is None


def test_layers(spark, built):
    p, t, inferred = built
    assert inferred[0] > 0 and inferred[-1] == 0
    bronze = p.store.read(p.specs["bronze_party"])
    assert [r[0] for r in K.batch_totals(bronze).collect()] == list(BATCHES)
    assert bronze.where("_rescued_data is not null").count() > 0
    silver = t["silver_party"]
    assert K.ranges(silver, ["party_id"]).first() == (0, 0, 0)
    assert K.idle_versions(silver, ["party_id"], p.specs["silver_party"].tracked).first()[0] == 0
    gone = H.snapshot_deletions(bronze, ["party_id"])
    assert gone.count() > 0 and K.current_rows(silver, ["party_id"], gone).first().unexplained == 0
    assert K.same_day_versions(silver, ["party_id"], "updated_at").first()[0] > 0
    for name in ("silver_account", "silver_transaction", "gold_dim_date", "gold_fact_transaction", "gold_fact_daily_balance", "gold_fact_account_lifecycle"):
        assert K.grain(t[name], list(p.specs[name].business_key)).first().repeated == 0
        assert K.column_faults(t[name], p.specs[name]) == []
    for name in ("gold_fact_transaction", "gold_fact_daily_balance", "gold_fact_account_lifecycle"):
        targets = {c: "date_key" for c in ("opened_date_key", "first_txn_date_key", "last_txn_date_key", "closed_date_key")}
        links = K.relationship_checks(p.specs[name], t[name], t.frames, targets).collect()
        assert len(links) == len(p.specs[name].relationships) and all(r.orphan == 0 for r in links)
    facts = t["gold_fact_transaction"]
    assert facts.count() == t["silver_transaction"].count()
    seen = K.resolved_in_time(facts, t["gold_dim_party"], "party_sk", "txn_ts").first()
    assert seen.outside == 0 and seen.historic > 0
    kinds = K.populations(facts, late=F.col("settlement_lag_days") > 0).first()
    assert kinds.late > 0
    assert {"UNKNOWN", "NOT_APPLICABLE"} <= {r[0] for r in t["gold_dim_merchant_category"].select("merchant_category_code").collect()}
    account = t["gold_dim_account"]
    assert K.outside_life(t["gold_fact_daily_balance"], account, "account_id", "open_date", "close_date").first() == (0, 0)


def test_replaying_a_batch_changes_nothing(spark, raw, built):
    p, t, _ = built
    before = {n: content(df) for n, df in t.frames.items()}
    again = p.advance(raw, BATCHES[1])
    assert {n: content(df) for n, df in again.frames.items()} == before
    assert p.store.vacuum(p.specs["gold_dim_date"]) > 0 and content(p.store.read(p.specs["gold_dim_date"])) == before["gold_dim_date"]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[1::2])
def test_any_order_of_landing_converges(spark, raw, built, tmp_path, order):
    p, t, _ = built
    spec, bronze = p.specs["silver_party"], p.specs["bronze_party"]
    other = Pipeline(Store(spark, str(tmp_path)))
    for i in order:
        other.store.replace_batch(read_extract(spark, bronze, f"{raw}/{BATCHES[i]}/party.csv", BATCHES[i]), bronze, BATCHES[i])
        landed = coerce(other.store.read(bronze), spec, "_batch_id")
        other.store.publish(H.advance(other.store.read(spec), landed, spec, BATCHES[i]), spec)
    assert content(other.store.read(spec)) == content(t["silver_party"]) == content(H.rebuild_all(landed, spec).select(*t["silver_party"].columns))


def test_questions(spark, built):
    p, t, _ = built
    for spec in p.specs.values():
        if spec.layer == "gold":
            p.store.register(spec)
    for question in QUESTIONS.values():
        assert question(p.tables()).count() > 0
    total = spark.sql("SELECT segment, sum(abs(amount)) AS spent FROM gold.fact_transaction JOIN gold.dim_party USING (party_sk) WHERE txn_type = 'DEBIT' GROUP BY ALL")
    got = {r["segment"]: int(r["total_spend"]) for r in QUESTIONS["spend_by_segment_at_the_time"](t).collect()}
    assert got == {r["segment"]: round(r["spent"]) for r in total.collect()}
    for spec in p.specs.values():
        if spec.layer == "gold":
            spark.sql(f"DROP TABLE IF EXISTS {spec.table}")


def test_landing_replaces_a_batch_also_by_nothing(spark, tmp_path):
    store, spec = Store(spark, str(tmp_path)), Pipeline(Store(spark, str(tmp_path))).specs["bronze_account"]
    rows = lambda n, b: spark.range(n).select(*[F.col("id").cast("string").alias(c) for c in spec.columns], F.lit("2026-01-01").cast("timestamp").alias("_ingest_ts"), F.lit("f").alias("_source_file"), F.lit(b).alias("_batch_id"), F.lit(None).cast("string").alias("_rescued_data"))
    counts = lambda: dict(map(tuple, K.batch_totals(store.read(spec)).collect()))
    store.replace_batch(rows(0, "b 1/2"), spec, "b 1/2")
    assert store.read(spec).count() == 0
    for n in (3, 2):
        store.replace_batch(rows(n, "b 1/2"), spec, "b 1/2")
        store.replace_batch(rows(4, "2026-01-15"), spec, "2026-01-15")
    assert counts() == {"b 1/2": 2, "2026-01-15": 4}
    store.replace_batch(rows(0, "b 1/2"), spec, "b 1/2")
    assert counts() == {"2026-01-15": 4} and store.drift(spec) == []


def test_drifted_tables_refuse_to_load(spark, raw, tmp_path):
    p = Pipeline(Store(spark, str(tmp_path)))
    spec = p.specs["bronze_party"]
    p.land(raw, BATCHES[0])
    old = p.store.read(spec)
    old.withColumn("colour", F.lit("red")).drop("suburb").write.partitionBy("_batch_id").parquet(f"{tmp_path}/bronze/party/v=1")
    p.store._point(spec, 1)
    with pytest.raises(SchemaDrift, match="missing column suburb; undeclared column colour"):
        p.land(raw, BATCHES[1])
    with pytest.raises(SchemaDrift):
        p.store.append(old, spec)


def test_append_and_catalog(spark, tmp_path):
    store, spec = Store(spark, str(tmp_path)), Pipeline(Store(spark, str(tmp_path))).specs["gold_dim_merchant_category"]
    row = spark.createDataFrame([], struct(spec))
    row = spark.range(1).select(*[F.lit("2026-01-01").cast(f.dataType).alias(f.name) for f in row.schema])
    store.append(row, spec)
    store.append(row, spec)
    assert store.read(spec).count() == 2
    assert store.ensure_table(spec) == store.ensure_table(spec) == "gold.dim_merchant_category"
    assert spark.table(spec.table).count() == 2 and stated_grain(spark, spec) == spec.grain
    spark.sql(f"ALTER TABLE {spec.table} SET TBLPROPERTIES ('starloom.sequence_by' = 'other')")
    with pytest.raises(SchemaDrift, match="sequence_by"):
        store.ensure_table(spec)
    spark.sql(f"DROP TABLE {spec.table}")


def test_verification_finds_faults(spark, built, tmp_path):
    """Faults planted in copies of the gold tables are counted, each by its own check."""
    from starloom.__main__ import verify

    t = built[0].tables()
    q = Pipeline(Store(spark, str(tmp_path)))
    for name, spec in q.specs.items():
        df = t[name]
        if name == "gold_fact_daily_balance":
            df = df.withColumns({"movement": F.when(F.col("txn_count") > 0, F.col("movement") + 1).otherwise(F.col("movement")).cast("decimal(18,2)")})
        elif name == "gold_fact_account_lifecycle":
            df = df.withColumn("last_txn_date_key", F.col("first_txn_date_key") - 1)
        elif name == "gold_fact_transaction":
            df = df.withColumns({"txn_ts": F.lit("2200-01-01").cast("timestamp"), "account_sk": F.lit(None).cast("string")}).where("txn_type <> 'OPENING'")
        elif name == "silver_account":
            df = df.limit(df.count() - 1)
        if spec.layer == "bronze":
            df.write.partitionBy("_batch_id").parquet(f"{tmp_path}/bronze/{spec.entity}/v=0")
            q.store._point(spec, 0)
        else:
            q.store.publish(df, spec)
    found = verify(q)
    assert found["gold_fact_daily_balance"]["unreconciled"] > 0 and found["gold_fact_account_lifecycle"]["disordered"] > 0
    assert found["gold_fact_transaction"]["outside"] > 0 and found["gold_fact_transaction"]["missing"] > 0 and found["gold_fact_transaction"]["lost"] > 0
    assert found["silver_account"]["lost"] == 1


def test_unknown_and_inferred_members(built):
    _, t, _ = built
    unknown = t["gold_dim_party"].where("is_placeholder").first()
    assert {unknown[c] for c in ("party_id", "full_name", "address_line", "suburb", "state", "postcode", "risk_rating", "segment")} == {"UNKNOWN"}


def test_micro_batches(spark, raw, built, tmp_path):
    p, t, _ = built
    bronze, silver = p.specs["bronze_party"], p.specs["silver_party"]
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(", ".join(f"{c} string" for c in bronze.columns)).option("header", True).option("maxFilesPerTrigger", 1).csv(f"{raw}/2026-0[12]-15/party.csv")
    each_batch(stream, land_and_rebuild(store, bronze, silver), str(tmp_path / "checkpoint")).awaitTermination()
    every = coerce(p.store.read(bronze).where("_batch_id < '2026-03'"), silver)
    assert content(store.read(silver)) == content(H.rebuild_timeline(every, silver))


def test_command_line(spark, built, tmp_path, capsys):
    from starloom.__main__ import main, verify

    p, _, _ = built
    assert not [v for x in verify(p).values() for v in x.values() if v]
    assert main(["generate", "--raw", str(tmp_path / "raw"), "--parties", "12"]) == 0
    root = ["--raw", str(tmp_path / "raw"), "--root", str(tmp_path / "store"), "--batch", BATCHES[0]]
    for command in ("land", "conform", "model", "verify", "smoke"):
        assert main([command, *root]) == 0
    assert '"gold_fact_transaction"' in capsys.readouterr().out
    assert main(["reset", *root]) == 0
    assert p.store.version(p.specs["silver_party"]) is not None
    assert Store(spark, str(tmp_path / "store")).version(p.specs["silver_party"]) is None
