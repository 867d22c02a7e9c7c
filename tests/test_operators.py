import itertools
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from starloom.functions.columns import category_code, date_key, fingerprint, surrogate_key
from starloom.operators import checks as K
from starloom.operators import dimensions as D
from starloom.operators import facts as X
from starloom.operators import history as H
from starloom.operators.clean import coerce, deduplicate, latest_rows
from starloom.operators.upsert import close_versions, merge, require_unique, upsert_latest
from starloom.spec import bank_model, parse

START, END = dt(1900, 1, 1), dt(9999, 12, 31, 23, 59, 59)
SHAPE = "k string, addr string, at timestamp_ntz, name string"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def line(spark, data):
    history = spark.createDataFrame([(*x, "n")[:4] if len(x) < 4 else x for x in data], SHAPE)
    return rows(H.timeline(history, ["k"], "at", ["addr"]).select("k", "addr", "name", "effective_from", "effective_to", "is_current"), "k", "effective_from")


def day(d, h=0, m=0):
    return dt(2026, 1, d, h, m)


def test_two_changes_in_one_day(spark):
    got = line(spark, [("p", "a", day(1, 9)), ("p", "b", day(1, 11, 15)), ("p", "c", day(1, 16, 45))])
    assert [(r[1], r[3], r[4], r[5]) for r in got] == [("a", START, day(1, 11, 15), False), ("b", day(1, 11, 15), day(1, 16, 45), False), ("c", day(1, 16, 45), END, True)]


def test_single_row_spans_all_time(spark):
    assert line(spark, [("p", "a", day(3))]) == [("p", "a", "n", START, END, True)]


def test_order_of_arrival_does_not_matter(spark):
    data = [("p", "a", day(1)), ("p", "b", day(2)), ("p", "a", day(3))]
    assert len({str(line(spark, x)) for x in itertools.permutations(data)}) == 1


def test_untracked_change_opens_nothing(spark):
    assert line(spark, [("p", "a", day(1), "old"), ("p", "a", day(2), "new")]) == [("p", "a", "old", START, END, True)]


def test_duplicates_nulls_and_ties(spark):
    assert len(line(spark, [("p", "a", day(1)), ("p", "a", day(1))])) == 1
    got = line(spark, [("p", None, day(1)), ("p", "", day(2)), ("p", None, day(3))])
    assert [r[1] for r in got] == [None, "", None]
    assert [r[1] for r in line(spark, [("p", "b", day(1)), ("p", "a", day(1))])] == ["a"]
    assert [r[1] for r in line(spark, [("p", "a", None), ("p", "b", day(1))])] == ["a", "b"]
    assert line(spark, []) == []


def test_a_row_between_revives_a_pruned_one(spark):
    early = [("p", "x", day(1)), ("p", "x", day(20))]
    assert len(line(spark, early)) == 1
    assert [r[1] for r in line(spark, [*early, ("p", "y", day(10))])] == ["x", "y", "x"]


def test_composite_key(spark):
    df = spark.createDataFrame([("a", 1, "x", day(1)), ("a", 2, "x", day(2)), ("a", 1, "y", day(3))], "k1 string, k2 int, v string, at timestamp_ntz")
    got = H.timeline(df, ["k1", "k2"], "at", ["v"])
    assert rows(got.groupBy("k2").count()) == [(1, 2), (2, 1)]


def landed(spark, pairs):
    return spark.createDataFrame(pairs, "k string, _batch_id string")


def test_deletions(spark):
    b1, b2, b3 = "2026-01-15", "2026-02-15", "2026-03-15"
    gone = H.snapshot_deletions(landed(spark, [("g", b1), ("s", b1), ("s", b2), ("s", b3)]), ["k"])
    assert rows(gone) == [("g", dt(2026, 2, 15))]
    flicker = H.snapshot_deletions(landed(spark, [("f", b1), ("s", b1), ("s", b2), ("s", b3), ("f", b3)]), ["k"])
    assert rows(flicker) == [] and rows(H.snapshot_deletions(landed(spark, [("a", b1), ("b", b1)]), ["k"])) == []


def versions(spark, *data):
    return spark.createDataFrame([(k, a, s, e, c) for k, a, s, e, c in data], "k string, addr string, effective_from timestamp_ntz, effective_to timestamp_ntz, is_current boolean")


def test_closures(spark):
    have = versions(spark, ("p1", "a", START, END, True), ("p2", "a", START, day(20), False), ("p2", "b", day(20), END, True), ("p3", "a", START, END, True))
    gone = spark.createDataFrame([("p1", day(10)), ("p2", day(10)), ("p9", day(10))], "k string, deleted_ts timestamp_ntz")
    assert rows(H.closure_split(have, gone, ["k"])) == [(1, 1)]
    got = rows(close_versions(have, gone, ["k"]), "k", "effective_from")
    assert got == [("p1", "a", START, day(10), False), ("p2", "a", START, day(20), False), ("p2", "b", day(20), END, True), ("p3", "a", START, END, True)]


def test_guards(spark):
    spec = bank_model()["silver_party"]
    empty = spark.createDataFrame([], "party_id string")
    with pytest.raises(H.EmptySnapshot):
        H.refuse_empty(empty, spec)
    assert H.refuse_empty(empty, bank_model()["silver_account"]) is empty
    have = versions(spark, *[(f"p{i}", "a", START, END, True) for i in range(10)])
    gone = spark.createDataFrame([("p1", day(10)), ("p2", day(10))], "k string, deleted_ts timestamp_ntz")
    with pytest.raises(H.MassDeletion):
        H.guard_deletions(have, gone, ["k"])
    assert H.guard_deletions(have, gone, ["k"], most=0.2, only_new=True) == 0.2


def test_upsert(spark):
    shape = "k int, at int, v string"
    target = spark.createDataFrame([(1, 5, "t"), (2, 5, "t"), (3, 5, "t"), (4, None, "t")], shape)
    source = spark.createDataFrame([(1, 6, "s"), (2, 5, "s"), (3, None, "s"), (4, 1, "s"), (5, None, "s")], shape)
    assert rows(upsert_latest(target, source, ["k"], "at")) == [(1, 6, "s"), (2, 5, "t"), (3, 5, "t"), (4, None, "t"), (5, None, "s")]
    assert rows(upsert_latest(target.limit(0), source, ["k"], "at"), "k") == rows(source, "k")
    assert rows(merge(target, source, ["k"], insert=False)) == rows(target)
    with pytest.raises(Exception, match="several source rows"):
        require_unique(source.union(source), ["k"]).collect()
    assert require_unique(source, ["k"]).count() == 5


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 2, "z"), (1, 2, "a"), (2, None, "x"), (None, 1, "n"), (None, 2, "m")], "k int, at int, rank_in_key string")
    assert rows(latest_rows(df, ["k"], "at")) == [(None, 2, "m"), (1, 2, "a"), (2, None, "x")]
    spec = parse({"name": "silver_t", "layer": "silver", "kind": "entity", "grain": "A thing in its latest state.", "business_key": ["k"], "history": {"type": "scd1", "sequence_by": "at"}, "attributes": [{"name": "k", "type": "int"}, {"name": "at", "type": "date"}, {"name": "m", "type": "decimal(18,2)"}]})
    text = spark.createDataFrame([("1", "2026-01-02", "1.005"), ("1", "2026-01-03", "x"), ("y", "?", None)], "k string, at string, m string")
    assert [(r.k, str(r.at), r.m) for r in deduplicate(coerce(text, spec), spec).orderBy("k").collect()] == [(None, "None", None), (1, "2026-01-03", None)]


def test_expressions(spark):
    df = spark.createDataFrame([("FUEL", "DEBIT", "SAVINGS"), ("", "DEBIT", "SAVINGS"), (None, "DEBIT", None), (None, "DEBIT", "HOME_LOAN"), ("", "CREDIT", "SAVINGS")], "c string, t string, p string")
    assert [r[0] for r in df.select(category_code(F.col("c"), F.col("t"), F.col("p"))).collect()] == ["FUEL", "UNKNOWN", "UNKNOWN", "NOT_APPLICABLE", "NOT_APPLICABLE"]
    pairs = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")], "x string, y string")
    assert pairs.select(fingerprint("x", "y")).distinct().count() == 4
    assert pairs.select(surrogate_key("x", "y")).distinct().count() == 4
    assert spark.sql("select date'2026-02-03' d").select(date_key("d")).first()[0] == 20260203


def test_members(spark):
    dim = spark.createDataFrame([("a1", "OPEN")], "account_id string, status string")
    facts = spark.createDataFrame([("a1",), ("a2",), ("a2",), (None,)], "account_id string")
    got = D.keyed_dimension(dim, "sk", ["account_id"], facts)
    assert rows(got.select("account_id", "status", "is_inferred")) == [("a1", "OPEN", False), ("a2", "UNKNOWN", True)]
    later = D.keyed_dimension(dim.union(spark.createDataFrame([("a2", "OPEN")], dim.schema)), "sk", ["account_id"], facts)
    assert rows(got.select("account_id", "sk")) == rows(later.select("account_id", "sk"))
    party = D.versioned_dimension(versions(spark, ("p", "a", START, END, True)), "sk", ["k"])
    assert rows(party.where("is_placeholder").select("k", "effective_from", "effective_to")) == [("UNKNOWN", START, END)]


def test_dates(spark):
    a = spark.createDataFrame([(dt(2026, 1, 30), None), (None, dt(2026, 2, 2))], "x timestamp_ntz, y timestamp_ntz")
    got = rows(D.date_dimension(D.bounds((a, "x", "y"))).select("date_key", "month_name", "is_weekend"))
    assert got == [(20260130, "January", False), (20260131, "January", True), (20260201, "February", True), (20260202, "February", False)]
    assert rows(D.date_dimension(D.bounds((a.limit(0), "x", "y")))) == []


def test_asof_at_the_boundary(spark):
    have = versions(spark, ("p", "old", START, day(10), False), ("p", "new", day(10), END, True))
    facts = spark.createDataFrame([("p", day(9, 23)), ("p", day(10)), ("q", day(10)), (None, day(10))], "k string, ts timestamp_ntz")
    got = X.asof_join(facts, have, {"k": "k"}, "ts", ["addr"])
    assert rows(got) == [(None, day(10), None), ("p", day(9, 23), "old"), ("p", day(10), "new"), ("q", day(10), None)]


def test_balances_and_milestones(spark):
    events = spark.createDataFrame([("a", day(2), "10.00", "OPENING"), ("a", day(2, 5), "-3.00", "DEBIT"), ("a", day(4), "1.00", "CREDIT"), ("a", day(5), "9.00", "CREDIT")], "account_id string, ts timestamp_ntz, amount string, kind string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    accounts = spark.createDataFrame([("a", day(1).date(), day(5).date()), ("b", None, None), ("c", day(9).date(), day(9).date())], "account_id string, opened date, closed date")
    real = F.col("kind") != "OPENING"
    spine = X.date_spine(accounts, D.bounds((events, "ts", "ts")), "opened", "closed").select("account_id", date_key("full_date").alias("date_key"))
    got = X.periodic_snapshot(spine, X.daily_movements(events, "account_id", "ts", "amount", real), "account_id")
    a = [tuple(map(str, r)) for r in got.where("account_id = 'a'").orderBy("date_key").select("date_key", "opening_balance", "movement", "closing_balance", "debit_amount", "credit_amount", "txn_count").collect()]
    assert a == [("20260102", "0.00", "7.00", "7.00", "-3.00", "0.00", "1"), ("20260103", "7.00", "0.00", "7.00", "0.00", "0.00", "0"), ("20260104", "7.00", "1.00", "8.00", "0.00", "1.00", "1")]
    assert rows(got.groupBy("account_id").count()) == [("a", 3), ("b", 4)]
    life = X.accumulating_snapshot(accounts, events, "account_id", "ts", "amount", real, "opened", "closed", F.lit("2026-01-20").cast("date"))
    r = life.where("account_id = 'a'").first()
    assert (r.opened_date_key, r.first_txn_date_key, r.last_txn_date_key, r.closed_date_key, r.days_to_first_txn, r.days_open, r.txn_count, str(r.lifetime_amount)) == (20260101, 20260102, 20260105, 20260105, 1, 4, 3, "17.00")
    assert life.where("account_id = 'b'").first().txn_count == 0
    assert rows(K.outside_life(got, accounts, "account_id", "opened", "closed")) == [(0, 0)]
    assert rows(K.outside_life(spark.createDataFrame([("a", 20251231), ("a", 20260105)], "account_id string, date_key int"), accounts, "account_id", "opened", "closed")) == [(1, 1)]


def test_checks_find_faults(spark):
    good = versions(spark, ("p", "a", START, day(10), False), ("p", "b", day(10), END, True))
    assert rows(K.ranges(good, ["k"])) == [(0, 0, 0)] and rows(K.idle_versions(good, ["k"], ["addr"])) == [(0,)]
    bad = versions(spark, ("p", "a", START, day(12), True), ("p", "a", day(10), day(20), True), ("q", "a", day(3), day(3), False), ("r", "a", START, day(1), False), ("r", "b", day(2), END, True))
    assert rows(K.ranges(bad, ["k"])) == [(1, 1, 1)]
    assert rows(K.idle_versions(bad, ["k"], ["addr"])) == [(1,)]
    assert rows(K.current_rows(bad, ["k"])) == [(1, 1, 1)]
    assert rows(K.current_rows(bad, ["k"], spark.createDataFrame([("q",)], "k string"))) == [(1, 1, 0)]
    facts = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (3, "z")], "id int, d string")
    dim = spark.createDataFrame([("x",), ("y",)], "d string")
    assert rows(K.grain(facts, ["id"])) == [(4, 3, 1)] and rows(K.orphans(facts, "d", dim, "d")) == [(1, 1)]
    assert rows(K.keys_lost(facts.select("d"), dim, ["d"]))[0][1] == 0
    assert rows(K.milestones(spark.createDataFrame([(1, 2, None), (3, 2, 9)], "a int, b int, c int"), ["a", "b", "c"], F.lit(5))) == [(1, 1)]
    assert rows(K.reconcile(facts, facts.where("id < 3"), ["id"], ["id"]).select("id")) == [(3,)]
    late = spark.createDataFrame([("a", day(9)), ("a", day(11))], "addr string, ts timestamp_ntz")
    assert rows(K.resolved_in_time(late, good, "addr", "ts")) == [(1, 2)]
    shuffled = good.select(*reversed(good.columns)).orderBy(F.desc("effective_from"))
    assert rows(K.table_fingerprint(good)) == rows(K.table_fingerprint(shuffled)) != rows(K.table_fingerprint(bad))
    spec = bank_model()["silver_account"]
    assert K.column_faults(spark.createDataFrame([], "account_id int, account_sk string"), spec)[0].startswith("account_id")
