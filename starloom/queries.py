"""The library's operators over the test tables, each with independent DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.columns import BEGINNING, FOREVER, category_code, date_key, differs, fingerprint, money, surrogate_key, title_of, unknown_key
from starloom.operators import checks as K
from starloom.operators import dimensions as D
from starloom.operators import facts as X
from starloom.operators import history as H
from starloom.operators.clean import coerce, exact_rows, latest_rows
from starloom.operators.upsert import When, close_versions, merge, require_unique, synchronise, upsert_latest
from starloom.schema import create_table, differences, struct
from starloom.sources.extracts import read_extract
from starloom.spec import Spec, bank_model, parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spec(types: dict[str, str], key: str, sequence: str, tracked: tuple[str, ...] = ()) -> Spec:
    """A spec over a test table; with ``tracked`` columns it is versioned."""
    attributes = [{"name": n, "type": t, "tracked": n in tracked} for n, t in types.items()]
    return parse({"name": "silver_row", "layer": "silver", "kind": "entity", "grain": "A row of a test table.", "business_key": [key], "history": {"type": "scd2" if tracked else "scd1", "sequence_by": sequence}, "attributes": attributes})


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; of the driver's own only where it is the cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root or tempfile.mkdtemp(prefix='starloom-')}/queries-{uuid.uuid4().hex}"


# Pieces of SQL that several oracles share; each restates the semantics, none comes from the plans.
_TIMELINE = f"""
    rows_ AS (SELECT user_id, ts, event_type, event_id, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_type NULLS LAST, event_id) AS n FROM events),
    marked AS (SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS nth FROM rows_ WHERE n = 1 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    opened AS (SELECT *, row_number() OVER w AS v, lead(ts) OVER w AS later FROM marked WHERE nth = 1 OR event_type IS DISTINCT FROM was WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    versions AS (SELECT user_id, event_type, event_id, ts, CASE WHEN v = 1 THEN TIMESTAMP '{BEGINNING}' ELSE ts END AS effective_from,
        coalesce(later, TIMESTAMP '{FOREVER}') AS effective_to, later IS NULL AS is_current FROM opened)"""
_GONE = """
    seen AS (SELECT user_id, max(CAST(ts AS DATE)) AS last_batch FROM events GROUP BY 1),
    days AS (SELECT d, lead(d) OVER (ORDER BY d) AS next_batch FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)),
    gone AS (SELECT user_id, CAST(next_batch AS TIMESTAMP) AS deleted_ts FROM seen JOIN days ON last_batch = d WHERE next_batch IS NOT NULL)"""
_SK = "sha256(coalesce(CAST({} AS VARCHAR), 'UNKNOWN'))"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return H.timeline(events, ["user_id"], "ts", ["event_type"])


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _t(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("_batch_id"))
    return H.snapshot_deletions(landed, ["user_id"], kind="timestamp_ntz")


@_query("SELECT event_id, try_cast(event_type AS INTEGER) AS type_number, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast(CAST(value AS VARCHAR) AS DECIMAL(18,2)) AS amount FROM events")
def coerce_try_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _spec({"event_id": "bigint", "type_number": "int", "k": "bigint", "amount": "decimal(18,2)"}, "event_id", "event_id")
    texts = {"event_id": F.col("event_id"), "type_number": F.col("event_type"), "k": F.get_json_object("props", "$.k"), "amount": F.col("value")}
    return coerce(_t(spark, sf_dir, "events").select(*[c.cast("string").alias(n) for n, c in texts.items()]), spec)


@_query("""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS n FROM lineitem) WHERE n = 1""")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_rows(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


@_query("SELECT DISTINCT * FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 200 = 0)")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    return exact_rows(lines.unionByName(lines.where("l_orderkey % 200 = 0")))


_LATEST = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority) AS n FROM orders {}) WHERE n = 1"


@_query(f"""WITH t AS ({_LATEST.format("WHERE o_orderdate < TIMESTAMP '1998-04-01'")}), s AS ({_LATEST.format("WHERE o_orderpriority <> '1-URGENT'")})
    SELECT s.* FROM s LEFT JOIN t USING (o_custkey) WHERE t.o_custkey IS NULL OR s.o_orderdate > t.o_orderdate
    UNION ALL SELECT t.* FROM t LEFT JOIN s USING (o_custkey) WHERE s.o_custkey IS NULL OR NOT s.o_orderdate > t.o_orderdate""")
def scd1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    order = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    latest = lambda df: latest_rows(df, ["o_custkey"], "o_orderdate", order)
    target = latest(orders.where(F.col("o_orderdate") < F.lit("1998-04-01").cast("timestamp_ntz")))
    return upsert_latest(target, require_unique(latest(orders.where("o_orderpriority <> '1-URGENT'")), ["o_custkey"]), ["o_custkey"], "o_orderdate")


@_query("""SELECT coalesce(t.p_partkey, s.p_partkey) AS p_partkey, CASE WHEN t.p_partkey IS NULL THEN s.p_brand ELSE t.p_brand END AS p_brand,
        CASE WHEN t.p_partkey IS NULL OR s.p_size > 25 THEN s.p_size ELSE t.p_size END AS p_size, t.p_partkey IS NULL AS added
    FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) t FULL JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) s ON t.p_partkey = s.p_partkey
    WHERE NOT (t.p_partkey IS NOT NULL AND s.p_partkey IS NOT NULL AND s.p_size <= 5) AND NOT (s.p_partkey IS NULL AND t.p_size > 45)""")
def merge_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    target = part.where("p_partkey % 3 <> 0").select("p_partkey", "p_brand", "p_size", F.lit(False).alias("added"))
    source = part.where("p_partkey % 2 = 0").select("p_partkey", "p_brand", "p_size", F.lit(True).alias("added"))
    return merge(target, source, ["p_partkey"], [When(F.col("s.p_size") <= 5, None), When(F.col("s.p_size") > 25, {"p_size": F.col("s.p_size")})], not_by_source=[When(F.col("t.p_size") > 45, None)])


@_query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey < 20")
def merge_synchronise(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _t(spark, sf_dir, "supplier")
    return synchronise(supplier.where("s_nationkey > 5"), supplier.where("s_nationkey < 20"), ["s_suppkey"])


def _ends_as_text(versions: DataFrame) -> DataFrame:
    """The last sentinel lies beyond what some clients' timestamps hold."""
    return versions.withColumn("effective_to", F.col("effective_to").cast("string"))


@_query(f"WITH {_TIMELINE} SELECT * REPLACE (CAST(effective_to AS VARCHAR) AS effective_to) FROM versions")
def scd2_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ends_as_text(_versions(spark, sf_dir))


@_query(f"WITH {_TIMELINE} SELECT * REPLACE (CAST(effective_to AS VARCHAR) AS effective_to) FROM versions")
def scd2_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _spec({"user_id": "bigint", "event_type": "string", "event_id": "bigint", "ts": "timestamp"}, "user_id", "ts", ("event_type",))
    landed = _t(spark, sf_dir, "events").select(*spec.columns, F.when(F.col("event_id") % 3 == 0, "late").otherwise("early").alias("_batch_id"))
    stored = H.rebuild_timeline(landed.where("_batch_id = 'early'"), spec)
    return _ends_as_text(H.advance(stored, landed, spec, "late"))


@_query(f"WITH {_TIMELINE} SELECT count(*) FILTER (nth > 1 AND event_type IS NOT DISTINCT FROM was) AS idle FROM marked")
def scd2_idle_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as a version: those that a timeline would prune are found."""
    events = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    one = latest_rows(events, ["user_id", "ts"], "ts", ["event_type", "event_id"])
    return K.idle_versions(one.withColumn("effective_from", F.col("ts")), ["user_id"], ["event_type"])


@_query(f"""WITH {_TIMELINE}, moved AS (SELECT user_id, effective_from, CASE WHEN is_current THEN effective_to WHEN user_id % 5 = 0 THEN effective_to - INTERVAL 1 HOUR WHEN user_id % 7 = 0 THEN effective_to + INTERVAL 1 HOUR ELSE effective_to END AS effective_to FROM versions),
    followed AS (SELECT *, lead(effective_from) OVER (PARTITION BY user_id ORDER BY effective_from, effective_to) AS later FROM moved)
    SELECT count(*) FILTER (later < effective_to) AS overlaps, count(*) FILTER (later > effective_to) AS gaps, count(*) FILTER (effective_to <= effective_from) AS inverted FROM followed""")
def scd2_faults_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends moved by an hour either way are found."""
    by = F.when(F.col("is_current"), 0).when(F.col("user_id") % 5 == 0, -1).when(F.col("user_id") % 7 == 0, 1).otherwise(0)
    moved = _versions(spark, sf_dir).withColumn("effective_to", F.when(by == 0, F.col("effective_to")).otherwise(F.col("effective_to") + F.make_dt_interval(hours=by)))
    return K.ranges(moved, ["user_id"])


_DIM_USER = f"""SELECT sha256(concat_ws(chr(31), CAST(user_id AS VARCHAR), CAST(effective_from AS VARCHAR))) AS user_sk, user_id, event_type, event_id, ts, effective_from, effective_to, is_current, false AS is_placeholder FROM versions
    UNION ALL SELECT sha256('UNKNOWN'), NULL, 'UNKNOWN', NULL, NULL, TIMESTAMP '{BEGINNING}', TIMESTAMP '{FOREVER}', true, true"""


@_query(f"WITH {_TIMELINE}, dim AS ({_DIM_USER}) SELECT * REPLACE (CAST(effective_to AS VARCHAR) AS effective_to) FROM dim")
def versioned_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ends_as_text(D.versioned_dimension(_versions(spark, sf_dir), "user_sk", ["user_id"]))


@_query(f"""WITH {_TIMELINE}, dim AS ({_DIM_USER}), f AS (SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS user_id, CAST(TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 40000) MINUTE AS TIMESTAMP) AS happened FROM orders)
    SELECT o_orderkey, coalesce(user_sk, sha256('UNKNOWN')) AS user_sk, CAST(strftime(happened, '%Y%m%d') AS INTEGER) AS date_key FROM f LEFT JOIN dim ON f.user_id = dim.user_id AND happened >= effective_from AND happened < effective_to""")
def fact_asof_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts resolved to the dimension's version that held when they happened; the rest points to the unknown member."""
    dim = D.versioned_dimension(_versions(spark, sf_dir), "user_sk", ["user_id"])
    at = F.timestamp_add("MINUTE", (F.col("o_orderkey") % 40000).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    facts = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("owner"), at.alias("at"))
    dated = X.asof_join(facts, dim, {"owner": "user_id"}, "at", ["user_sk"])
    return dated.select("o_orderkey", F.coalesce("user_sk", unknown_key()).alias("user_sk"), date_key(F.to_date("at")).alias("date_key"))


@_query("SELECT 0::BIGINT AS idle")
def scd2_noop_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.idle_versions(_versions(spark, sf_dir), ["user_id"], ["event_type"])


@_query("SELECT 0::BIGINT AS overlaps, 0::BIGINT AS gaps, 0::BIGINT AS inverted")
def scd2_intervals_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ranges(_versions(spark, sf_dir), ["user_id"])


@_query(f"WITH {_TIMELINE} SELECT count(*) AS keys, min(n) AS least, max(n) AS greatest, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM versions GROUP BY user_id)")
def scd2_version_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.version_profile(_versions(spark, sf_dir), ["user_id"])


@_query(f"WITH {_TIMELINE} SELECT count(*) AS days FROM (SELECT 1 FROM versions GROUP BY user_id, CAST(ts AS DATE) HAVING count(*) > 1)")
def scd2_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.same_day_versions(_versions(spark, sf_dir), ["user_id"], "ts")


@_query(f"WITH {_GONE} SELECT * FROM gone")
def snapshot_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gone(spark, sf_dir)


@_query(f"""WITH {_TIMELINE}, {_GONE} SELECT v.user_id, event_type, event_id, ts, effective_from, CAST(CASE WHEN is_current AND effective_from < deleted_ts THEN deleted_ts ELSE effective_to END AS VARCHAR) AS effective_to,
    is_current AND NOT coalesce(effective_from < deleted_ts, false) AS is_current FROM versions v LEFT JOIN gone g ON v.user_id = g.user_id""")
def scd2_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ends_as_text(close_versions(_versions(spark, sf_dir), _gone(spark, sf_dir), ["user_id"]))


@_query(f"WITH {_TIMELINE}, {_GONE} SELECT count(*) FILTER (effective_from < deleted_ts) AS applied, count(*) FILTER (NOT effective_from < deleted_ts) AS refused FROM versions JOIN gone USING (user_id) WHERE is_current")
def closure_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.closure_split(_versions(spark, sf_dir), _gone(spark, sf_dir), ["user_id"])


@_query(f"WITH {_GONE}, u AS (SELECT DISTINCT user_id FROM events) SELECT 0::BIGINT AS several, (SELECT count(*) FROM gone) AS \"none\", 0::BIGINT AS unexplained")
def current_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _gone(spark, sf_dir)
    return K.current_rows(close_versions(_versions(spark, sf_dir), gone, ["user_id"]), ["user_id"], gone)


@_query(f"""WITH {_TIMELINE} SELECT e.event_id, e.user_id, e.ts, v.event_type AS version_type, v.effective_from FROM events e
    LEFT JOIN versions v ON e.user_id = v.user_id AND e.ts >= v.effective_from AND e.ts < v.effective_to""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir).select("user_id", "effective_from", "effective_to", F.col("event_type").alias("version_type"))
    return X.asof_join(_t(spark, sf_dir, "events").select("event_id", "user_id", "ts"), versions, {"user_id": "user_id"}, "ts", ["version_type", "effective_from"])


@_query(f"""WITH {_TIMELINE}, r AS (SELECT v.event_type, CAST(sum(CAST(e.value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount, count(*) AS events FROM events e
    JOIN versions v ON e.user_id = v.user_id AND e.ts >= v.effective_from AND e.ts < v.effective_to GROUP BY 1) SELECT event_type AS state, events, amount FROM r""")
def value_by_state_at_the_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: value by the state that each user was in when the event happened."""
    versions = _versions(spark, sf_dir).select("user_id", "effective_from", "effective_to", F.col("event_type").alias("state"))
    dated = X.asof_join(_t(spark, sf_dir, "events").select("user_id", "ts", "value"), versions, {"user_id": "user_id"}, "ts", ["state"])
    return dated.groupBy("state").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(28,2)").alias("amount"))


@_query(f"""WITH {_TIMELINE}, f AS (SELECT e.user_id, e.ts, v.effective_from, v.effective_to, v.is_current FROM events e JOIN versions v ON e.user_id = v.user_id AND e.ts >= v.effective_from AND e.ts < v.effective_to)
    SELECT 0::BIGINT AS outside, count(*) FILTER (NOT is_current) AS historic FROM f""")
def temporal_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir).withColumn("sk", surrogate_key("user_id", "effective_from"))
    facts = X.asof_join(_t(spark, sf_dir, "events").select("event_id", "user_id", "ts"), versions, {"user_id": "user_id"}, "ts", ["sk"])
    return K.resolved_in_time(facts, versions, "sk", "ts")


@_query(f"WITH {_TIMELINE} SELECT user_id, effective_from, sha256(concat_ws(chr(31), CAST(user_id AS VARCHAR), CAST(effective_from AS VARCHAR))) AS sk FROM versions")
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("user_id", "effective_from", surrogate_key("user_id", "effective_from").alias("sk"))


@_query(f"""SELECT {_SK.format('c_custkey')} AS customer_sk, c_custkey, c_name, false AS is_placeholder FROM customer
    UNION ALL SELECT sha256('UNKNOWN'), NULL, 'UNKNOWN', true""")
def unknown_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = _t(spark, sf_dir, "customer").select(surrogate_key("c_custkey").alias("customer_sk"), "c_custkey", "c_name", F.lit(False).alias("is_placeholder"))
    return real.unionByName(D.placeholder_member(real, "customer_sk", {"c_name": F.lit("UNKNOWN")}).select(*real.columns))


_DIM_PART = f"""SELECT {_SK.format('p_partkey')} AS part_sk, p_partkey, p_brand, p_size, false AS is_inferred FROM part WHERE p_size <= 40
    UNION ALL SELECT DISTINCT {_SK.format('l_partkey')}, l_partkey, NULL, NULL, true FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)"""


def _dim_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = _t(spark, sf_dir, "part").where("p_size <= 40").select("p_partkey", "p_brand", "p_size")
    return D.keyed_dimension(arrived, "part_sk", ["p_partkey"], _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), unknown=())


@_query(_DIM_PART)
def inferred_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dim_part(spark, sf_dir)


_CODE = "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority WHEN o_orderstatus IN ('F') AND c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY') THEN 'UNKNOWN' ELSE 'NOT_APPLICABLE' END"


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    gap = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    code = category_code(gap, F.col("o_orderstatus"), F.col("c_mktsegment"), ("F",), ("HOUSEHOLD", "MACHINERY"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("code", code)


@_query(f"SELECT DISTINCT sha256({_CODE}) AS category_sk, {_CODE} AS code, array_to_string(list_transform(string_split(replace(lower({_CODE}), '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def category_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.category_dimension(_coded(spark, sf_dir), "code", "category_sk", "name")


@_query("""SELECT r_regionkey, array_to_string(list_transform(string_split(replace(lower(r_name), '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM region""")
def category_titles_by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "region").select("r_regionkey", title_of(F.col("r_name")).alias("title"))


_DATES = """WITH b AS (SELECT least((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem)) AS lo, greatest((SELECT max(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)) AS hi),
    d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS full_date FROM b)"""


@_query(f"""{_DATES} SELECT CAST(strftime(full_date, '%Y%m%d') AS INTEGER) AS date_key, full_date, CAST(day(full_date) AS INTEGER) AS day_of_month, CAST(month(full_date) AS INTEGER) AS month_number,
    monthname(full_date) AS month_name, CAST(quarter(full_date) AS INTEGER) AS quarter, CAST(year(full_date) AS INTEGER) AS year_number, dayofweek(full_date) IN (0, 6) AS is_weekend FROM d""")
def date_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.date_dimension(D.bounds((_t(spark, sf_dir, "orders"), "o_orderdate", "o_orderdate"), (_t(spark, sf_dir, "lineitem"), "l_shipdate", "l_shipdate")))


_AMOUNT = "CAST(l_extendedprice AS DECIMAL(18,2))"
_STAR = f"""WITH dp AS ({_DIM_PART}), f AS (SELECT l_orderkey, l_linenumber, part_sk, {_SK.format('o_custkey')} AS customer_sk, sha256({_CODE}) AS category_sk, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key,
    CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS lag_days, {_AMOUNT} AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN dp ON l_partkey = p_partkey)"""


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    orders = _coded(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderdate", "code")
    part = _dim_part(spark, sf_dir).select("part_sk", "p_partkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "part_sk", surrogate_key("o_custkey").alias("customer_sk"), surrogate_key("code").alias("category_sk"), date_key("o_orderdate").alias("date_key"), F.datediff("l_shipdate", "o_orderdate").alias("lag_days"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))


@_query(f"{_STAR} SELECT * FROM f")
def fact_txn_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star(spark, sf_dir)


_SIGNED = "CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(value AS DECIMAL(18,2)) ELSE -CAST(value AS DECIMAL(18,2)) END"
_BALANCE = f"""WITH span AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events),
    ent AS (SELECT user_id, min(CAST(ts AS DATE)) AS opened, CASE WHEN user_id % 7 = 0 THEN max(CAST(ts AS DATE)) END AS closed FROM events GROUP BY 1),
    spine AS (SELECT user_id, CAST(unnest(generate_series(greatest(opened, lo), least(coalesce(closed - 1, hi), hi), INTERVAL 1 DAY)) AS DATE) AS d FROM ent, span),
    mov AS (SELECT user_id, CAST(ts AS DATE) AS d, sum({_SIGNED}) AS movement, coalesce(sum({_SIGNED}) FILTER (event_type <> 'signup' AND {_SIGNED} < 0), 0) AS debit,
        coalesce(sum({_SIGNED}) FILTER (event_type <> 'signup' AND {_SIGNED} >= 0), 0) AS credit, count(*) FILTER (event_type <> 'signup') AS n FROM events GROUP BY 1, 2),
    bal AS (SELECT spine.user_id, CAST(strftime(spine.d, '%Y%m%d') AS INTEGER) AS date_key, CAST(coalesce(movement, 0) AS DECIMAL(18,2)) AS movement, CAST(coalesce(debit, 0) AS DECIMAL(18,2)) AS debit_amount,
        CAST(coalesce(credit, 0) AS DECIMAL(18,2)) AS credit_amount, CAST(coalesce(n, 0) AS INTEGER) AS txn_count, CAST(sum(coalesce(movement, 0)) OVER (PARTITION BY spine.user_id ORDER BY spine.d) AS DECIMAL(18,2)) AS closing_balance
        FROM spine LEFT JOIN mov ON spine.user_id = mov.user_id AND spine.d = mov.d)"""


def _signed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value").cast("decimal(18,2)")
    return _t(spark, sf_dir, "events").select("user_id", "ts", "event_type", F.when(F.col("event_type").isin("purchase", "signup"), value).otherwise(-value).alias("amount"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.min(day).alias("opened"), F.when(F.col("user_id") % 7 == 0, F.max(day)).alias("closed"))


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _signed_events(spark, sf_dir)
    spine = X.date_spine(_users(spark, sf_dir), D.bounds((events, "ts", "ts")), "opened", "closed").select("user_id", date_key("full_date").alias("date_key"))
    return X.periodic_snapshot(spine, X.daily_movements(events, "user_id", "ts", "amount", F.col("event_type") != "signup"), "user_id")


@_query(f"{_BALANCE} SELECT *, CAST(closing_balance - movement AS DECIMAL(18,2)) AS opening_balance FROM bal")
def daily_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balances(spark, sf_dir)


@_query(f"{_BALANCE} SELECT count(*) AS rows, count(*) FILTER (movement = 0 AND txn_count = 0) AS quiet, count(*) FILTER (closing_balance < 0) AS overdrawn FROM bal")
def population_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.populations(_balances(spark, sf_dir), quiet=(F.col("movement") == 0) & (F.col("txn_count") == 0), overdrawn=F.col("closing_balance") < 0)


@_query(f"""{_BALANCE}, l AS (SELECT user_id, sum(movement) AS a, count(*) AS x FROM bal GROUP BY 1), r AS (SELECT user_id, CAST(sum({_SIGNED}) AS DECIMAL(28,2)) AS b FROM events GROUP BY 1)
    SELECT coalesce(l.user_id, r.user_id) AS user_id, CAST(a AS DECIMAL(28,2)) AS left_amount, b AS right_amount FROM l FULL JOIN r ON l.user_id = r.user_id WHERE abs(coalesce(a, 0) - coalesce(b, 0)) > 0.01""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _balances(spark, sf_dir).select("user_id", F.col("movement").alias("amount"))
    out = K.reconcile(left, _signed_events(spark, sf_dir), ["user_id"], ["amount"])
    return out.select("user_id", F.col("left_amount").cast("decimal(28,2)").alias("left_amount"), F.col("right_amount").cast("decimal(28,2)").alias("right_amount"))


@_query(f"""{_BALANCE}, l AS (SELECT user_id, sum(movement) AS a, sum(txn_count) AS x FROM bal WHERE user_id % 3 <> 0 OR date_key % 10 <> 7 GROUP BY 1), r AS (SELECT user_id, sum({_SIGNED}) AS b, count(*) FILTER (event_type <> 'signup') AS y FROM events GROUP BY 1)
    SELECT coalesce(l.user_id, r.user_id) AS user_id, CAST(a AS DECIMAL(28,2)) AS left_amount, CAST(x AS BIGINT) AS left_n, CAST(b AS DECIMAL(28,2)) AS right_amount, y AS right_n FROM l FULL JOIN r ON l.user_id = r.user_id WHERE abs(coalesce(a, 0) - coalesce(b, 0)) > 0.01 OR abs(coalesce(x, 0) - coalesce(y, 0)) > 0.01""")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and counts of a snapshot that lost some days, against the events."""
    left = _balances(spark, sf_dir).where("user_id % 3 <> 0 or date_key % 10 <> 7").select("user_id", F.col("movement").alias("amount"), F.col("txn_count").alias("n"))
    right = _signed_events(spark, sf_dir).select("user_id", "amount", (F.col("event_type") != "signup").cast("int").alias("n"))
    out = K.reconcile(left, right, ["user_id"], ["amount", "n"])
    return out.select("user_id", *[F.col(f"{side}_{m}").cast(k).alias(f"{side}_{m}") for side in ("left", "right") for m, k in (("amount", "decimal(28,2)"), ("n", "long"))])


@_query(f"{_BALANCE} SELECT count(*) FILTER (strptime(CAST(date_key AS VARCHAR), '%Y%m%d') < opened) AS early, count(*) FILTER (strptime(CAST(date_key AS VARCHAR), '%Y%m%d') >= closed) AS late FROM bal JOIN ent USING (user_id)")
def outside_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.outside_life(_balances(spark, sf_dir), _users(spark, sf_dir), "user_id", "opened", "closed")


_LIFE = f"""WITH a AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) FILTER (l_returnflag <> 'R') AS f, max(CAST(l_shipdate AS DATE)) FILTER (l_returnflag <> 'R') AS l, count(*) FILTER (l_returnflag <> 'R') AS n, sum({_AMOUNT}) AS s FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS opened, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 90 END AS closed FROM orders),
    life AS (SELECT o_orderkey, opened, closed, CAST(strftime(opened, '%Y%m%d') AS INTEGER) AS opened_date_key, CAST(strftime(f, '%Y%m%d') AS INTEGER) AS first_txn_date_key, CAST(strftime(l, '%Y%m%d') AS INTEGER) AS last_txn_date_key,
        CAST(strftime(closed, '%Y%m%d') AS INTEGER) AS closed_date_key, CAST(f - opened AS INTEGER) AS days_to_first_txn, CAST(coalesce(closed, DATE '2002-01-01') - opened AS INTEGER) AS days_open,
        CAST(coalesce(n, 0) AS INTEGER) AS txn_count, CAST(coalesce(s, 0) AS DECIMAL(18,2)) AS lifetime_amount FROM o LEFT JOIN a ON o_orderkey = l_orderkey)"""


def _lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", day.alias("opened"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 90)).alias("closed"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return X.accumulating_snapshot(orders, lines, "o_orderkey", "l_shipdate", "amount", F.col("l_returnflag") != "R", "opened", "closed", F.lit("2002-01-01").cast("date"))


@_query(f"{_LIFE} SELECT * FROM life")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lifecycles(spark, sf_dir)


@_query(f"""{_LIFE} SELECT count(*) FILTER (opened_date_key > first_txn_date_key OR first_txn_date_key > last_txn_date_key OR last_txn_date_key > closed_date_key) AS disordered, count(*) FILTER (closed_date_key > 20010701) AS beyond FROM life""")
def milestone_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.milestones(_lifecycles(spark, sf_dir), ["opened_date_key", "first_txn_date_key", "last_txn_date_key", "closed_date_key"], F.lit(20010701))


@_query("""SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(28,2)) AS purchases, count(*) FILTER (event_type = 'click') AS clicks,
    min(ts) FILTER (event_type = 'purchase') AS first_purchase, max(ts) FILTER (event_type = 'purchase') AS last_purchase, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS large FROM events GROUP BY user_id""")
def conditional_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    value = F.col("value").cast("decimal(18,2)")
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(bought, value).otherwise(0)).cast("decimal(28,2)").alias("purchases"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.min(F.when(bought, F.col("ts"))).alias("first_purchase"), F.max(F.when(bought, F.col("ts"))).alias("last_purchase"), F.sum((F.col("value") > 50).cast("int")).alias("large"))


@_query("""SELECT (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) AND l_linenumber <> 2) AS orphan, (SELECT count(*) FROM lineitem WHERE l_linenumber = 2) AS missing""")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 2, F.col("l_partkey")).alias("part"))
    return K.orphans(lines, "part", _t(spark, sf_dir, "part").where("p_size <= 40"), "p_partkey")


@_query("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(n) - count(*) AS BIGINT) AS repeated FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def grain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.grain(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS lost, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS added")
def keys_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.keys_lost(_t(spark, sf_dir, "orders").select("o_orderkey"), _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@_query("SELECT CAST(ts AS DATE) AS _batch_id, count(*) AS rows FROM events GROUP BY 1")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.batch_totals(_t(spark, sf_dir, "events").withColumn("_batch_id", F.to_date("ts")))


@_query("SELECT p_partkey, concat_ws(chr(31), coalesce(p_brand, chr(0)), coalesce(p_type, chr(0)), coalesce(CAST(p_size AS VARCHAR), chr(0))) AS mark FROM part")
def change_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", fingerprint("p_brand", "p_type", "p_size").alias("mark"))


@_query("SELECT event_id, event_type IS DISTINCT FROM was AS changed FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)")
def change_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _t(spark, sf_dir, "events").withColumn("was", was).select("event_id", differs(["event_type"], {"event_type": F.col("was")}).alias("changed"))


@_query(f"{_STAR} SELECT code AS category, count(*) AS txns, CAST(round(sum(abs(amount)), 0) AS DECIMAL(28,0)) AS total_spend FROM f JOIN (SELECT DISTINCT sha256({_CODE}) AS category_sk, {_CODE} AS code FROM orders LEFT JOIN customer ON o_custkey = c_custkey) USING (category_sk) GROUP BY 1 ORDER BY total_spend DESC LIMIT 5")
def q_spend_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    _star(spark, sf_dir).createOrReplaceTempView("star_fact")
    category_dim(spark, sf_dir).createOrReplaceTempView("star_category")
    return spark.sql("SELECT code AS category, count(*) AS txns, CAST(round(sum(abs(amount)), 0) AS DECIMAL(28,0)) AS total_spend FROM star_fact JOIN star_category USING (category_sk) GROUP BY 1 ORDER BY total_spend DESC LIMIT 5")


@_query(f"{_BALANCE} SELECT CAST(user_id % 5 AS INTEGER) AS product, count(*) AS accounts, CAST(round(sum(closing_balance) / count(*), 2) AS DECIMAL(18,2)) AS avg_balance FROM bal WHERE date_key = (SELECT max(date_key) FROM bal) GROUP BY 1")
def q_latest_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _balances(spark, sf_dir).createOrReplaceTempView("star_balance")
    return spark.sql("SELECT CAST(user_id % 5 AS INT) AS product, count(*) AS accounts, CAST(round(sum(closing_balance) / count(*), 2) AS DECIMAL(18,2)) AS avg_balance FROM star_balance WHERE date_key = (SELECT max(date_key) FROM star_balance) GROUP BY 1")


@_query(f"""WITH {_TIMELINE} SELECT v.event_type AS segment, count(*) AS txns, CAST(round(sum(CAST(e.value AS DECIMAL(18,2))), 0) AS DECIMAL(28,0)) AS total_spend FROM events e
    JOIN versions v ON e.user_id = v.user_id AND e.ts >= v.effective_from AND e.ts < v.effective_to WHERE e.event_type = 'purchase' GROUP BY 1""")
def q_asof_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir).select("user_id", "effective_from", "effective_to", F.col("event_type").alias("segment"))
    bought = _t(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "value")
    X.asof_join(bought, versions, {"user_id": "user_id"}, "ts", ["segment"]).createOrReplaceTempView("star_purchase")
    return spark.sql("SELECT segment, count(*) AS txns, CAST(round(sum(CAST(value AS DECIMAL(18,2))), 0) AS DECIMAL(28,0)) AS total_spend FROM star_purchase GROUP BY 1")


@_query(f"{_LIFE} SELECT o_orderstatus AS product, count(*) AS closed_accounts, CAST(round(avg(days_open)) AS BIGINT) AS avg_days_open, CAST(round(avg(txn_count)) AS BIGINT) AS avg_txns FROM life JOIN orders USING (o_orderkey) WHERE closed_date_key IS NOT NULL GROUP BY 1")
def q_closed_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    _lifecycles(spark, sf_dir).createOrReplaceTempView("star_life")
    _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").createOrReplaceTempView("star_order")
    return spark.sql("SELECT o_orderstatus AS product, count(*) AS closed_accounts, CAST(round(avg(days_open)) AS BIGINT) AS avg_days_open, CAST(round(avg(txn_count)) AS BIGINT) AS avg_txns FROM star_life JOIN star_order USING (o_orderkey) WHERE closed_date_key IS NOT NULL GROUP BY 1")


@_query("SELECT c_custkey, CAST(coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)), 0) AS DECIMAL(18,2)) AS total, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.count("o_orderkey").alias("orders"))
    return _t(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", money(F.col("total")).alias("total"), F.coalesce("orders", F.lit(0)).alias("orders"))


@_query("SELECT (id % 7)::BIGINT AS bucket, count(*) AS n FROM range(1000) t(id) GROUP BY 1")
def range_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.sources.extracts import integers

    return integers(spark, 1000, 7).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {_TIMELINE} SELECT CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), CAST(effective_from AS VARCHAR), CAST(effective_to AS VARCHAR), coalesce(CAST(event_id AS VARCHAR), chr(0)), coalesce(event_type, chr(0)), CAST(is_current AS VARCHAR), CAST(ts AS VARCHAR), CAST(user_id AS VARCHAR))), 1, 13) AS HUGEINT)) % 10000000000000 AS BIGINT) AS fingerprint FROM versions""")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table_fingerprint(_versions(spark, sf_dir))


@_query("""SELECT n_name, CAST(to_json({'n_nationkey': CAST(n_nationkey AS VARCHAR), 'n_regionkey': CAST(n_regionkey AS VARCHAR)}) AS VARCHAR) AS _rescued_data, 'b1' AS _batch_id FROM nation""")
def rescue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extract with undeclared columns, written as CSV and read by its spec."""
    path = _scratch(spark)
    _t(spark, sf_dir, "nation").write.option("header", True).csv(path)
    return read_extract(spark, _spec({"n_name": "string"}, "n_name", "n_name"), path, "b1").select("n_name", "_rescued_data", "_batch_id")


@_query(f"WITH {_GONE} SELECT (SELECT count(*) FROM gone)::DOUBLE / count(DISTINCT user_id) AS share FROM events")
def deletion_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = H.guard_deletions(_versions(spark, sf_dir), _gone(spark, sf_dir), ["user_id"], most=1.0)
    return spark.createDataFrame([(share,)], "share double")


@_query("""SELECT r.r_name, count(n.n_nationkey) AS nations, count(*) FILTER (n.n_nationkey IS NULL) AS without FROM region r LEFT JOIN nation n ON r.r_regionkey = n.n_regionkey AND n.n_name < 'M' GROUP BY 1""")
def left_join_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _t(spark, sf_dir, "nation").where("n_name < 'M'")
    joined = _t(spark, sf_dir, "region").join(nation, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.groupBy("r_name").agg(F.count("n_nationkey").alias("nations"), F.count_if(F.col("n_nationkey").isNull()).alias("without"))


@_query()
def ddl_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, create_table(s)) for n, s in bank_model().items()], "spec string, ddl string")


@_query("SELECT * FROM (VALUES ('silver_account', 'missing column status'), ('silver_account', 'undeclared column colour'), ('silver_account', 'column open_date is string, declared date')) t(spec, difference)")
def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole model against its own schemas, and one table with planted drift."""
    model = bank_model()
    drifted = spark.createDataFrame([], struct(model["silver_account"])).drop("status").withColumns({"colour": F.lit("red"), "open_date": F.col("open_date").cast("string")})
    found = [(n, d) for n, s in model.items() for d in differences(drifted.schema if n == "silver_account" else struct(s), s)]
    return spark.createDataFrame(found, "spec string, difference string")
