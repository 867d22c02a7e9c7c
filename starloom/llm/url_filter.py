"""URL rules by a sorted sweep over reversed hosts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm._shared import fresh

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rule, verdict of a list of (verdict, rule)."""
    if not rules:
        return spark.sql("select '' rule, '' verdict where false")
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for v, r in rules])))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    """Host labels from the last, then the path; as bytes, so that prefixes are intervals in byte order."""
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("/"), path), "UTF-8")


def _boundaries(rules: DataFrame) -> tuple[DataFrame, int, int]:
    """key, top: where the innermost rule changes and which is innermost from there; most labels, longest path.

    A rule's interval opens at its key and closes behind every key that it begins. Intervals of one
    host nest or are apart; where one closes, the stack's next rule, its longest proper prefix, is
    innermost again.
    """
    cut = F.instr("rule", "/")
    host = F.translate(F.when(cut > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule")), _UPPER, _LOWER)
    path = F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    clean = rules.where("rule is not null and verdict is not null").withColumns({"host": host, "path": path})
    clean = clean.groupBy("host", "path").agg(F.max(F.struct("verdict", "rule")).alias("x")).select("host", "path", "x.*")
    clean = clean.withColumn("top", F.struct(F.length(F.concat("host", "path")).alias("size"), "rule", "verdict"))
    under = clean.select("host", F.col("path").alias("own"), F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("path")).where("path <> own")
    outer = under.join(clean.select("host", "path", "top"), ["host", "path"]).groupBy("host", "own").agg(F.max("top").alias("outer")).withColumnRenamed("own", "path")
    none = F.struct(F.lit(-1).alias("size"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    known = clean.join(outer, ["host", "path"], "left").withColumns({"outer": F.coalesce("outer", none), "key": _key(_reversed(F.col("host")), F.col("path"))})
    ends = known.select("key", "top").union(known.select(F.concat("key", F.unhex(F.lit("FF"))), "outer"))
    most = clean.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).first()
    return ends, most[0] or 0, most[1] or 0


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", splits: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict (names made free of clashes with their columns).

    ``rules`` has rule (a host and the beginning of a path, as ``example.org/es/``) and verdict. A rule
    fits its host and all subdomains where the path begins with the rule's; the longest wins, then the
    last by code point, and ``block`` before ``allow`` for the same rule. Method: sort-merge range
    join. Each url gives one key for each trailing part of its host that a rule can have; rules are
    intervals of keys. Urls are dealt evenly to ``splits`` sorted runs (the shuffle partitions by
    default), whatever their hosts; each run holds the rules' boundaries and one sweep over it keeps
    the innermost active rule.

    Null urls and urls without :// have an empty host and path and no rule; without a rule the
    verdict is ``default``. Null rules are ignored. Repeated rows are judged row by row; an empty
    table gives no rows.
    """
    ends, labels, longest = _boundaries(rules)
    runs = splits or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path, rule, verdict = fresh(pages, "host", "path", "rule", "verdict")
    judged = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    if not labels:
        return judged.withColumns({rule: F.lit(None).cast("string"), verdict: F.lit(default)})
    row = F.struct(*[F.col(f"`{c}`") for c in judged.columns])
    work = judged.select(row.alias("row"), F.monotonically_increasing_id().alias("id"), F.slice(_reversed(F.col(host)), 1, labels).alias("labels"), F.substring(path, 1, longest).alias("begin"))
    work = work.withColumns({"run": F.pmod(F.xxhash64("id"), F.lit(runs)), "depth": F.explode(F.sequence(F.lit(1), F.size("labels")))})
    whole = F.col("depth") == 1
    asked = work.select("run", _key(F.slice("labels", 1, F.col("depth")), F.col("begin")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(ends.schema["top"].dataType).alias("top"), "id", F.when(whole, F.col("row")).alias("row"))
    swept = ends.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)).cast("array<long>")))
    swept = swept.select("run", "key", F.lit(0).alias("kind"), "top", F.lit(None).cast("long").alias("id"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    sweep = Window.partitionBy("run").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = asked.union(swept).withColumn("top", F.last("top", True).over(sweep)).where("kind = 1")
    best = active.withColumn("best", F.max(F.when(F.col("top.size") >= 0, F.col("top"))).over(Window.partitionBy("run", "id"))).where("row is not null")
    found = [F.col("row").getField(c).alias(c) for c in judged.columns]
    return best.select(*found, F.col("best.rule").alias(rule), F.coalesce("best.verdict", F.lit(default)).alias(verdict))
