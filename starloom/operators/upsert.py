"""MERGE as DataFrame algebra: every form is a pure function of target and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class When:
    """A clause: where ``condition`` over ``t`` (target) and ``s`` (source) holds, set columns, or delete if ``sets`` is None."""

    condition: Column | None
    sets: dict[str, Column] | None


def require_unique(source: DataFrame, key: list[str]) -> DataFrame:
    """``source`` itself; running it fails if a key occurs twice. The check rides on the plan, no extra action."""
    counts = source.groupBy(*key).agg(F.count(F.lit(1)).alias("rows_of_key"))
    checked = counts.where(F.when(F.col("rows_of_key") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("several source rows have one key")).cast("boolean")))
    condition = [source[k].eqNullSafe(checked[k]) for k in key]
    return source.join(checked, condition, "left_semi")


def merge(target: DataFrame, source: DataFrame, on: list[str], matched: list[When] = (), insert: bool = True, not_by_source: list[When] = (), insert_if: Column | None = None) -> DataFrame:
    """The state after a MERGE of ``source`` into ``target``; the first clause that holds wins.

    Conditions and values name columns as ``t.x`` and ``s.x``. One full outer join on the keys, or a left
    one where nothing can be added; keys stay plain columns, so a target that is already dealt by key
    does not move. Rows of the target with a null key never match, as in SQL. Source keys must be unique.
    """
    names = target.columns
    side = lambda df, name: df.select(*[F.col(f"`{k}`").alias(f"{name}_{k}") for k in on], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
    condition = [F.col(f"t_{k}") == F.col(f"s_{k}") for k in on]
    both = side(target, "t").join(side(source, "s"), condition, "full" if insert else "left")
    ours, theirs = F.col("t").isNotNull(), F.col("s").isNotNull()
    new = F.struct(*[(F.col(f"s.{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)).cast(target.schema[c].dataType).alias(c) for c in names])
    case = None
    for scope, clauses in ((ours & theirs, matched), (ours & ~theirs, not_by_source)):
        for clause in clauses:
            holds = scope if clause.condition is None else scope & F.coalesce(clause.condition, F.lit(False))
            value = F.lit(None) if clause.sets is None else F.struct(*[clause.sets.get(c, F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) for c in names])
            case = F.when(holds, value) if case is None else case.when(holds, value)
    fresh = (~ours if insert else F.lit(False)) & (F.lit(True) if insert_if is None else F.coalesce(insert_if, F.lit(False)))
    case = F.when(fresh, new) if case is None else case.when(fresh, new)
    return both.select(case.when(ours, F.col("t")).alias("row")).where("row is not null").select("row.*")


def _all(names: list[str]) -> dict[str, Column]:
    return {c: F.col(f"s.{c}") for c in names}


def upsert_latest(target: DataFrame, source: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """Guarded current state: a source row replaces its target only with a later sequence value; new keys are added.

    Equal or null sequence values leave the target as it is.
    """
    return merge(target, source, key, [When(F.col(f"s.{sequence}") > F.col(f"t.{sequence}"), _all(target.columns))])


def replace_keys(target: DataFrame, rebuilt: DataFrame, affected: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``affected`` keys exchanged for ``rebuilt``; all others unchanged. Keys come as a frame, never as a literal list."""
    return target.join(affected.select(*key).distinct(), key, "left_anti").select(*target.columns).unionByName(rebuilt.select(*target.columns))


def close_versions(target: DataFrame, closures: DataFrame, key: list[str], at: str = "deleted_ts") -> DataFrame:
    """Current versions that began before their key's closure end there; nothing else changes and nothing is added."""
    condition = F.col("t.is_current") & (F.col("t.effective_from") < F.col(f"s.{at}"))
    sets = {"effective_to": F.col(f"s.{at}"), "is_current": F.lit(False)}
    return merge(target, closures, key, [When(condition, sets)], insert=False)


def synchronise(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Update all, insert all, delete what the source lacks: the source itself, in the target's columns and types."""
    return source.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])
