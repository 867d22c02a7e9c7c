"""Schemas, DDL text and conformance, all derived from specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from starloom.spec import Attribute, Spec

#: Columns that a layer or history adds to the declared ones.
LINEAGE = (Attribute("_ingest_ts", "timestamp", comment="When the row was read"), Attribute("_source_file", "string", comment="Where it was read"), Attribute("_batch_id", "string", comment="Which extract it came with"), Attribute("_rescued_data", "string", nullable=True, comment="Undeclared source columns as JSON"))
VERSION = (Attribute("effective_from", "timestamp", comment="First instant of the version"), Attribute("effective_to", "timestamp", comment="First instant after it"), Attribute("is_current", "boolean", comment="Whether no later version or deletion is known"))
PROPERTY = "starloom"


def columns(spec: Spec) -> list[Attribute]:
    """Declared attributes and those that the layer and history add."""
    added = LINEAGE if spec.layer == "bronze" else VERSION if spec.history == "scd2" else ()
    return [*spec.attributes, *added]


def struct(spec: Spec) -> T.StructType:
    """The table's schema; nullability is declared in metadata and checked, never enforced."""
    return T.StructType([T.StructField(a.name, a.data_type, True, {"comment": a.comment, "tracked": a.tracked, "nullable": a.nullable}) for a in columns(spec)])


def properties(spec: Spec) -> dict[str, str]:
    return {f"{PROPERTY}.grain": spec.grain, f"{PROPERTY}.kind": spec.kind, f"{PROPERTY}.history": spec.history, f"{PROPERTY}.business_key": ",".join(spec.business_key), f"{PROPERTY}.sequence_by": spec.sequence_by}


def literal(text: str) -> str:
    """A single-quoted SQL string; Spark escapes with a backslash, so quotes are not doubled."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def create_database(layer: str) -> str:
    return f"CREATE DATABASE IF NOT EXISTS `{layer}`"


def create_table(spec: Spec, location: str | None = None) -> str:
    lines = [f"  `{a.name}` {a.data_type.simpleString().upper()}" + (f" COMMENT {literal(a.comment)}" if a.comment else "") for a in columns(spec)]
    parts = [f"CREATE TABLE IF NOT EXISTS `{spec.layer}`.`{spec.entity}` (", ",\n".join(lines), ") USING PARQUET"]
    if spec.layer == "bronze":
        parts.append("PARTITIONED BY (`_batch_id`)")
    if location:
        parts.append(f"LOCATION {literal(location)}")
    parts.append(f"COMMENT {literal(spec.grain)}")
    parts.append("TBLPROPERTIES (" + ", ".join(f"{literal(k)} = {literal(v)}" for k, v in properties(spec).items()) + ")")
    return "\n".join(parts)


def differences(actual: T.StructType, spec: Spec) -> list[str]:
    """How a schema departs from the declared one: missing, undeclared and differently typed columns."""
    have, want = {f.name: f.dataType.simpleString() for f in actual}, {f.name: f.dataType.simpleString() for f in struct(spec)}
    found = [f"missing column {c}" for c in want if c not in have] + [f"undeclared column {c}" for c in have if c not in want]
    return found + [f"column {c} is {have[c]}, declared {want[c]}" for c in want if c in have and have[c].replace("timestamp_ntz", "timestamp") != want[c]]


def conformance(spark: SparkSession, spec: Spec, table: str | None = None) -> list[str]:
    """How a catalog table departs from its spec, in columns and properties; empty if it conforms."""
    name = table or spec.table
    if not spark.catalog.tableExists(name):
        return [f"table {name} does not exist"]
    found = differences(spark.table(name).schema, spec)
    stored = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return found + [f"property {k} is {stored.get(k)!r}, declared {v!r}" for k, v in properties(spec).items() if stored.get(k) != v]


def stated_grain(spark: SparkSession, spec: Spec) -> str | None:
    """The grain as the catalog has it: the comment that DESCRIBE shows."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {spec.table}").where("col_name = 'Comment'").collect()
    return rows[0]["data_type"] if rows else None


def require(df: DataFrame, spec: Spec) -> DataFrame:
    """``df`` in declared column order, or an error that lists every difference."""
    if found := differences(df.schema, spec):
        raise ValueError(f"{spec.name}: {'; '.join(found)}")
    return df.select(*[a.name for a in columns(spec)])
