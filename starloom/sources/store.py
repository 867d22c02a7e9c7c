"""Tables as versioned snapshots in a shared folder: the only module that knows paths.

A table is ``root/layer/entity/v=N`` with a pointer file that names the version to read. A version is
written in full, then the pointer is renamed over the old one, so readers see one version or the
other. All file access goes through Hadoop's file systems. One writer a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.schema import conformance, create_database, create_table, differences, require, struct
from starloom.spec import Spec

_POINTER = "_current"


class SchemaDrift(ValueError):
    """A table whose files are not what its spec declares: nothing is loaded into it."""


def session(name: str = "starloom", **conf: object) -> SparkSession:
    """The one place that makes sessions: UTC, adaptive plans, and what the caller sets; the rest is the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _at(self, spec: Spec) -> str:
        return f"{self.root}/{spec.layer}/{spec.entity}"

    def version(self, spec: Spec) -> int | None:
        """The current version, or None before the first."""
        fs, path = self._fs(f"{self._at(spec)}/{_POINTER}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return int(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, spec: Spec) -> DataFrame:
        """The current rows; an empty frame of the declared schema before the first version."""
        n = self.version(spec)
        if n is None:
            return self.spark.createDataFrame([], struct(spec))
        return self.spark.read.schema(struct(spec)).parquet(f"{self._at(spec)}/v={n}")

    def publish(self, df: DataFrame, spec: Spec) -> DataFrame:
        """Write the whole table as the next version and point to it; older versions stay until drop() or vacuum()."""
        n = (self.version(spec) or 0) + 1
        require(df, spec).write.mode("overwrite").parquet(f"{self._at(spec)}/v={n}")
        self._point(spec, n)
        return self.read(spec)

    def _point(self, spec: Spec, n: int) -> None:
        fs, path = self._fs(f"{self._at(spec)}/{_POINTER}")
        _, made = self._fs(f"{self._at(spec)}/{_POINTER}.next")
        out = fs.create(made, True)
        out.write(str(n).encode())
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        over = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(made), fs.makeQualified(path), over)

    def drift(self, spec: Spec) -> list[str]:
        """How the files of the current version depart from the spec; partition columns come from folders, as text."""
        n = self.version(spec)
        if n is None:
            return []
        stored = self.spark.read.parquet(f"{self._at(spec)}/v={n}").schema
        return differences(T.StructType([T.StructField(f.name, T.StringType() if f.name == "_batch_id" else f.dataType) for f in stored]), spec)

    def ensure(self, spec: Spec) -> Store:
        """The store, if the table does not exist or is as declared; else SchemaDrift."""
        if found := self.drift(spec):
            raise SchemaDrift(f"{spec.table}: {'; '.join(found)}")
        return self

    def replace_batch(self, df: DataFrame, spec: Spec, batch_id: str) -> None:
        """Put ``df`` in place of one batch, also where it is empty; others stay. Landing one twice changes nothing.

        Refused where the table has drifted from its spec. The rows are written beside the table first, then
        the batch's folder is exchanged by a rename.
        """
        folder = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch_id)
        made, at = f"{self._at(spec)}/_landing/{folder}", f"{self.ensure(spec)._at(spec)}/v=0/_batch_id={folder}"
        require(df, spec).where(F.col("_batch_id") == batch_id).drop("_batch_id").write.mode("overwrite").parquet(made)
        fs, target = self._fs(at)
        fs.mkdirs(target.getParent())
        fs.delete(target, True)
        fs.rename(self._fs(made)[1], target)
        if self.version(spec) is None:
            self._point(spec, 0)

    def append(self, df: DataFrame, spec: Spec) -> None:
        """Add rows to the current version, which must be as declared."""
        self.ensure(spec)
        require(df, spec).write.mode("append").parquet(f"{self._at(spec)}/v={self.version(spec) or 0}")
        if self.version(spec) is None:
            self._point(spec, 0)

    def vacuum(self, spec: Spec) -> int:
        """Delete versions other than the current one; how many went."""
        fs, path = self._fs(self._at(spec))
        if not fs.exists(path):
            return 0
        old = [x.getPath() for x in fs.listStatus(path) if x.isDirectory() and x.getPath().getName() != f"v={self.version(spec)}"]
        return sum(bool(fs.delete(x, True)) for x in old)

    def drop(self, spec: Spec) -> None:
        fs, path = self._fs(self._at(spec))
        fs.delete(path, True)

    def ensure_table(self, spec: Spec) -> str:
        """The name of the catalog table, created from the spec where it is missing; SchemaDrift if it departs from it."""
        self.spark.sql(create_database(spec.layer))
        if not self.spark.catalog.tableExists(spec.table):
            return self.register(spec)
        if found := conformance(self.spark, spec):
            raise SchemaDrift(f"{spec.table}: {'; '.join(found)}")
        return spec.table

    def register(self, spec: Spec) -> str:
        """Create the catalog table over the current version, from the spec's DDL, and return its name."""
        self.spark.sql(create_database(spec.layer))
        self.spark.sql(f"DROP TABLE IF EXISTS {spec.table}")
        n = self.version(spec)
        self.spark.sql(create_table(spec, None if n is None else f"{self._at(spec)}/v={n}"))
        if spec.layer == "bronze" and n is not None:
            self.spark.sql(f"MSCK REPAIR TABLE {spec.table}")
        return spec.table
