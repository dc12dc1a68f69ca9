"""A catalogue of Parquet tables in layers, with a lineage of every write.

A write goes to a folder of its own and becomes the table by the lineage row that names it, so readers never see half
of one and an earlier state stays readable. The lineage is one more Parquet table, a small file per write.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The layers in their order, and the rule for names.
LAYERS = ("bronze", "silver", "gold")
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
LINEAGE = "write_id long, table string, layer string, name string, action string, version string, n_rows long, n_cols int, sha256 string, types string, written_at timestamp"


def _field(name: str, kind: str) -> Column:
    """A value as text that no other value of the column has: its UTF-8 length, a colon and the value; ``-`` for null. Points in time are microseconds since 1970, whatever the session's zone."""
    c = F.col(f"`{name}`")
    if kind.startswith(("array", "map", "struct")):
        text = F.when(c.isNotNull(), F.to_json(F.struct(c), {"timeZone": "UTC", "ignoreNullFields": "false"}))
    elif kind == "timestamp":
        text = F.unix_micros(c).cast("string")
    elif kind == "binary":
        text = F.hex(c)
    else:
        text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def content_hash(df: DataFrame) -> DataFrame:
    """(n_rows, sha256): a hash of names, types and all rows, whatever their order; rows that repeat count.

    Each row's MD5 over its fields gives a number, and the sums of those enter the hash, so it is one aggregate with
    partial sums in every task. A field tells its length, so values can't run into each other.
    """
    header = ",".join(f"{c}:{t}" for c, t in df.dtypes)
    text = F.concat(F.lit(""), *[_field(c, t) for c, t in df.dtypes])
    value = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,0)")).alias("s"))
    return sums.select("n_rows", F.sha2(F.concat_ws("|", F.lit(header), "n_rows", F.col("s").cast("string")).cast("binary"), 256).alias("sha256"))


class Warehouse:
    """Tables ``<layer>_<name>`` under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, layer: str, name: str) -> str:
        if layer not in LAYERS or not NAME.fullmatch(name):
            raise ValueError(f"no table can be called {layer}_{name}")
        return f"{layer}_{name.lower()}"

    def lineage(self, latest_only: bool = False) -> DataFrame:
        """All writes and drops, or the last write of each table."""
        folder = f"{self.path}/_lineage"
        files = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        known = files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files)
        rows = self.spark.read.schema(LINEAGE).parquet(folder) if known else self.spark.createDataFrame([], LINEAGE)
        if not latest_only:
            return rows
        last = Window.partitionBy("table").orderBy(F.desc("write_id"))
        return rows.where("action = 'write'").withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")

    def _live(self) -> DataFrame:
        last = Window.partitionBy("table").orderBy(F.desc("write_id"))
        return self.lineage().withColumn("__rn", F.row_number().over(last)).where("__rn = 1 AND action = 'write'").drop("__rn")

    def _note(self, table: str, layer: str, name: str, action: str, version: str = "", n: int = 0, cols: int = 0, sha: str = "", types: str = "") -> None:
        row = [(time.time_ns(), table, layer, name.lower(), action, version, n, cols, sha, types)]
        kinds = LINEAGE.rsplit(", ", 1)[0]
        self.spark.createDataFrame(row, kinds).withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/_lineage")

    def write(self, layer: str, name: str, df: DataFrame) -> None:
        """Makes ``df`` the table; ValueError if two of its columns share a name, upper and lower case being one."""
        table = self._table(layer, name)
        if len({c.lower() for c in df.columns}) < len(df.columns):
            raise ValueError(f"{table}: columns share a name")
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{table}/{version}")
        stored = self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}/{version}")
        n, sha = content_hash(stored).first()
        self._note(table, layer, name, "write", version, n, len(df.columns), sha, df.schema.json())

    def read(self, layer: str, name: str) -> DataFrame:
        """The table with the types it was written with; KeyError tells which tables there are."""
        table = self._table(layer, name)
        row = self._live().where(F.col("table") == table).first()
        if row is None:
            raise KeyError(f"{table}; there are {sorted(r.table for r in self._live().select('table').collect())}")
        from pyspark.sql.types import StructType
        import json

        return self.spark.read.schema(StructType.fromJson(json.loads(row.types))).parquet(f"{self.path}/{table}/{row.version}")

    def has(self, layer: str, name: str) -> bool:
        return not self._live().where(F.col("table") == self._table(layer, name)).isEmpty()

    def drop(self, layer: str, name: str, missing_ok: bool = False) -> None:
        """Takes the table from the catalogue; its lineage stays."""
        if not self.has(layer, name):
            if missing_ok:
                return
            raise KeyError(self._table(layer, name))
        self._note(self._table(layer, name), layer, name, "drop")

    def tables(self) -> DataFrame:
        """(table, layer, name, n_rows, n_cols) of all tables, bronze before silver before gold, then by name."""
        rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
        return self._live().orderBy(rank, "name").select("table", "layer", "name", "n_rows", "n_cols")

    def sql(self, query: str) -> DataFrame:
        """A query over the tables by their names."""
        for r in self._live().select("layer", "name", "table").collect():
            self.read(r.layer, r.name).createOrReplaceTempView(r.table)
        return self.spark.sql(query)


def build_medallion(spark: SparkSession, path: str, bronze: Mapping[str, DataFrame], silver: Mapping[str, DataFrame], gold: Mapping[str, DataFrame]) -> Warehouse:
    """A catalogue of raw, cleaned and final tables."""
    house = Warehouse(spark, path)
    for layer, tables in zip(LAYERS, (bronze, silver, gold), strict=True):
        for name, df in tables.items():
            house.write(layer, name, df)
    return house


def write_reports(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each small report as one CSV file with a header in a folder of its name."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}.csv")


def write_decisions(df: DataFrame, folder: str) -> None:
    """A decision frame as Parquet."""
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/decision_frame.parquet")
