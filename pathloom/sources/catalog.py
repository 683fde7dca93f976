"""Tables with keys, foreign keys and time columns, and how to read and write them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableMeta:
    """Primary key and time column are optional; fks maps a column to the table that it points to."""

    name: str
    pk: str | None = None
    time: str | None = None
    fks: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for part in (self.name, *self.fks):
            if "__" in part:
                raise ValueError(f"{part}: a double underscore separates the parts of path names")


SHOP = {
    t.name: t
    for t in (
        TableMeta("region", "r_regionkey"),
        TableMeta("nation", "n_nationkey", fks={"n_regionkey": "region"}),
        TableMeta("customer", "c_custkey", fks={"c_nationkey": "nation"}),
        TableMeta("supplier", "s_suppkey", fks={"s_nationkey": "nation"}),
        TableMeta("part", "p_partkey"),
        TableMeta("orders", "o_orderkey", "o_orderdate", {"o_custkey": "customer"}),
        TableMeta("lineitem", None, "l_shipdate", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
        TableMeta("events", "event_id", "ts", {"user_id": "customer"}),
    )
}


class Database:
    """A folder of Parquet tables with their metadata, and frames registered beside them."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, TableMeta] | None = None):
        self.spark, self.path, self.tables = spark, path, dict(tables or SHOP)
        self.frames: dict[str, DataFrame] = {}
        self._read: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        """The table; its files are listed once, however many steps read it."""
        if name in self.frames:
            return self.frames[name]
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._read[name]

    def add(self, meta: TableMeta, frame: DataFrame) -> None:
        """Register a frame as a table of this database, in place of a file of that name."""
        self.tables[meta.name] = meta
        self.frames[meta.name] = frame
        frame.createOrReplaceTempView(meta.name)

    def meta(self, name: str) -> TableMeta:
        return self.tables[name]

    def keyed(self, name: str) -> DataFrame:
        """The table with _rowid, a long for each row: its primary key, or else the row's place.

        A file's row is told by the file's rank among the table's files and its index in the file, so equal rows
        stay apart and nothing is shuffled. Rows of a registered frame without a key get a hash of their
        columns and a number among equal ones.
        """
        meta, df = self.tables[name], self.read(name)
        if meta.pk:
            return df.withColumn("_rowid", F.col(meta.pk).cast("long"))
        if name in self.frames:
            same = Window.partitionBy("_hash").orderBy(*[F.col(c) for c in df.columns])
            return df.withColumn("_hash", F.xxhash64(*df.columns)).withColumn("_rowid", F.xxhash64("_hash", F.row_number().over(same))).drop("_hash")
        index = F.col("_metadata.row_index")
        files = sorted(df.inputFiles())
        if len(files) <= 1:
            return df.withColumn("_rowid", index)
        plain = lambda f: re.sub("^([a-z0-9]+):/+", r"\1:/", f)
        ranks = self.spark.createDataFrame([(plain(f), k) for k, f in enumerate(files)], "_file string, _rank long")
        placed = df.withColumns({"_index": index, "_file": F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):/+", "$1:/")})
        ranks = F.broadcast(ranks) if len(files) <= 50_000 else ranks
        rank = F.coalesce("_rank", F.raise_error(F.concat(F.lit("not a file of the table: "), "_file")).cast("long"))
        return placed.join(ranks, "_file", "left").withColumn("_rowid", F.shiftleft(rank, 40) + F.col("_index")).drop("_file", "_index", "_rank")

    def register(self, *names: str) -> None:
        """Temporary views, so that SQL text can name the tables."""
        for name in names or self.tables:
            self.read(name).createOrReplaceTempView(name)

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def columns(self, name: str) -> list[tuple[str, str]]:
        """Names and types of a table's columns."""
        return self.read(name).dtypes

    def foreign_keys(self, name: str) -> list[tuple[str, str]]:
        """Columns of a table that point to another, and that table."""
        return sorted(self.tables[name].fks.items())


def infer_task_schema(columns: list[str], fks: list[str], time: str | None) -> tuple[str, str, str]:
    """(entity, time, label) of a task table: its first foreign key, its time column, and the one column left."""
    if not fks:
        raise ValueError("a task table needs a foreign key to its entity")
    if time is None:
        raise ValueError("a task table needs a time column")
    left = [c for c in columns if c not in (fks[0], time)]
    if len(left) != 1:
        raise ValueError(f"a task table has exactly one label column; here: {left}")
    return fks[0], time, left[0]


def largest_file(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".duckdb", ".db")) -> str | None:
    """The largest file of these kinds in a folder of any Hadoop file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    files = [(f.getLen(), f.getPath().toString()) for f in found if f.getPath().getName().endswith(suffixes)]
    return max(files)[1] if files else None


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv_columns(spark: SparkSession, path: str, schema: str, wanted: list[str]) -> DataFrame:
    """CSV with a fixed schema; the reader parses only the wanted columns."""
    return spark.read.option("header", True).schema(schema).csv(path).select(*wanted)


def count_columns(df: DataFrame) -> list[str]:
    """Statistic columns of an exported table."""
    return [c for c in df.columns if "__cnt_" in c]


def label_column(columns: list[str]) -> str:
    for name in ("label", "WillGetBadge"):
        if name in columns:
            return name
    raise ValueError("no label column")


def path_parts(path: Column) -> list[Column]:
    """Batch and hop numbers that a path's folders name."""
    return [F.regexp_extract(path, r"batch_(\d+)", 1).cast("int").alias("batch"), F.regexp_extract(path, r"hop_(\d+)", 1).cast("int").alias("hop")]


def read_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Lines of text files that match a regular expression."""
    return spark.read.text(path).where(F.col("value").rlike(pattern))


def read_schema_cache(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def schema_cache(df: DataFrame) -> str:
    return json.dumps(json.loads(df.schema.json()), sort_keys=True)
