"""Shared pieces of the text operators: Arrow batches, written intermediates, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
FEW_EDGES = 200_000


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of this session have at most so many rows: whole texts are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores if it has fewer files than that: a file of one row group
    is one task's work however many splits are planned for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a folder of its own; a cluster gets an error, as its executors
    would each write to their own disks.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: short lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pathloom_path = path  # type: ignore[attr-defined]
    return out


def forget(df: DataFrame) -> None:
    """Delete what written() left; only once nothing reads it any more."""
    path = getattr(df, "_pathloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def private(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column holds about `limit` bytes; a longer text comes alone."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from batches sorted by them; a group may span batches."""
    kept: list[pa.Table] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = pa.Table.from_batches([batch])
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield pa.concat_tables(kept)
                kept = []
            kept.append(now.slice(a, b - a))
            last = key
    if kept:
        yield pa.concat_tables(kept)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the graph on 0..n-1 in which near(i, others) marks i's neighbours among others."""
    edges: list[tuple[int, int]] = []
    left = np.arange(n)
    while left.size:
        queue, left = [int(left[0])], left[1:]
        while queue and left.size:
            at = queue.pop()
            hit = near(at, left)
            if hit.any():
                found = left[hit].tolist()
                edges += [(at, x) for x in found]
                queue += found
                left = left[~hit]
    return edges


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) together."""
    pairs = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()], 1) for b in batches if b.num_rows]
    if not pairs:
        return
    nodes, ends = np.unique(np.concatenate(pairs), return_inverse=True)
    ends = ends.reshape(-1, 2)
    root = np.arange(nodes.size)
    while True:  # the nodes are in order, so the least place is the least node
        low = root[ends].min(1)
        new = root.copy()
        for end in (0, 1):
            np.minimum.at(new, root[ends[:, end]], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    for k in range(0, nodes.size, 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 50_000]), pa.array(nodes[root[k : k + 50_000]])], ["node", "component"])


def components(edges: DataFrame, a: str, b: str, label: str = "components", few: int = FEW_EDGES) -> DataFrame:
    """(node, component): the least node reachable by edges, for nodes that have any.

    Alternating large-star and small-star steps; every step is an aggregation (partial on the map
    side, so hubs are harmless) and a join that AQE may split. Each round is written to the shared
    folder and the one before it deleted. At most `few` edges, as counted, are united by one task
    instead: the same result in one step.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), label)
    sign = _sign(now)
    if 0 < sign[0] <= few:
        out = written(now.repartition(1).mapInArrow(_united, "node long, component long"), label)
        forget(now)
        return out
    while sign[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = written(small, label)
        forget(now)
        now, before, sign = nxt, sign, _sign(nxt)
        if sign == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _sign(df: DataFrame) -> tuple:
    x = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (x["n"], x["h"])
