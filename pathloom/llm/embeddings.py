"""Embedding near-duplicates: int8 tile products with error bounds, full precision where they cannot decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, sorted_groups, written

BLOCK = 8192
PIVOTS = 256
_ROWS, _COLUMNS, _PAIRS = 1024, 4096, 1 << 16


def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes q and scales s of unit vectors, the norms of s*q, and those of the errors u - s*q."""
    scale = np.abs(u).max(1, keepdims=True) / 127
    q = np.rint(u / scale).astype(np.int8)
    near = q * scale
    return q, scale[:, 0], np.sqrt((near * near).sum(1)), np.sqrt(((u - near) ** 2).sum(1))


def tile_links(u: np.ndarray, v: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine of at least `least`, in parts; of a tile with itself only i < j.

    For u = s q + e, the cosine differs from s_u s_v (q_u . q_v) by at most |s q|_u |e|_v + |e|_u |s q|_v +
    |e|_u |e|_v. The integer product is exact in the float type used, so only pairs whose bound reaches the
    threshold are computed again, in double precision.
    """
    (qu, su, au, eu), (qv, sv, av, ev) = quantise(u), quantise(v)
    kind = np.float32 if 127 * 127 * u.shape[1] < 1 << 24 else np.float64
    fu, fv = qu.astype(kind), qv.astype(kind)
    for a in range(0, len(u), _ROWS):
        for b in range(0, len(v), _COLUMNS):
            if same and b + _COLUMNS <= a:
                continue
            rows, cols = slice(a, a + _ROWS), slice(b, b + _COLUMNS)
            product = fu[rows] @ fv[cols].T
            slack = au[rows].max() * ev[cols].max() + eu[rows].max() * av[cols].max() + eu[rows].max() * ev[cols].max()
            floor = (least - slack - 1e-9) / (su[rows].max() * sv[cols].max())
            i, j = np.nonzero(product >= floor) if least - slack > 0 else np.nonzero(np.ones(product.shape, bool))
            for k in range(0, i.size, _PAIRS):
                x, y = i[k : k + _PAIRS], j[k : k + _PAIRS]
                high = product[x, y].astype(np.float64)
                x, y = x + a, y + b
                bound = high * su[x] * sv[y] + au[x] * ev[y] + eu[x] * av[y] + eu[x] * ev[y]
                keep = bound >= least - 1e-9
                if same:
                    keep &= x < y
                x, y = x[keep], y[keep]
                hit = np.einsum("ij,ij->i", u[x], v[y]) >= least
                if hit.any():
                    yield x[hit], y[hit]


class Forest:
    """Union-find over arrays of pairs that keeps the pairs which joined something."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            i, j = self._find(i), self._find(j)
            new = i != j
            if not new.any():
                return
            i, j = i[new], j[new]
            low, high = np.minimum(i, j), np.maximum(i, j)
            order = np.lexsort((low, high))
            first = np.r_[True, high[order][1:] != high[order][:-1]]
            low, high = low[order][first], high[order][first]  # each root joins its least neighbour
            self.root[high] = low
            self.edges += zip(low.tolist(), high.tolist(), strict=True)

    def _find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if (up == x).all():
                return x
            self.root[x] = self.root[up]
            x = up


def near_duplicates(vectors: DataFrame, least: float = 0.95, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors with columns vec_id and embedding.

    Vectors of equal length whose cosine is at least `least` are linked. Null, empty and zero vectors and
    those with null or non-finite components link with nothing. Equal vectors become one class first, so
    copies cost no pairs. Classes go to their nearest pivot (at most `pivots`, drawn by hash) and each
    pivot's classes to blocks of about `block`; pairs of blocks that the pivots' angles rule out are not
    made. A tile gives counts of links and a spanning forest, never its pairs. Rows that repeat a vec_id
    count as vectors of their own; other columns are ignored.
    """
    one = F.col("embedding")
    valid = F.coalesce(F.size(one) > 0, F.lit(False)) & F.coalesce(F.forall(one, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(one, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(valid, one).alias("embedding"))
    classes = written(rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("class", F.xxhash64("embedding", "rep")), "vectors")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    parts = [_tiles(classes.where(F.size("embedding") == d), d, n, least, block, pivots) for d, n in sorted(sizes.items()) if n > 1]
    if parts:
        links = parts[0]
        for p in parts[1:]:
            links = links.unionByName(p)
        links = written(links, "vector-links")
        more = links.where("b is null").groupBy("a").agg(F.sum("n").alias("more"))
        comps = components(links.where("b is not null"), "a", "b", "vectors")
        joined = classes.join(more, classes["class"] == more["a"], "left").join(comps, classes["class"] == comps["node"], "left")
        joined = joined.select("embedding", "n", "rep", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("component", "class").alias("root"))
        least_id = joined.groupBy("root").agg(F.min("rep").alias("component"))
        classes = joined.join(least_id, "root")
    else:
        classes = classes.select("embedding", "n", "rep", F.lit(0).cast("long").alias("more"), F.col("rep").alias("component"))
    found = rows.where("embedding is not null").join(classes, "embedding").select("vec_id", (F.col("n") - 1 + F.col("more")).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tiles(classes: DataFrame, size: int, total: int, least: float, block: int, pivots: int) -> DataFrame:
    """(a, b, n): forest links (a, b), and for each class with links (a, null, vectors linked in a tile)."""
    count = min(pivots, -(-total // block))
    picked = [r["embedding"] for r in classes.orderBy("class").limit(count).select("embedding").collect()]
    centres = unit(np.array(picked, np.float64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = unit(matrix(pa.chunked_array([batch.column("embedding")]), size)) @ centres.T
                best = cosine.argmax(1)
                angle = np.arccos(np.clip(cosine[np.arange(len(best)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "pivot", "angle"])

    dealt = written(classes.select("embedding", F.col("class").alias("rep"), "n").mapInArrow(assign, f"embedding {classes.schema['embedding'].dataType.simpleString()}, rep long, n long, pivot int, angle double"), "vector-pivots")
    of = {r["pivot"]: (r["c"], r["r"]) for r in dealt.groupBy("pivot").agg(F.count("*").alias("c"), F.max("angle").alias("r")).collect()}
    far = math.acos(max(-1.0, min(1.0, least))) + 1e-6
    between = np.arccos(np.clip(centres @ centres.T, -1, 1))
    blocks = {p: -(-c // block) for p, (c, _) in of.items()}
    pairs = [(a, b, blocks[a], blocks[b]) for a in sorted(of) for b in sorted(of) if a <= b and (a == b or between[a, b] <= of[a][1] + of[b][1] + far)]
    spark = classes.sparkSession
    plan = F.broadcast(spark.createDataFrame(pairs, "a int, b int, m int, k int"))  # at most pivots**2 / 2 rows
    own = dealt.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("pivot"))).cast("int"))
    base = ["embedding", "rep", "n"]
    within = own.join(plan.where("a = b"), own["pivot"] == F.col("a")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    within = within.select(*base, "a", F.least("own", "other").alias("i"), "b", F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"))
    left = own.join(plan.where("a < b"), own["pivot"] == F.col("a")).select(*base, "a", F.col("own").alias("i"), "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"), F.lit(False).alias("right"))
    right = own.join(plan.where("a < b"), own["pivot"] == F.col("b")).select(*base, "a", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), "b", F.col("own").alias("j"), F.lit(True).alias("right"))
    tiles = within.unionByName(left).unionByName(right).repartition("a", "i", "b", "j").sortWithinPartitions("a", "i", "b", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["a", "i", "b", "j"]):
            u = unit(matrix(group.column("embedding"), size))
            rep, n = (group.column(c).to_numpy() for c in ("rep", "n"))
            where = group.column("right").to_numpy(zero_copy_only=False).astype(bool)
            same = not where.any() and group.column("a")[0] == group.column("b")[0] and group.column("i")[0] == group.column("j")[0]
            first, second = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(~where), np.flatnonzero(where))
            if not len(first) or not len(second):
                continue
            trees, linked = Forest(len(rep)), np.zeros(len(rep), np.int64)
            for x, y in tile_links(u[first], u[second], least, same):
                x, y = first[x], second[y]
                trees.add(x, y)
                np.add.at(linked, x, n[y])
                np.add.at(linked, y, n[x])
            if trees.edges:
                a, b = np.array(trees.edges).T
                some = np.flatnonzero(linked)
                empty = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b]), pa.nulls(len(a), pa.int64())], ["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), empty, pa.array(linked[some])], ["a", "b", "n"])

    return tiles.mapInArrow(run, "a long, b long, n long")
