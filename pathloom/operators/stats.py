"""Statistics of frontiers for each seed event: count, log count, rate and log rate, in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Database
from .cut import cut
from .frontier import SEED, along, extend, followed, start, to_one, unique_step
from .graph import Path, feature_name, is_reverse, path_name


def counts(db: Database, seeds: DataFrame, path: Path) -> DataFrame:
    """(SeedId, ts, cnt): distinct rows at the end of the path, for seeds that have any."""
    return ends(db, seeds, path, F.count("*").alias("cnt"))


def ends(db: Database, seeds: DataFrame, path: Path, *values: Column) -> DataFrame:
    """(SeedId, ts, ...): aggregates of the distinct rows (last_id) at the end of the path, for seeds that have any.

    After forward steps many seeds stand on the same row at the same time. The last reverse step is then
    aggregated once for each (row, time) and joined back: the step's rows never multiply with the seeds.
    """
    if shared(path):
        at = along(db, seeds, path[:-1]).withColumnRenamed("last_id", "_at")
        own = at.select(F.col("_at").alias("SeedId"), "ts", F.col("_at").alias("last_id")).distinct()
        each = extend(db, own, path[-1], distinct=False).groupBy(*SEED).agg(*values).withColumnRenamed("SeedId", "_at")
        return at.join(each, ["_at", "ts"]).select(*SEED, *each.columns[2:])
    return along(db, seeds, path).groupBy(*SEED).agg(*values)


def log_count(cnt: Column) -> Column:
    return F.log1p(cnt.cast("double"))


def rate(child: Column, parent: Column | None) -> Column:
    """The count itself on the first hop; then child over parent, 0 without a parent."""
    if parent is None:
        return child.cast("double")
    return F.when(F.coalesce(parent, F.lit(0)) == 0, 0.0).otherwise(child.cast("double") / parent)


def with_parent(child: DataFrame, parent: DataFrame) -> DataFrame:
    """(SeedId, ts, cnt, parent): the union of both sides' seeds."""
    return child.join(parent.withColumnRenamed("cnt", "parent"), SEED, "full_outer")


def strategies(child: Column, parent: Column | None) -> list[Column]:
    r = rate(child, parent)
    return [child.alias("cnt"), log_count(child).alias("log_count"), r.alias("rate"), F.log1p(r).alias("log_rate")]


def shared(path: Path) -> bool:
    """Whether ends() aggregates the last step once for each row and time, not for each seed."""
    return len(path) > 1 and to_one(path[:-1]) and is_reverse(path[-1][1])


def all_counts(db: Database, seeds: DataFrame, paths: list[Path]) -> DataFrame:
    """(SeedId, ts, c0, c1, …): the counts() of each path, 0 where one reaches nothing; seeds that reach something.

    The paths' trie is walked once: a frontier that several paths go on from is written out and read by all
    of them. All counts come from one aggregation over the frontiers together.
    """
    walked = {p for p in paths if not shared(p)}
    needed = {p[:k] for p in walked for k in range(1, len(p) + 1)}
    uses = {p: (p in walked) + sum(1 for q in needed if q[:-1] == p) for p in needed}
    at: dict[Path, DataFrame] = {(): start(db, seeds, paths[0][0][0], timed=False)}
    for p in sorted(needed, key=len):
        onwards = followed(tuple(q[-1] for q in needed if q[:-1] == p))
        reached = extend(db, at[p[:-1]], p[-1], distinct=not unique_step(p[-1], p[:-1]), carry=onwards)
        at[p] = cut(reached) if uses[p] > 1 else reached
    parts = []
    for k, p in enumerate(paths):
        own = counts(db, seeds, p) if shared(p) else at[p].select(*SEED, F.lit(1).cast("long").alias("cnt"))
        parts.append(own.select(*SEED, F.lit(k).alias("_k"), "cnt"))
    together = reduce(DataFrame.unionByName, parts)
    return together.groupBy(*SEED).agg(*[F.coalesce(F.sum(F.when(F.col("_k") == k, F.col("cnt"))), F.lit(0)).alias(f"c{k}") for k in range(len(paths))])


def long(db: Database, seeds: DataFrame, paths: list[Path]) -> DataFrame:
    """(SeedId, ts, label, hop, prefix, feature, cnt, parent): every seed and feature, zero where nothing is reached.

    hop and prefix are those of the path without its last step, which is the extension that is judged. Columns
    of seeds beyond these (a batch) stay. One join brings all counts to the seeds.
    """
    every = list(dict.fromkeys([*paths, *(p[:-1] for p in paths if len(p) > 1)]))
    place = {p: k for k, p in enumerate(every)}
    zero = F.lit(0).cast("long")
    rows = [
        F.struct(
            F.lit(len(p) - 1).alias("hop"), F.lit(path_name(p[:-1]) if len(p) > 1 else p[0][0]).alias("prefix"), F.lit(feature_name(p)).alias("feature"),
            F.coalesce(F.col(f"c{place[p]}"), zero).alias("cnt"), (F.coalesce(F.col(f"c{place[p[:-1]]}"), zero) if len(p) > 1 else zero).alias("parent"),
        )
        for p in paths
    ]
    joined = seeds.join(all_counts(db, seeds, every), SEED, "left")
    return joined.select(*seeds.columns, F.inline(F.array(*rows)))


def hop_sizes(long: DataFrame) -> DataFrame:
    """(hop, batch_id, n_seeds, mean_rows, most_rows): rows that a batch's seeds reach at each hop, over all its paths."""
    by = long.groupBy("hop", "batch_id", *SEED).agg(F.sum("cnt").alias("n"))
    return by.groupBy("hop", "batch_id").agg(F.count("*").alias("n_seeds"), F.avg("n").alias("mean_rows"), F.max("n").alias("most_rows"))


def wide(db: Database, seeds: DataFrame, paths: list[Path], strategy: str = "log_count") -> DataFrame:
    """Seeds with one 0-filled column for each path."""
    out = seeds
    for path in paths:
        child = counts(db, seeds, path)
        if strategy in ("rate", "log_rate") and len(path) > 1:
            both = with_parent(child, counts(db, seeds, path[:-1]))
            value = strategies(F.col("cnt"), F.col("parent"))
        else:
            both, value = child, strategies(F.col("cnt"), None)
        chosen = dict(zip(("cnt", "log_count", "rate", "log_rate"), value, strict=True))[strategy]
        column = feature_name(path)
        out = out.join(both.select(*SEED, chosen.alias(column)), SEED, "left").withColumn(column, F.coalesce(column, F.lit(0)))
    return out
