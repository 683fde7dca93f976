"""Frontiers: the rows that a seed event reaches along a metapath, seen from its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Database
from .graph import Edge, Path, fk_column, is_reverse

SEED = ["SeedId", "ts"]


def start(db: Database, seeds: DataFrame, table: str, timed: bool = True) -> DataFrame:
    """(SeedId, ts, last_id): the seeds' own rows; those of a table with times only if earlier than the seed.

    timed=False is the form without a look at the table: every seed, whatever its row's time.
    """
    meta = db.meta(table)
    if not timed:
        return seeds.select(*SEED, F.col("SeedId").alias("last_id"))
    rows = db.read(table).select(F.col(meta.pk).cast("long").alias("SeedId"), *([F.col(meta.time).alias("_time")] if meta.time else []))
    joined = seeds.select(*SEED).join(rows, "SeedId")
    if meta.time:
        joined = joined.where(F.col("_time") < F.col("ts"))
    return joined.select(*SEED, F.col("SeedId").alias("last_id"))


def extend(db: Database, frontier: DataFrame, edge: Edge, distinct: bool = True, inclusive: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The frontier one edge further; the time of each row reached must be before the seed's (or at it).

    Forward steps take the row's foreign key, from the frontier if it carries that or else from the table;
    reverse steps look up the rows that point at the last. `carry` names foreign keys of the table reached that
    later steps follow: they come along, so that those steps need not join the table again.
    """
    src, rel, dst = edge
    column = fk_column(rel)
    target = db.meta(dst)
    time = [F.col(target.time).alias("_time")] if target.time else []
    keys = [F.col(c).cast("long").alias(c) for c in carry]
    if is_reverse(rel):
        rows = db.keyed(dst).select(F.col(column).cast("long").alias("last_id"), F.col("_rowid").alias("_next"), *time, *keys)
        joined = frontier.select(*SEED, "last_id").join(rows, "last_id")
    else:
        if not target.pk:
            raise ValueError(f"{dst} has no primary key to follow {rel} to")
        if column in frontier.columns:
            joined = frontier.select(*SEED, F.col(column).alias("_next")).where("_next is not null")
        else:
            at = db.keyed(src).select(F.col("_rowid").alias("last_id"), F.col(column).cast("long").alias("_next"))
            joined = frontier.select(*SEED, "last_id").join(at, "last_id")
        parent = db.read(dst).select(F.col(target.pk).cast("long").alias("_next"), *time, *keys)
        joined = joined.distinct() if distinct and column in frontier.columns else joined
        joined = joined.join(parent, "_next") if time or keys else joined.join(parent, "_next", "left_semi")
    if target.time:
        joined = joined.where(F.col("_time") <= F.col("ts") if inclusive else F.col("_time") < F.col("ts"))
    out = joined.select(*SEED, F.col("_next").alias("last_id"), *carry)
    return out.distinct() if distinct and (is_reverse(rel) or column not in frontier.columns) else out


def unique_step(edge: Edge, before: Path) -> bool:
    """Whether rows reached over the edge cannot repeat: reverse steps give each child once, and so does a
    forward step from the seed's own row."""
    return is_reverse(edge[1]) or not before


def along(db: Database, seeds: DataFrame, path: Path, timed: bool = False) -> DataFrame:
    """The frontier at the end of a path; distinct only where the keys do not already make it so."""
    out = start(db, seeds, path[0][0], timed)
    for k, edge in enumerate(path):
        out = extend(db, out, edge, distinct=not unique_step(edge, path[:k]), carry=followed(path[k + 1 : k + 2]))
    return out


def whole(db: Database, seeds: DataFrame, path: Path) -> DataFrame:
    """The frontier at the end of a path, distinct by its values: repeated keys give no row twice."""
    return packed(db, seeds, path).select(*SEED, F.explode("rows").alias("last_id"))


def packed(db: Database, seeds: DataFrame, path: Path) -> DataFrame:
    """(SeedId, ts, rows): whole() with each seed's last_ids in up to 64 arrays, none of them twice.

    After forward steps a few places (sets of rows) hold all the seeds. Where the last step looks at no time, each
    place's distinct rows are found once and broadcast; every seed gets all of its place's rows in the task that it
    is in, so neither `distinct` nor an aggregate for each seed shuffles them. Rows grow with the square of a
    place's size, so where the broadcast would be too large the result is far out of reach.
    """
    if db.meta(path[-1][2]).time or not to_one(path[:-1]) or not is_reverse(path[-1][1]):
        return _pack(along(db, seeds, path).distinct(), SEED)
    at = along(db, seeds, path[:-1]).repartition(8 * db.spark.sparkContext.defaultParallelism, *SEED)  # few bytes, many rows to come
    at = at.groupBy(*SEED).agg(F.sort_array(F.collect_set("last_id")).alias("_at"))
    places = at.select(F.col("_at").alias("SeedId"), F.lit(None).cast("timestamp_ntz").alias("ts")).distinct()
    rows = _pack(extend(db, places.withColumn("last_id", F.explode("SeedId")), path[-1]).withColumnRenamed("SeedId", "_at"), ["_at"])
    return at.join(F.broadcast(rows), "_at").select(*SEED, "rows")


def _pack(frontier: DataFrame, key: list[str]) -> DataFrame:
    lists = frontier.groupBy(*key, F.pmod(F.xxhash64("last_id"), F.lit(64))).agg(F.collect_list(F.struct("last_id")).alias("rows"))
    return lists.select(*key, F.col("rows.last_id").alias("rows"))  # a list of structs keeps null ids


def followed(edges: Path) -> tuple[str, ...]:
    """Foreign keys that forward edges follow."""
    return tuple(sorted({fk_column(e[1]) for e in edges if not is_reverse(e[1])}))


def to_one(path: Path) -> bool:
    return all(not is_reverse(e[1]) for e in path)
