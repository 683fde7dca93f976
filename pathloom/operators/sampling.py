"""Temporal neighbourhood sampling over the instance graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import Database
from .cut import cut

KEY = ["SeedId", "ts"]
NODE = ["type", "id"]
SHARED = 64  # neighbours; a seed with more is walked on its own


def nodes(db: Database, tables: list[str]) -> DataFrame:
    """(type, id, time); rows of a table without a primary key are nodes by their place."""
    out = []
    for name in tables:
        meta = db.meta(name)
        time = F.col(meta.time) if meta.time else F.lit(None).cast("timestamp_ntz")
        out.append(db.keyed(name).select(F.lit(name).alias("type"), F.col("_rowid").alias("id"), time.alias("time")))
    return reduce(DataFrame.unionByName, out)


def edges(db: Database, tables: list[str], undirected: bool = True) -> DataFrame:
    """(src_type, src, rel, dst_type, dst): a row for each foreign key, and its reverse."""
    out = []
    for name in tables:
        meta = db.meta(name)
        for column, parent in meta.fks.items():
            if parent in tables:
                rows = db.keyed(name).where(F.col(column).isNotNull()).select(F.col("_rowid").alias("c"), F.col(column).cast("long").alias("p"))
                out.append(rows.select(F.lit(name).alias("src_type"), F.col("c").alias("src"), F.lit(f"f2p_{column}").alias("rel"), F.lit(parent).alias("dst_type"), F.col("p").alias("dst")))
                if undirected:
                    out.append(rows.select(F.lit(parent).alias("src_type"), F.col("p").alias("src"), F.lit(f"rev_f2p_{column}").alias("rel"), F.lit(name).alias("dst_type"), F.col("c").alias("dst")))
    return reduce(DataFrame.unionByName, out)


def draw(salt: str):  # noqa: ANN201
    return F.md5(F.concat_ws("|", F.lit(salt), F.col("SeedId").cast("string"), F.col("ts").cast("string"), "dst_type", F.col("dst").cast("string")))


def fan_out(seeds: DataFrame, graph: DataFrame, times: DataFrame, fanouts: list[int], salt: str = "n") -> DataFrame:
    """(SeedId, ts, hop, type, id, via, from_type, from_id): at most fanouts[hop] neighbours of each node and
    relation, none later than the seed; -1 takes all. Each seed's sample is its own.

    Nodes and times are joined once to the edges, so the hop loop joins one table.
    """
    timed = graph.join(times.select(F.col("type").alias("dst_type"), F.col("id").alias("dst"), "time"), ["dst_type", "dst"])
    level = seeds.select("SeedId", "ts", F.col("type").alias("src_type"), F.col("SeedId").alias("src"))
    out = None
    for hop, fan in enumerate(fanouts):
        if fan == 0:
            break
        step = level.join(timed, ["src_type", "src"]).where(F.col("time").isNull() | (F.col("time") <= F.col("ts")))
        if fan > 0:
            w = Window.partitionBy("SeedId", "ts", "src_type", "src", "rel").orderBy(draw(f"{salt}{hop}"), "dst_type", "dst")
            step = step.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= fan).drop("_k")
        step = step.select("SeedId", "ts", F.lit(hop + 1).alias("hop"), F.col("dst_type").alias("type"), F.col("dst").alias("id"), F.col("rel").alias("via"), F.col("src_type").alias("from_type"), F.col("src").alias("from_id"))
        out = step if out is None else out.unionByName(step)
        level = step.select("SeedId", "ts", F.col("type").alias("src_type"), F.col("id").alias("src")).distinct()
    return out


def size_stats(sample: DataFrame) -> DataFrame:
    """(n_seeds, mean_nodes, std_nodes, mean_edges, std_edges) of the sampled subgraphs, without their seeds."""
    by = sample.groupBy("SeedId", "ts").agg(F.countDistinct(*NODE).alias("n"), F.count("*").alias("e"))
    return by.agg(F.count("*").alias("n_seeds"), F.avg("n").alias("mean_nodes"), F.stddev_pop("n").alias("std_nodes"), F.avg("e").alias("mean_edges"), F.stddev_pop("e").alias("std_edges"))


def _shared(first: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Seeds with the same first neighbours (and equal in `by`) stand for one another: (SeedId, ts, _seed, _ts), the
    seed that stands for each, and the rows (SeedId, ts, type, id, ...) of `first` for those that do."""
    size = first.groupBy(*KEY).agg(F.count("*").alias("_n"))
    few = first.join(size.where(F.col("_n") <= SHARED), KEY).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(*NODE))).alias("_set"))
    one = few.groupBy("_set", *by).agg(F.min(F.struct(*KEY)).alias("_one"))
    alike = few.join(one, ["_set", *by]).select(*KEY, F.col("_one.SeedId").alias("_seed"), F.col("_one.ts").alias("_ts"))
    own = size.where(F.col("_n") > SHARED).select(*KEY, F.col("SeedId").alias("_seed"), F.col("ts").alias("_ts"))
    members = cut(alike.unionByName(own))
    return members, first.join(members.where("SeedId = _seed and ts = _ts").select(*KEY), KEY, "left_semi")


def _given(members: DataFrame, seeds: DataFrame, found: DataFrame) -> DataFrame:
    """Rows found for the seeds that stand for others, for each seed, without the seed itself. Only here do rows
    multiply; nothing is shuffled after it."""
    types = seeds.groupBy(*KEY).agg(F.collect_set("type").alias("_types"))
    told = found.withColumnsRenamed({"SeedId": "_seed", "ts": "_ts"}).repartition(_tasks(found))  # few bytes, many rows to come
    all_ = told.join(cut(members.join(types, KEY)), ["_seed", "_ts"])
    return all_.where(~((F.col("id") == F.col("SeedId")) & F.array_contains("_types", F.col("type")))).drop("_seed", "_ts", "_types")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _walked(seeds: DataFrame, graph: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(SeedId, ts, _seed, _ts) as _shared() gives it, and (SeedId, ts, type, id, hop) from hop 1 on of the seeds that
    stand for others.

    The distance from a seed to another node is one more than that from its first neighbours, so seeds that
    have the same ones reach the same nodes at the same distances, but for themselves.
    """
    start = seeds.select(*KEY, F.col("type").alias("src_type"), F.col("SeedId").alias("src")).join(graph, ["src_type", "src"])
    first = cut(start.select(*KEY, F.col("dst_type").alias("type"), F.col("dst").alias("id")).distinct())
    members, level = _shared(first, [])
    level = seen = level.withColumn("hop", F.lit(1))
    for hop in range(2, hops + 1):
        step = level.withColumnsRenamed({"type": "src_type", "id": "src"}).drop("hop").join(graph, ["src_type", "src"])
        step = step.select(*KEY, F.col("dst_type").alias("type"), F.col("dst").alias("id")).distinct()
        level = step.join(seen, [*KEY, *NODE], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(level)
    return members, seen


def bfs(seeds: DataFrame, graph: DataFrame, hops: int) -> DataFrame:
    """(SeedId, ts, type, id, hop): nodes within so many steps of each seed, at their least distance. Seeds with the
    same first neighbours are walked once."""
    zero = seeds.select(*KEY, "type", F.col("SeedId").alias("id"), F.lit(0).alias("hop"))
    if hops < 1:
        return zero
    members, seen = _walked(seeds, graph, hops)
    return zero.unionByName(_given(members, seeds, seen).select(zero.columns))


def bfs_buckets(seeds: DataFrame, graph: DataFrame, hops: int) -> DataFrame:
    """buckets(bfs(...)), counted without a row for each seed and node: the counts of the seed that stands for
    others, less the seed itself where it is among the nodes."""
    members, seen = _walked(seeds, graph, hops)
    seen = cut(seen).withColumnsRenamed({"SeedId": "_seed", "ts": "_ts"})
    each = members.join(seen.groupBy("_seed", "_ts", "hop").agg(F.count("*").alias("n")), ["_seed", "_ts"]).select(*KEY, "hop", "n")
    self = members.join(seeds.select(*KEY, "type", F.col("SeedId").alias("id")).distinct(), KEY).join(seen, ["_seed", "_ts", *NODE])
    self = self.groupBy(*KEY, "hop").agg(F.count("*").alias("_self"))
    return each.join(self, [*KEY, "hop"], "left").select(*KEY, "hop", (F.col("n") - F.coalesce("_self", F.lit(0))).alias("n")).where("n > 0")


def buckets(reached: DataFrame) -> DataFrame:
    return reached.where("hop > 0").groupBy("SeedId", "ts", "hop").agg(F.count("*").alias("n"))


def quota(sizes: DataFrame, budget: int) -> DataFrame:
    """sizes with the quota of each hop: shares of the budget by size, rounded down, what is left to the
    largest fractions, the nearer hop first."""
    seed = Window.partitionBy("SeedId", "ts")
    out = sizes.withColumn("_total", F.sum("n").over(seed))
    exact = F.lit(budget) * F.col("n")
    out = out.withColumn("_floor", F.expr(f"({budget} * n) div _total")).withColumn("_rest", F.pmod(exact, F.col("_total")))
    out = out.withColumn("_left", F.lit(budget) - F.sum("_floor").over(seed)).withColumn("_rank", F.row_number().over(seed.orderBy(F.col("_rest").desc(), "hop")))
    return out.select("SeedId", "ts", "hop", "n", (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("quota"))


def tokens(reached: DataFrame, times: DataFrame, budget: int, max_hop: int, salt: str = "t") -> DataFrame:
    """(SeedId, ts, pos, type, id, hop, days): the seed, then budget - 1 tokens, always as many.

    With enough neighbours each hop gives its quota, drawn without repeats; with fewer they go round again in
    the same order; without any, padding of type '#pad' and hop max_hop + 1. days counts back from the seed
    (0 where a table has no time, -1 for padding).
    """
    key = ["SeedId", "ts"]
    near = reached.where("hop > 0")
    want = budget - 1
    order = F.md5(F.concat_ws("|", F.lit(salt), F.col("SeedId").cast("string"), F.col("ts").cast("string"), "type", F.col("id").cast("string")))
    drawn = near.withColumn("_key", order).withColumn("_k", F.row_number().over(Window.partitionBy(*key, "hop").orderBy("_key", "type", "id")))
    total = F.count("*").over(Window.partitionBy(*key))
    drawn = drawn.withColumn("_total", total).join(quota(buckets(reached), want), [*key, "hop"])
    many = drawn.where((F.col("_total") >= want) & (F.col("_k") <= F.col("quota")))
    few = drawn.where(F.col("_total") < want)
    pos = F.row_number().over(Window.partitionBy(*key).orderBy("hop", "_key", "type", "id"))
    cols = [*key, "pos", "type", "id", "hop"]
    picked = many.withColumn("pos", pos).select(*cols)
    again = few.withColumn("_pos", pos).withColumn("pos", F.explode(F.sequence(F.col("_pos"), F.lit(want), F.col("_total").cast("int")))).select(*cols)
    seeds = reached.where("hop = 0").select(*key, F.lit(0).alias("pos"), "type", "id", "hop")
    alone = reached.where("hop = 0").select(*key).join(near.select(*key).distinct(), key, "left_anti")
    pad = alone.select(*key, F.explode(F.sequence(F.lit(1), F.lit(want))).alias("pos"), F.lit("#pad").alias("type"), F.lit(0).cast("long").alias("id"), F.lit(max_hop + 1).alias("hop"))
    found = seeds.unionByName(picked).unionByName(again).unionByName(pad)
    days = F.when(F.col("type") == "#pad", -1.0).when((F.col("pos") == 0) | F.col("time").isNull(), 0.0)
    days = days.otherwise(F.greatest(F.lit(0.0), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("time").cast("timestamp"))) / 86400e6))
    return found.join(times, NODE, "left").select(*cols, days.alias("days"))


def induced(found: DataFrame, graph: DataFrame) -> DataFrame:
    """(SeedId, ts, src_pos, dst_pos): edges among a seed's tokens; a node that is there twice counts at its last place."""
    last = found.where("type <> '#pad'").groupBy("SeedId", "ts", *NODE).agg(F.max("pos").alias("pos"))
    a = last.withColumnsRenamed({"type": "src_type", "id": "src", "pos": "src_pos"})
    b = last.withColumnsRenamed({"type": "dst_type", "id": "dst", "pos": "dst_pos"})
    return a.join(graph, ["src_type", "src"]).join(b, ["SeedId", "ts", "dst_type", "dst"]).select("SeedId", "ts", "src_pos", "dst_pos").distinct()


def offsets(db: Database, tables: list[str]) -> DataFrame:
    """(type, n, offset): where each type's nodes begin when all types stand in a row, by name."""
    n = nodes(db, tables).groupBy("type").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("type").rowsBetween(Window.unboundedPreceding, -1)  # one row a type
    return n.select("type", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def hop_histogram(found: DataFrame, max_hop: int) -> DataFrame:
    pad = F.col("type") == "#pad"
    return found.groupBy("hop").agg(F.count("*").alias("n"), F.sum(pad.cast("long")).alias("n_pad"), F.sum((~pad & (F.col("hop") == max_hop + 1)).cast("long")).alias("n_fallback"))


def two_hop(seeds: DataFrame, graph: DataFrame, times: DataFrame, cap1: int | None = 5000, cap2: int | None = 1000, salt: str = "c") -> DataFrame:
    """(SeedId, ts, type, id, hop, days, n_links): first and second neighbours no later than the seed.

    At most cap1 first and cap2 second neighbours of a node are followed, in a repeatable random order of each
    seed's own; None follows all, and then seeds of one time with the same first neighbours are walked once.
    Second neighbours leave out the seed and the first; n_links counts the first neighbours that lead to one.
    """
    timed = graph.join(times.select(F.col("type").alias("dst_type"), F.col("id").alias("dst"), "time"), ["dst_type", "dst"])

    def step(level: DataFrame, cap: int | None, n: int) -> DataFrame:
        ok = level.join(timed, ["src_type", "src"]).where(F.col("time").isNull() | (F.col("time") <= F.col("ts")))
        if cap is None:
            return ok
        w = Window.partitionBy(*KEY, "src_type", "src").orderBy(draw(f"{salt}{n}"), "dst_type", "dst")
        return ok.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap)

    days = F.when(F.col("time").isNull(), 0.0).otherwise((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("time").cast("timestamp"))) / 86400e6).alias("days")
    first = step(seeds.select(*KEY, F.col("type").alias("src_type"), F.col("SeedId").alias("src")), cap1, 1)
    one = cut(first.select(*KEY, F.col("dst_type").alias("type"), F.col("dst").alias("id"), F.lit(1).alias("hop"), days).distinct())
    members, start = _shared(one, ["ts"]) if cap2 is None else (None, one)
    second = step(start.select(*KEY, F.col("type").alias("src_type"), F.col("id").alias("src")), cap2, 2)
    two = second.groupBy(*KEY, F.col("dst_type").alias("type"), F.col("dst").alias("id")).agg(F.max(days).alias("days"), F.count_distinct("src_type", "src").alias("n_links"))
    two = two.join(start, [*KEY, *NODE], "left_anti")
    if members is not None:
        two = _given(members, seeds, two)
    else:
        two = two.join(seeds.select(*KEY, "type", F.col("SeedId").alias("id")), [*KEY, *NODE], "left_anti")
    return one.withColumn("n_links", F.lit(0).cast("long")).unionByName(two.withColumn("hop", F.lit(2)))
