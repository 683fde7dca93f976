"""Token sequences as one row a seed, with arrays: what a trainer reads in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["SeedId", "ts"]


def pack(tokens: DataFrame, edges: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(SeedId, ts, types, indices, hops, times, edge_src, edge_dst) from token rows and their induced edges.

    Types become the vocabulary's numbers, padding the number after the last. A seed has as many tokens as the
    budget, so rows stay small however many seeds there are.
    """
    numbers = F.create_map(*[F.lit(x) for pair in [*vocabulary.items(), ("#pad", len(vocabulary))] for x in pair])
    step = F.struct("pos", F.element_at(numbers, F.col("type")).cast("short").alias("t"), F.col("id").alias("i"), F.col("hop").cast("tinyint").alias("h"), F.col("days").cast("float").alias("d"))
    rows = tokens.groupBy(*KEY).agg(F.array_sort(F.collect_list(step)).alias("s"))
    pairs = edges.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("src_pos").cast("short").alias("a"), F.col("dst_pos").cast("short").alias("b")))).alias("e"))
    none = F.array().cast("array<smallint>")
    out = rows.join(pairs, KEY, "left")
    return out.select(*KEY, F.col("s.t").alias("types"), F.col("s.i").alias("indices"), F.col("s.h").alias("hops"), F.col("s.d").alias("times"), F.coalesce(F.col("e.a"), none).alias("edge_src"), F.coalesce(F.col("e.b"), none).alias("edge_dst"))


def unpack(packed: DataFrame) -> DataFrame:
    """(SeedId, ts, pos, type_id, id, hop, days) again."""
    zipped = F.arrays_zip("types", "indices", "hops", "times")
    return packed.select(*KEY, F.posexplode(zipped).alias("pos", "s")).select(*KEY, "pos", F.col("s.types").alias("type_id"), F.col("s.indices").alias("id"), F.col("s.hops").alias("hop"), F.col("s.times").alias("days"))


def flat_positions(tokens: DataFrame, places: DataFrame, budget: int) -> DataFrame:
    """tokens with flat, their place in a batch: the seed's place (SeedId, ts, b) times the budget, plus pos."""
    return tokens.join(places, KEY).withColumn("flat", F.col("b") * budget + F.col("pos"))
