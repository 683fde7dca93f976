"""Seed events: task tables, samplers and batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import Database
from .cut import cut


def cutoffs(df: DataFrame, times: list[str]) -> DataFrame:
    """Each row once for each cutoff."""
    return df.withColumn("ts", F.explode(F.array(*[F.lit(t).cast("timestamp_ntz") for t in times])))


def _later(db: Database, table: str, key: str, time: str, days: int, times: list[str], value: Column) -> DataFrame:
    """Value summed over each key's rows in the days from each cutoff on; rows outside all windows never shuffle."""
    rows = db.read(table)
    inside = [F.when((F.col(time) >= F.lit(t).cast("timestamp_ntz")) & (F.col(time) < F.lit(t).cast("timestamp_ntz") + F.make_dt_interval(F.lit(days))), F.lit(t)) for t in times]
    hits = rows.select(F.col(key).cast("long").alias("SeedId"), F.explode(F.array_compact(F.array(*inside))).alias("at"), value.alias("value"))
    return hits.groupBy("SeedId", F.col("at").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


CHURN = ["1998-01-01", "1999-01-01", "2000-01-01"]
ENGAGEMENT = ["2024-01-10", "2024-01-20"]


def churn(db: Database, times: list[str] = CHURN, days: int = 90) -> DataFrame:
    """(SeedId, ts, label): 1 for customers without an order in the days after the cutoff."""
    seeds = cutoffs(db.read("customer").select(F.col("c_custkey").cast("long").alias("SeedId")), times)
    later = _later(db, "orders", "o_custkey", "o_orderdate", days, times, F.lit(1))
    return seeds.join(later, ["SeedId", "ts"], "left").select("SeedId", "ts", F.when(F.col("n").isNull(), 1.0).otherwise(0.0).alias("label"))


def spend(db: Database, times: list[str] = CHURN, days: int = 90) -> DataFrame:
    """(SeedId, ts, label): total of orders in the days after the cutoff."""
    seeds = cutoffs(db.read("customer").select(F.col("c_custkey").cast("long").alias("SeedId")), times)
    later = _later(db, "orders", "o_custkey", "o_orderdate", days, times, F.col("o_totalprice"))
    return seeds.join(later, ["SeedId", "ts"], "left").select("SeedId", "ts", F.coalesce("total", F.lit(0.0)).alias("label"))


def engagement(db: Database, times: list[str] = ENGAGEMENT, days: int = 7) -> DataFrame:
    """(SeedId, ts, label): 1 for customers with an event in the days after the cutoff."""
    seeds = cutoffs(db.read("customer").select(F.col("c_custkey").cast("long").alias("SeedId")), times)
    later = _later(db, "events", "user_id", "ts", days, times, F.lit(1))
    return seeds.join(later, ["SeedId", "ts"], "left").select("SeedId", "ts", F.when(F.col("n").isNull(), 0.0).otherwise(1.0).alias("label"))


def draw_key(salt: str, *columns: str) -> Column:
    """A repeatable random order: md5 of a salt and the row's identity."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in columns]))


def take(df: DataFrame, n: int, salt: str = "s", keys: tuple[str, ...] = ("SeedId", "ts")) -> DataFrame:
    """n rows of the repeatable random order, found with a bounded heap in each partition."""
    return df.orderBy(draw_key(salt, *keys), *keys).limit(n)


def balanced(df: DataFrame, all_of: float, other: float, n: int, strict: bool = False, salt: str = "s") -> DataFrame:
    """All rows of one label and n of the other; strict raises where there are fewer."""
    df = cut(df) if strict else df
    rest = df.where(F.col("label") == other)
    if strict and rest.count() < n:
        raise ValueError(f"fewer than {n} rows of label {other}")
    return df.where(F.col("label") == all_of).unionByName(take(rest, n, salt))


def quotas(total: int, a: int, b: int, strict: bool = False) -> tuple[int, int]:
    """Shares of two classes in proportion to their sizes; halves round to even. A short class yields to the other."""
    na = round(total * a / (a + b)) if a + b else 0
    nb = total - na
    if strict and (na > a or nb > b):
        raise ValueError("not enough rows for a strict proportional sample")
    if na > a:
        na, nb = a, min(b, nb + na - a)
    if nb > b:
        na, nb = min(a, na + nb - b), b
    return na, nb


def proportional(df: DataFrame, a: float, b: float, total: int, strict: bool = False, salt: str = "s") -> DataFrame:
    df = cut(df)
    n = {r["label"]: r["n"] for r in df.where(F.col("label").isin(a, b)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    na, nb = quotas(total, n.get(a, 0), n.get(b, 0), strict)
    return take(df.where(F.col("label") == a), na, salt).unionByName(take(df.where(F.col("label") == b), nb, salt))


def _nonzero() -> Column:
    return (F.col("label") != 0) | F.isnan("label")


def nonzero_plus_zero(df: DataFrame, zeros: int, salt: str = "s") -> DataFrame:
    """All rows with another label than zero (NaN among them) and at most so many zeros."""
    return df.where(_nonzero()).unionByName(take(df.where(F.col("label") == 0), zeros, salt))


def zero_nonzero(df: DataFrame, zeros: int, nonzeros: int, salt: str = "s") -> DataFrame:
    return take(df.where(F.col("label") == 0), zeros, salt).unionByName(take(df.where(_nonzero()), nonzeros, salt))


def sample_n(df: DataFrame, positive: int, negative: int, strict: bool = True, replacement: bool = False, salt: str = "s") -> DataFrame:
    """So many rows with label 1 and 0; with replacement, draw k is the row at hash(k) modulo the class size."""
    out = []
    df = cut(df)
    for label, n in ((1.0, positive), (0.0, negative)):
        rows = df.where(F.col("label") == label)
        have = rows.count() if strict or replacement else None
        if strict and not replacement and have < n:
            raise ValueError(f"{have} rows of label {label}; {n} wanted")
        if replacement and have:
            numbered = number(rows.withColumn("key", draw_key(salt, "SeedId", "ts")), "SeedId", ["SeedId", "ts"]).drop("key")
            draws = df.sparkSession.range(n).select((F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(have)) + 1).alias("rn"))
            out.append(numbered.join(draws, "rn").drop("rn"))
        else:
            out.append(take(rows, n, salt))
    return out[0].unionByName(out[1])


def sliced(df: DataFrame, lead: str, slices: int = 64) -> tuple[DataFrame, list[int], int]:
    """df with _slice, by approximate quantiles of the numeric column lead; rows before each slice; all rows."""
    found = df.agg(F.percentile_approx(lead, [k / slices for k in range(1, slices)], 1000).alias("q")).first()["q"]
    cuts = sorted(set(found or []))
    part = sum((F.when(F.col(lead) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    out = df.withColumn("_slice", part)
    sizes = {r["_slice"]: r["n"] for r in out.groupBy("_slice").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(len(cuts) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    return out, before, total


def number(df: DataFrame, lead: str, order: list[str], slices: int = 64) -> DataFrame:
    """df with rn, its place in the order. `lead` is the numeric first column of the order.

    Rows are sliced at approximate quantiles of the lead column; each slice is numbered on its own and starts
    after the rows of the slices below, so that no task sees all rows. df is read three times: cut() it first
    if it is dear.
    """
    return _numbered(*sliced(df, lead, slices)[:2], order)


def _numbered(out: DataFrame, before: list[int], order: list[str]) -> DataFrame:
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_slice") + 1)
    rn = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)).cast("long")
    return out.withColumn("rn", start + rn).drop("_slice")


def at_ranks(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """Values of a numeric column at these places (from 0) of its order, found slice by slice; nulls do not count."""
    own = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    own = cut(own)
    out, _, _ = sliced(own, "v")
    sizes = {r["_slice"]: r["n"] for r in out.groupBy("_slice").agg(F.sum("n").alias("n")).collect()}
    begin, total = {}, 0
    for k in sorted(sizes):
        begin[k] = total
        total += sizes[k]
    if not total:
        return {}
    first = F.element_at(F.create_map(*[F.lit(x) for k, v in begin.items() for x in (k, v)]), F.col("_slice"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("_slice").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = out.withColumn("_from", first + below)
    wanted = sorted({min(max(r, 0), total - 1) for r in ranks})
    hit = [F.max(F.when((F.col("_from") <= r) & (F.col("_from") + F.col("n") > r), F.col("v"))).alias(f"r{k}") for k, r in enumerate(wanted)]
    row = placed.agg(*hit).first()
    return {r: row[f"r{k}"] for k, r in enumerate(wanted)}


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """Exact quantiles with linear interpolation, without one task that sees all values; None without a value."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    places = [q * (n - 1) for q in shares]
    value = at_ranks(df, column, [x for p in places for x in (math.floor(p), math.ceil(p))])
    return [value[math.floor(p)] + (value[math.ceil(p)] - value[math.floor(p)]) * (p - math.floor(p)) for p in places]


def batches(df: DataFrame, n: int, lead: str = "SeedId", order: tuple[str, ...] = ("SeedId", "ts")) -> DataFrame:
    """df with batch_id as NTILE(n) over the order gives it, without a window over all rows; df is computed once."""
    out, before, total = sliced(cut(df), lead)
    size, more = divmod(total, n)
    rn = F.col("rn")
    big = F.ceil(rn / (size + 1))
    small = F.lit(more) + F.ceil((rn - more * (size + 1)) / F.lit(max(size, 1)))
    return _numbered(out, before, list(order)).withColumn("batch_id", F.when(rn <= more * (size + 1), big).otherwise(small).cast("int")).drop("rn")


def sample_for(df: DataFrame, kind: str, n: int, salt: str = "s") -> DataFrame:
    """A sample of about n rows by a task's kind: `binary` (all of the rarer label and n of the other), `share`
    (both in proportion), `amount` (all other than zero and n zeros), `capped` (n of each), or `all`."""
    if kind == "all":
        return df
    if kind == "amount":
        return nonzero_plus_zero(df, n, salt)
    if kind == "capped":
        return zero_nonzero(df, n, n, salt)
    if kind == "share":
        return proportional(df, 1.0, 0.0, n, salt=salt)
    if kind != "binary":
        raise ValueError(f"no sampler for tasks of kind {kind}")
    df = cut(df)
    sizes = {r["label"]: r["n"] for r in df.where(F.col("label").isin(0.0, 1.0)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    rare, other = (1.0, 0.0) if sizes.get(1.0, 0) <= sizes.get(0.0, 0) else (0.0, 1.0)
    return balanced(df, rare, other, n, salt=salt)


def batch_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.countDistinct("SeedId").alias("n_seeds"))


def label_counts(df: DataFrame) -> DataFrame:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return df.agg(one(F.col("label") == 0)("zeros"), one((F.col("label") != 0) & ~F.isnan("label"))("nonzeros"), one(F.col("label").isNull() | F.isnan("label"))("missing"), F.count("*").alias("n_rows"))


def bool_labels(column: str) -> Column:
    return F.col(column).cast("boolean").cast("tinyint")


def ranks(df: DataFrame, world: int, salt: str = "s") -> DataFrame:
    """(…, rank): a shuffled order dealt to ranks in strides, padded with its head to equal sizes."""
    rows = number(cut(df).withColumn("_key", F.conv(F.substring(draw_key(salt, "SeedId", "ts"), 1, 12), 16, 10).cast("long")), "_key", ["_key", "SeedId", "ts"]).drop("_key")
    n = rows.count()
    pad = (-n) % world
    padded = rows.unionByName(rows.where(F.col("rn") <= pad).withColumn("rn", F.col("rn") + n)) if pad else rows
    return padded.withColumn("rank", F.pmod(F.col("rn") - 1, F.lit(world)).cast("int")).drop("rn")
