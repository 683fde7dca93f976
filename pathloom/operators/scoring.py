"""Scores of extensions: entropy, binning, mutual information, cost."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import digamma
from .cut import cut
from .seeds import quantiles

GROUP = ["batch_id", "hop", "prefix", "feature"]


def entropy(df: DataFrame, by: list[str], column: str = "label") -> DataFrame:
    """(by…, h): entropy in nats of a column's values in each group."""
    n = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.greatest(F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))), F.lit(1e-12)))
    return p.groupBy(*by).agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"))


def is_classification(df: DataFrame, column: str = "label", most: int = 20) -> bool:
    return df.agg(F.countDistinct(column).alias("n")).first()["n"] <= most


def quantile_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(edges): distinct quantiles of the finite values at 0, 1/bins, … 1; [0, 1] where there are none.

    The values are ranked in slices, so no task sees all of them.
    """
    finite = df.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) < float("inf")))
    found = quantiles(cut(finite.select(column)), column, [k / bins for k in range(bins + 1)])
    return df.sparkSession.createDataFrame([(sorted(set(found)) if found else [0.0, 1.0],)], "edges array<double>")


def bin_of(x: Column, edges: Column) -> Column:
    """Inner cuts below x: cut[i-1] < x <= cut[i]."""
    return F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda c: x > c))


def bin_count(df: DataFrame, column: str, least: int = 5, most: int = 64) -> DataFrame:
    """(bins): the larger of Sturges' and Freedman-Diaconis' numbers, within limits and n / 200."""
    df = cut(df.select(column))
    q = quantiles(df, column, [0.25, 0.75]) or [0.0, 0.0]
    s = df.agg(F.count(column).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).withColumn("q", F.array(*map(F.lit, q)))
    width, n = F.col("b") - F.col("a"), F.col("n").cast("double")
    sturges = width / (F.log2(n) + 1)
    fd = 2 * (F.col("q")[1] - F.col("q")[0]) * F.pow(n, F.lit(-1 / 3))
    step = F.when(fd > 0, F.least(F.greatest(fd, width / F.sqrt(n) / 2), sturges)).otherwise(sturges)
    raw = F.when(step > 0, F.ceil(width / step)).otherwise(F.lit(1))
    capped = F.least(F.greatest(raw, F.lit(least)), F.lit(most))
    return s.select(F.greatest(F.least(capped, F.floor(F.col("n") / 200)), F.lit(1)).cast("long").alias("bins"))


def global_edges(parts: list[DataFrame], column: str = "label", bins: int | None = None) -> list[float]:
    """Edges that all parts of a regression task share: quantiles of their labels together; without `bins`, as
    many as bin_count() gives."""
    both = cut(reduce(DataFrame.unionByName, [p.select(column) for p in parts]))
    n = bins or bin_count(both, column).first()["bins"]
    return quantile_edges(both, column, int(n)).first()["edges"]


def joint(stats: DataFrame) -> DataFrame:
    """(batch_id, hop, prefix, feature, cnt, parent, label, n): how many seeds have each, all that scores need.

    One aggregation, partial on the map side; every score of every strategy derives from its few rows.
    """
    return stats.groupBy(*GROUP, "cnt", "parent", "label").agg(F.count("*").alias("n"))


def plugin_mi(df: DataFrame, value: str, by: list[str] = GROUP, weight: Column | None = None) -> DataFrame:
    """(by…, mi): mutual information in nats of a discrete value and the label, from joint counts; `weight` is
    the number of rows that a row stands for."""
    joint = df.groupBy(*by, value, "label").agg((F.count("*") if weight is None else F.sum(weight)).alias("nxy"))
    over = lambda *c: F.sum("nxy").over(Window.partitionBy(*by, *c))
    terms = joint.withColumn("nx", over(value)).withColumn("ny", over("label")).withColumn("n", over())
    p = F.col("nxy") / F.col("n")
    return terms.groupBy(*by).agg(F.greatest(F.sum(p * F.ln(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")).cast("double"))), F.lit(0.0)).alias("mi"))


def nmi(mi: Column, h: Column) -> Column:
    return F.when(h > 0, F.least(F.greatest(mi / h, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def summary(joint: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(aggregate_type, batch_id, hop, prefix, feature, npmi, cost, n_samples, n_nonzero, score) of each strategy.

    `joint` as joint() gives it; `values` has each strategy's value from cnt and parent.
    """
    by = ["aggregate_type", *GROUP]
    kinds = F.array(*[F.struct(F.lit(k).alias("aggregate_type"), v.cast("double").alias("_v")) for k, v in values.items()])
    each = joint.select(*GROUP, "cnt", "label", "n", F.inline(kinds))
    cells = each.groupBy(*by, "_v", "label").agg(F.sum("n").alias("nxy"), F.sum(F.when(F.col("cnt") != 0, F.col("n") * F.col("cnt")).otherwise(0)).alias("c"), F.sum(F.when(F.col("cnt") != 0, F.col("n")).otherwise(0)).alias("nz"))
    over = lambda *c: F.sum("nxy").over(Window.partitionBy(*by, *c))
    terms = cells.withColumn("nx", over("_v")).withColumn("ny", over("label")).withColumn("_n", over())
    p, q = F.col("nxy") / F.col("_n"), F.greatest(F.col("ny") / F.col("_n"), F.lit(1e-12))
    found = terms.groupBy(*by).agg(
        F.greatest(F.sum(p * F.ln(F.col("nxy") * F.col("_n") / (F.col("nx") * F.col("ny")).cast("double"))), F.lit(0.0)).alias("mi"),
        (-F.sum(p * F.ln(q))).alias("h"),  # each label's share, spread over its cells
        F.sum("c").cast("double").alias("c"), F.sum("nz").alias("n_nonzero"), F.sum("nxy").alias("n_samples"),
    )
    out = found.withColumn("npmi", nmi(F.col("mi"), F.col("h"))).withColumn("cost", F.when(F.col("n_nonzero") > 0, F.col("c") / F.col("n_nonzero")).otherwise(0.0))
    return out.select(*by, "npmi", "cost", "n_samples", "n_nonzero", F.when(F.col("cost") > 0, F.col("npmi") / F.col("cost")).otherwise(0.0).alias("score"))


def top_per_hop(df: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("hop").orderBy(F.col("score").desc(), "batch_id", "prefix", "feature"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def in_order(df: DataFrame) -> DataFrame:
    """df with place, its rows' stable order in each hop: score downwards, ties by name. Rows are as few as the
    schema's paths and batches."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("hop").orderBy(F.col("score").desc(), "prefix", "feature", "batch_id")))


def _digammas(m: np.ndarray) -> float:
    """Sum of digamma over positive integers, each distinct one computed once."""
    values, n = np.unique(m, return_counts=True)
    return float(sum(digamma(int(v)) * int(k) for v, k in zip(values, n, strict=True)))


def knn_mi(x: np.ndarray, y: np.ndarray, discrete: bool, k: int = 3) -> float:
    """Nearest-neighbour mutual information of a scaled number with a discrete (Ross) or continuous (Kraskov) label."""
    n = len(x)
    if n < 2 or np.ptp(x) == 0:
        return 0.0
    noise = np.random.default_rng(0)
    x = x / x.std() + 1e-10 * max(1.0, np.abs(x / x.std()).mean()) * noise.standard_normal(n)
    order = np.sort(x)

    def within(at: np.ndarray, radius: np.ndarray, among: np.ndarray) -> np.ndarray:
        return np.searchsorted(among, at + radius, "left") - np.searchsorted(among, at - radius, "right")

    def kth(values: np.ndarray, kk: int) -> np.ndarray:
        """Distance to the kk-th neighbour on a sorted line."""
        best = np.full(values.size, np.inf)
        for left in range(kk + 1):
            right = kk - left
            reach = np.full(values.size, 0.0)
            if left:
                reach[left:] = values[left:] - values[:-left]
                reach[:left] = np.inf
            if right:
                far = np.full(values.size, np.inf)
                far[:-right] = values[right:] - values[:-right]
                reach = np.maximum(reach, far)
            best = np.minimum(best, reach)
        return best

    if discrete:
        total, used = 0.0, 0
        for c in np.unique(y):
            own = np.sort(x[y == c])
            if own.size < 2:
                continue
            kk = min(k, own.size - 1)
            m = np.maximum(within(own, np.nextafter(kth(own, kk), 0), order), 1)
            total += own.size * (digamma(kk) - digamma(own.size)) - _digammas(m)
            used += own.size
        return max(0.0, digamma(used) + total / used) if used else 0.0
    y = y / (y.std() or 1.0) + 1e-10 * noise.standard_normal(n)
    radius = np.empty(n)
    for a in range(0, n, 512):
        far = np.maximum(np.abs(x[a : a + 512, None] - x), np.abs(y[a : a + 512, None] - y))
        radius[a : a + 512] = np.partition(far, min(k, n - 1), 1)[:, min(k, n - 1)]
    radius = np.nextafter(radius, 0)
    nx, ny = np.maximum(within(x, radius, order), 1), np.maximum(within(y, radius, np.sort(y)), 1)
    return max(0.0, digamma(n) + digamma(min(k, n - 1)) - (_digammas(nx) + _digammas(ny)) / n)


def knn_mi_by_group(stats: DataFrame, value: str, discrete: bool = True) -> DataFrame:
    """(batch_id, hop, prefix, feature, mi) by nearest neighbours; a batch of one feature is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["SeedId", "ts"])
        x = np.nan_to_num(pdf[value].to_numpy(float), posinf=0, neginf=0)
        mi = knn_mi(x, pdf["label"].to_numpy(float), discrete)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in GROUP}, "mi": mi}])

    return stats.where("label is not null").select(*GROUP, "SeedId", "ts", "label", value).groupBy(*GROUP).applyInPandas(run, "batch_id int, hop int, prefix string, feature string, mi double")
