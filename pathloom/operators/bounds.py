"""Confidence bounds over batches, ranks within hops, and the good-bad split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_critical

KEY = ["hop", "prefix", "feature"]
COV_LIMIT = 1e-6


def _lcb(mu: Column, sigma: Column, n: Column, delta: float, most: int) -> Column:
    """mu - t * sigma / sqrt(n); mu itself for one batch. `most` bounds the number of batches."""
    t = F.element_at(F.create_map(*[F.lit(x) for d in range(1, max(most, 2)) for x in (d, t_critical(delta, d))]), (n - 1).cast("int"))
    return F.when(n <= 1, mu).otherwise(mu - t * sigma / F.sqrt(n.cast("double")))


def lcb_summary(scores: DataFrame, batches: int, delta: float = 0.1) -> DataFrame:
    """(hop, prefix, feature, aggregate_type, mu_tr, sigma_tr, n_train_batches, cov_mean, cov_std, n_cov_batches,
    cov_cv, lcb_tr, cov_lcb_tr) from scores with an aggregate_type column; coverage is that of log_rate."""
    by = [*KEY, "aggregate_type"]
    main = scores.groupBy(*by).agg(F.avg("score").alias("mu_tr"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sigma_tr"), F.countDistinct("batch_id").alias("n_train_batches"))
    share = scores.where("aggregate_type = 'log_rate'").withColumn("coverage", F.col("n_nonzero") / F.greatest(F.col("n_samples"), F.lit(1)))
    cover = share.groupBy(*KEY).agg(F.avg("coverage").alias("cov_mean"), F.coalesce(F.stddev_samp("coverage"), F.lit(0.0)).alias("cov_std"), F.countDistinct("batch_id").alias("n_cov_batches"))
    out = main.join(cover, KEY, "left")
    return (
        out.withColumn("cov_cv", F.when(F.col("cov_mean") > 0, F.col("cov_std") / F.col("cov_mean")).otherwise(0.0))
        .withColumn("lcb_tr", _lcb(F.col("mu_tr"), F.col("sigma_tr"), F.col("n_train_batches"), delta, batches))
        .withColumn("cov_lcb_tr", _lcb(F.col("cov_mean"), F.col("cov_std"), F.col("n_cov_batches"), delta, batches))
    )


def wide(lcb: DataFrame) -> DataFrame:
    """(hop, prefix, feature, lcb_tr_log_rate, lcb_tr_log_count, cov_mean, cov_std, cov_cv, cov_lcb_tr), 0 where missing."""
    pivot = lcb.groupBy(*KEY).pivot("aggregate_type", ["log_rate", "log_count"]).agg(F.first("lcb_tr", ignorenulls=True)).na.fill(0.0)
    pivot = pivot.withColumnRenamed("log_rate", "lcb_tr_log_rate").withColumnRenamed("log_count", "lcb_tr_log_count")
    cover = lcb.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("cov_mean", "cov_std", "cov_cv", "cov_lcb_tr")])
    return pivot.join(cover, KEY, "left")


def dead(df: DataFrame) -> DataFrame:
    return df.where("lcb_tr_log_rate = 0 and lcb_tr_log_count = 0 and cov_lcb_tr = 0")


def live(df: DataFrame) -> DataFrame:
    return df.where("not (lcb_tr_log_rate = 0 and lcb_tr_log_count = 0 and cov_lcb_tr = 0)")


def pct_rank(column: str) -> Column:
    """Average rank of ties over the hop's size."""
    ties = F.count("*").over(Window.partitionBy("hop", column))
    return (F.rank().over(Window.partitionBy("hop").orderBy(column)) + (ties - 1) / 2.0).cast("double") / F.count("*").over(Window.partitionBy("hop")).cast("double")


def q_scores(df: DataFrame) -> DataFrame:
    """(hop, prefix, feature, Q_score, winner_agg, p_rate, p_count, p_cov) of live extensions."""
    ranked = live(df).select(*KEY, pct_rank("lcb_tr_log_rate").alias("p_rate"), pct_rank("lcb_tr_log_count").alias("p_count"), pct_rank("cov_lcb_tr").alias("p_cov"))
    winner = F.when(F.col("p_rate") > F.col("p_count"), "log_rate").when(F.col("p_rate") < F.col("p_count"), "log_count").otherwise("tie")
    return ranked.select(*KEY, (F.greatest("p_rate", "p_count") + F.col("p_cov")).alias("Q_score"), winner.alias("winner_agg"), "p_rate", "p_count", "p_cov")


def mixture(q: np.ndarray, starts: int = 20, steps: int = 500, floor: float = 1e-6) -> np.ndarray:
    """1 for the upper of two normal components fitted to standardised values, 0 for the lower; all 1 if degenerate."""
    if len(q) < 2 or len(np.unique(q)) < 2:
        return np.ones(len(q), int)
    z = (q - q.mean()) / q.std()
    best, label = -np.inf, np.ones(len(q), int)
    for s in range(starts):
        lo, hi = np.quantile(z, [s / (2 * starts), 1 - s / (2 * starts)])
        mu, var, w = np.array([lo, hi]), np.array([1.0, 1.0]), np.array([0.5, 0.5])
        before = -np.inf
        for _ in range(steps):
            logs = np.log(w) - 0.5 * np.log(2 * np.pi * var) - (z[:, None] - mu) ** 2 / (2 * var)
            top = np.logaddexp.reduce(logs, axis=1)
            r = np.exp(logs - top[:, None])
            n = r.sum(0) + 1e-12
            w, mu = n / len(z), (r * z[:, None]).sum(0) / n
            var = (r * (z[:, None] - mu) ** 2).sum(0) / n + floor
            if abs(top.mean() - before) < 1e-9:
                break
            before = top.mean()
        if top.mean() > best + 1e-9:
            best, label = top.mean(), (r.argmax(1) == mu.argmax()).astype(int)
    return label


def split(q: DataFrame) -> DataFrame:
    """(hop, prefix, feature, Q_score, cluster_id): one mixture over all hops. Extensions are as few as the schema's paths."""
    pdf = q.select(*KEY, "Q_score").toPandas().sort_values(["hop", "prefix", "feature"])
    pdf["cluster_id"] = mixture(pdf["Q_score"].to_numpy(float))
    rows = [tuple(r) for r in pdf.astype(object).itertuples(index=False)]
    return q.sparkSession.createDataFrame(pd.DataFrame(rows, columns=pdf.columns) if rows else [], "hop int, prefix string, feature string, Q_score double, cluster_id int")
