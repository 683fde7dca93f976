"""Learned metapath search: bags, weights, scores, losses and the beam."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut
from .metrics import roc_auc
from .seeds import number, sliced


def relation_candidates(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(rel): relations of edges that leave a target node (column id)."""
    return edges.join(targets.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select("rel").distinct()


def dot(theta: list[float], x: str = "x") -> Column:
    """Inner product of fixed weights with an array of features."""
    return F.aggregate(F.zip_with(F.array(*[F.lit(t) for t in theta]), x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def expand_bags(bags: DataFrame, edges: DataFrame, features: DataFrame, rel: str, theta: list[float]) -> DataFrame:
    """(bag_id, id, alpha, y): each bag's neighbours over a relation, weighted by the sum of alpha * theta.x over
    the members that lead to them. Bags without neighbours go, and with them their label."""
    weighted = bags.join(features, "id").withColumn("w", F.col("alpha") * dot(theta))
    hop = edges.where(F.col("rel") == rel).select(F.col("src").alias("id"), F.col("dst")).distinct()
    return weighted.join(hop, "id").groupBy("bag_id", F.col("dst").alias("id"), "y").agg(F.sum("w").alias("alpha"))


def bag_scores(bags: DataFrame, edges: DataFrame, features: DataFrame, weights: DataFrame, rel: str, theta: list[float], per_node: bool = False) -> DataFrame:
    """(bag_id, y, score). s of a node is the sum of its neighbours' weights over the relation, 1 without any.

    As the trained model computes it: sum of theta.x times sum of s * alpha; per_node: sum of the products.
    """
    hop = edges.where(F.col("rel") == rel).select(F.col("src").alias("id"), F.col("dst")).distinct()
    s = hop.join(weights.select(F.col("id").alias("dst"), F.col("w")), "dst").groupBy("id").agg(F.sum("w").alias("s"))
    rows = bags.join(features, "id").join(s, "id", "left").select("bag_id", "y", dot(theta).alias("h"), (F.coalesce("s", F.lit(1.0)) * F.col("alpha")).alias("a"))
    value = F.sum(F.col("h") * F.col("a")) if per_node else F.sum("h") * F.sum("a")
    return rows.groupBy("bag_id", "y").agg(value.alias("score"))


DEGREE = 16  # values of the sigmoid that stand for it over a bin of width 1; the error is below 1e-15 of a pair
_NODES = np.cos((np.arange(DEGREE) + 0.5) * np.pi / DEGREE) / 2
_SPREAD = (-1.0) ** np.arange(DEGREE) * np.sin((np.arange(DEGREE) + 0.5) * np.pi / DEGREE)  # barycentric weights
NEAR, BLOCK = 40, 1024  # bins: beyond NEAR a sigmoid is 1 or an exponential, beyond BLOCK exactly 1 or 0


def _spread(t: np.ndarray) -> np.ndarray:
    """Weights of the nodes that give a polynomial's value at t (Lagrange's), by row."""
    gap = t[:, None] - _NODES
    at, exact = np.abs(gap).argmin(1), np.abs(gap).min(1) < 1e-15
    w = _SPREAD / np.where(exact[:, None], 1.0, gap)
    w /= w.sum(1, keepdims=True)
    w[exact] = np.eye(DEGREE)[at[exact]]
    return w


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bin, m): sums of the weights of the batch's positive, then negative scores of each bin, and of
    exp(-t) of the former and exp(t) of the latter, t from the bin's middle."""
    for batch in batches:
        score, y, n = (batch.column(c).to_numpy() for c in ("score", "y", "n"))
        if not score.size:
            continue
        low, place = np.unique(np.floor(score), return_inverse=True)
        t = score - (low[place] + 0.5)
        rows = np.concatenate([_spread(t), np.exp(np.where(y == 1, -t, t))[:, None]], 1) * n[:, None]
        m = np.zeros((2, low.size, DEGREE + 1))
        for side, label in enumerate((1, 0)):
            np.add.at(m[side], place[y == label], rows[y == label])
        both = m.transpose(1, 0, 2).reshape(low.size, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.floor(low / BLOCK)), pa.array(low), pa.array(list(both), pa.list_(pa.float64()))], ["block", "bin", "m"])


def _met(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """(l, blocks): loss of the negatives in `left` (of a block and of the two beside it) against the block's
    positives in `right`; `blocks` is left 0. A pair one block below counts as the loss less 1, see pairwise_loss()."""
    both = [np.array(x.column("m").to_pylist()).reshape(x.num_rows, 2, DEGREE + 1)[:, side] for x, side in ((left, 1), (right, 0))]
    a, b = (x.column("bin").to_numpy() for x in (left, right))
    order = np.argsort(b)
    b, pos, neg = b[order], both[1][order], both[0]
    above = np.floor(a / BLOCK) > key[0].as_py()
    total = 0.0
    for k in range(a.size):
        lag = a[k] - b
        near, tail = np.abs(lag) <= NEAR, lag < -NEAR
        if near.any():
            f = 1 / (1 + np.exp(-(lag[near][:, None, None] + _NODES[:, None] - _NODES)))
            total += float(np.einsum("i,bij,bj->", neg[k, :-1], f, pos[near, :-1]))
        total += float(neg[k, -1] * (np.exp(np.maximum(lag[tail], -1e4)) @ pos[tail, -1]))
        total += float(neg[k, :-1].sum() * pos[lag > NEAR, :-1].sum()) - (float(neg[k, :-1].sum() * pos[:, :-1].sum()) if above[k] else 0.0)
    return pa.table({"l": [total]})


def pairwise_loss(scores: DataFrame) -> DataFrame:
    """(loss, n_pairs): the sum over positive and negative bags of sigmoid(negative - positive).

    No pair is made. Scores fall into bins of width 1; in each, a score stands as weights of DEGREE nodes, whose
    sums over the bin give its pairs with any other bin to double precision. Bins meet within a block and the
    two beside it; a negative beyond counts 1 for each positive below it and 0 for those above. Those counts
    come from blocks in slices, and count the block next below as well, whose pairs are then judged less 1.
    A pair of scores that are no number, or infinite alike, makes the loss no number; one without a score
    counts as a pair and adds nothing.
    """
    spark = scores.sparkSession
    by = cut(scores.where("y in (0, 1)").groupBy(F.col("y").cast("int").alias("y"), F.col("score").cast("double").alias("score")).agg(F.count("*").alias("n")))
    s, n = F.col("score"), F.col("n")
    kinds = {"null": s.isNull(), "nan": F.isnan(s), "high": s == float("inf"), "low": s == float("-inf"), "all": F.lit(True)}
    r = by.agg(*[F.coalesce(F.sum(F.when(c & (F.col("y") == y), n)), F.lit(0)).alias(f"{k}{y}") for k, c in kinds.items() for y in (0, 1)]).first()
    p, q = ({k: r[f"{k}{y}"] for k in kinds} for y in (1, 0))
    for x in (p, q):
        x["some"] = x["all"] - x["null"]
        x["real"] = x["some"] - x["nan"] - x["high"] - x["low"]
    pairs = p["all"] * q["all"]
    if p["nan"] * q["some"] + q["nan"] * p["some"] + p["high"] * q["high"] + p["low"] * q["low"]:
        return spark.createDataFrame([(math.nan, pairs)], "loss double, n_pairs long")
    loss = float(q["high"] * (p["real"] + p["low"]) + q["real"] * p["low"])
    if p["real"] and q["real"]:
        own = by.where(s.isNotNull() & (F.abs(s) < float("inf")))
        parts = own.select("score", "y", "n").mapInArrow(_moments, "block double, bin double, m array<double>")
        bins = cut(parts.groupBy("block", "bin").agg(F.array(*[F.sum(F.col("m")[k]) for k in range(2 * DEGREE + 2)]).alias("m")))
        near = bins.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") - 1, F.col("block") + 1))).distinct()
        met = near.groupBy("block").cogroup(bins.groupBy("block")).applyInArrow(_met, "l double")
        loss += met.agg(F.sum("l").alias("l")).first()["l"]
        side = lambda y: F.sum(F.when(F.col("y") == y, n).otherwise(0)).alias
        blocks = cut(own.groupBy(F.floor(F.floor(s).cast("double") / BLOCK).cast("double").alias("block")).agg(side(1)("p"), side(0)("q")))
        loss += _below(blocks)
    return spark.createDataFrame([(loss, pairs)], "loss double, n_pairs long")


def _below(blocks: DataFrame) -> int:
    """Pairs of a positive and a negative of a higher block, of rows (block, p, q); no window sees all blocks."""
    out, _, _ = sliced(blocks, "block")
    w = Window.partitionBy("_slice").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    each = out.withColumn("_p", F.coalesce(F.sum("p").over(w), F.lit(0)))
    rows = each.groupBy("_slice").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("_p").cast("decimal(38,0)") * F.col("q")).alias("own")).orderBy("_slice").collect()
    before = total = 0
    for r in rows:
        total += int(r["own"]) + before * r["q"]
        before += r["p"]
    return total


def best_relations(losses: DataFrame, k: int) -> DataFrame:
    return losses.orderBy("loss", "rel").limit(k)


def worst_relations(losses: DataFrame, k: int) -> DataFrame:
    return losses.orderBy(F.col("loss").desc(), "rel").limit(k)


def safe(metric: Column) -> Column:
    """Metrics that are no number rank last."""
    bad = metric.isNull() | F.isnan(metric) | (F.abs(metric) == float("inf"))
    return F.when(bad, float("-inf")).otherwise(metric)


def fit_theta(x: np.ndarray, bag: np.ndarray, y: np.ndarray, alpha: np.ndarray, epochs: int = 500, rate: float = 0.1, patience: int = 10) -> tuple[np.ndarray, float]:
    """Non-negative weights of a bounded sample of bags that lower the pairwise loss, by Adam. The count of epochs
    without a better loss runs on over better ones."""
    n = int(bag.max()) + 1
    theta, m, v = np.ones(x.shape[1]) / x.shape[1], np.zeros(x.shape[1]), np.zeros(x.shape[1])
    best, kept, worse = math.inf, theta, 0
    total = np.bincount(bag, alpha, n)
    sums = np.stack([np.bincount(bag, c, n) for c in x.T], 1) * total[:, None]
    for t in range(1, epochs + 1):
        s = sums @ theta
        p = 1 / (1 + np.exp(-np.clip(s[y == 0][None, :] - s[y == 1][:, None], -50, 50)))
        loss = float(p.sum())
        if loss < best - 1e-12:
            best, kept = loss, theta.copy()
        else:
            worse += 1
            if worse >= patience:
                break
        d = p * (1 - p)
        g = d.sum(0) @ sums[y == 0] - d.sum(1) @ sums[y == 1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = np.maximum(theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), 0)
    return kept, best


def beam_search(first: list[int], grow: Callable[[tuple[int, ...]], list[int]], judge: Callable[[tuple[int, ...]], float], rounds: int, top: int, width: int) -> list[tuple[tuple[int, ...], float]]:
    """Ranked paths, newest relation first in each: `first` relations, then `rounds` rounds in which each path
    on the beam grows by its `top` best relations and the beam keeps `width` by metric. Paths so reach
    rounds + 1 relations. A path found twice keeps its first place."""
    clean = lambda x: x if math.isfinite(x) else -math.inf
    scored = {(r,): clean(judge((r,))) for r in first[:top]}
    beam = sorted(scored, key=lambda p: -scored[p])[:width]
    for _ in range(rounds):
        new = [(r, *p) for p in beam for r in grow(p)[:top]]
        for p in dict.fromkeys(new):
            if p not in scored:
                scored[p] = clean(judge(p))
        beam = sorted(dict.fromkeys(new), key=lambda p: -scored[p])[:width]
        if not beam:
            break
    return sorted(scored.items(), key=lambda kv: -kv[1])


def beam_over_tables(bags: DataFrame, edges: DataFrame, features: DataFrame, weights: DataFrame, theta: list[float], rounds: int, top: int, width: int) -> DataFrame:
    """(path, hop, auc): paths of relations found by a beam over the tables, the first relation first in each.

    From each path on the beam the relations that leave its bags' members are judged by the pairwise loss of
    bag_scores(); the `top` best extend it, and the beam keeps `width` by the AUC of the bags' weights. The
    loop is over relations, as few as the schema's; all data stays in frames, cut at each step.
    """
    beam: list[tuple[tuple[str, ...], DataFrame]] = [((), bags)]
    found: list[tuple[str, int, float]] = []
    for _ in range(rounds):
        grown = []
        for path, at in beam:
            candidates = sorted(r["rel"] for r in relation_candidates(edges, at).collect())
            if len(candidates) > top:  # else all extend the path, whatever their losses
                losses = [(pairwise_loss(bag_scores(at, edges, features, weights, rel, theta)).first()["loss"], rel) for rel in candidates]
                candidates = [rel for _, rel in sorted(losses)[:top]]
            for rel in candidates:
                bigger = cut(expand_bags(at, edges, features, rel, theta))
                auc = roc_auc(bigger.groupBy("bag_id", "y").agg(F.round(F.sum("alpha"), 9).alias("score"))).first()["auc"]
                grown.append(((*path, rel), bigger, auc if auc is not None and math.isfinite(auc) else -math.inf))
        found += [("__".join(p), len(p), auc) for p, _, auc in grown]
        beam = [(p, df) for p, df, _ in sorted(grown, key=lambda g: (-g[2], g[0]))[:width]]
        if not beam:
            break
    return bags.sparkSession.createDataFrame(found, "path string, hop int, auc double")


def split_bags(bags: DataFrame, share: float, salt: str = "s") -> tuple[DataFrame, DataFrame]:
    """Two parts of the bags, the first with `share` of each label's, in a repeatable random order.

    Counts by label are exact; the order is sliced, so no task sees all bags.
    """
    own = cut(bags.select("bag_id", "y").distinct().withColumn("_d", F.xxhash64("bag_id", F.lit(salt))))
    parts = []
    for r in own.groupBy("y").agg(F.count("*").alias("n")).collect():
        label = own.where(F.col("y") == r["y"])
        parts.append(number(label, "_d", ["_d", "bag_id"]).where(F.col("rn") <= round(share * r["n"])).select("bag_id"))
    first = reduce(DataFrame.unionByName, parts) if parts else own.select("bag_id").limit(0)
    first = cut(first)
    return bags.join(first, "bag_id", "left_semi"), bags.join(first, "bag_id", "left_anti")


def replay(bags: DataFrame, edges: DataFrame, features: DataFrame, path: list[str], theta: list[float]) -> DataFrame:
    """The bags at the end of a path of relations, the first first: the state that a search had there."""
    for rel in path:
        bags = expand_bags(bags, edges, features, rel, theta)
    return bags


def beam_prune(paths: DataFrame, metric: str, width: int) -> DataFrame:
    return paths.orderBy(safe(F.col(metric)).desc(), "path").limit(width)


def message_sum(edges: DataFrame, features: DataFrame, rel: str) -> DataFrame:
    """(id, x): each node's sum of its neighbours' features over a relation."""
    hop = edges.where(F.col("rel") == rel).select(F.col("src").alias("id"), F.col("dst"))
    long = hop.join(features.select(F.col("id").alias("dst"), F.posexplode("x").alias("k", "v")), "dst").groupBy("id", "k").agg(F.sum("v").alias("v"))
    return long.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("x"))
