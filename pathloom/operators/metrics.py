"""Metrics of predictions, and the relational parts of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut
from .seeds import quantiles, sliced


def micro_f1(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("micro_f1"))


def roc_auc(df: DataFrame, score: str = "score") -> DataFrame:
    """(auc) from average ranks. Rows meet as distinct scores with their counts, summed from below in slices of
    the score, so ties and size do not bring all rows into one task."""
    by = cut(df.groupBy(score).agg(F.sum(F.col("y").cast("long")).alias("p"), F.count("*").alias("n")))
    cuts = by.agg(F.percentile_approx(score, [k / 32 for k in range(1, 32)], 1000).alias("q")).first()["q"] or []
    part = sum((F.when(F.col(score) > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    sliced = by.withColumn("_s", part)
    sizes = {r["_s"]: r["n"] for r in sliced.groupBy("_s").agg(F.sum("n").alias("n")).collect()}
    start, total = [], 0
    for k in range(len(set(cuts)) + 1):
        start.append(total)
        total += sizes.get(k, 0)
    below = F.coalesce(F.sum("n").over(Window.partitionBy("_s").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.element_at(F.array(*[F.lit(x).cast("long") for x in start]), F.col("_s") + 1) + below + (F.col("n") + 1) / 2.0
    sums = sliced.withColumn("_r", rank.cast("double")).agg(F.sum(F.col("_r") * F.col("p")).alias("r"), F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    pos, neg = F.col("p"), F.col("n") - F.col("p")
    return sums.select(F.when((pos > 0) & (neg > 0), (F.col("r") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def average_precision(df: DataFrame, score: str = "score") -> DataFrame:
    """(auprc): precision at each distinct score, weighted by the recall that it adds; null without positives.

    Distinct scores meet in slices, as in roc_auc().
    """
    by = cut(df.groupBy(score).agg(F.sum(F.col("y").cast("long")).alias("p"), F.count("*").alias("n")))
    out, _, _ = sliced(by.withColumn("_lead", -F.col(score)), "_lead")
    sums = {r["_slice"]: (r["p"], r["n"]) for r in out.groupBy("_slice").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()}
    rows, p, n = [], 0, 0
    for k in sorted(sums):
        rows += [F.lit(k), F.struct(F.lit(p).cast("long").alias("p"), F.lit(n).cast("long").alias("n"))]
        p, n = p + sums[k][0], n + sums[k][1]
    if not p:
        return by.agg(F.lit(None).cast("double").alias("auprc"))
    w = Window.partitionBy("_slice").orderBy("_lead")
    start = F.element_at(F.create_map(*rows), F.col("_slice"))
    hit, seen = start["p"] + F.sum("p").over(w), start["n"] + F.sum("n").over(w)
    return out.select((F.col("p") * hit / seen).alias("x")).agg((F.sum("x") / F.lit(p)).alias("auprc"))


TUNE = {"binary": ("roc_auc", True), "regression": ("mae", False), "multiclass": ("micro_f1", True)}  # metric, and whether more is better


def tune_metric(kind: str) -> tuple[str, bool]:
    """The metric that a task of this kind is tuned by, and whether more of it is better."""
    if kind not in TUNE:
        raise ValueError(f"no metric for tasks of kind {kind}")
    return TUNE[kind]


def best_epoch(history: list[float], higher: bool, patience: int) -> tuple[int, int]:
    """(best, last): the best epoch, and the one after which training stops: `patience` epochs without a better one.

    Values that are no number never count as better; the first of equals is the best. Epochs count from 0.
    """
    best, at = None, 0
    for k, v in enumerate(history):
        if v == v and abs(v) != float("inf") and (best is None or (v > best if higher else v < best)):
            best, at = v, k
        elif k - at >= patience:
            return at, k
    return at, len(history) - 1


def mae(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): for two classes 1 and negatives / positives / 2, else N / (classes * count)."""
    n = df.groupBy(label).agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    all_rows = Window.partitionBy(F.lit(1))  # one row a class
    total, kinds = F.sum("n").over(all_rows), F.count("*").over(all_rows)
    one = F.max(F.when(F.col(label) == 1, F.col("n"))).over(all_rows)
    two = F.when(F.col(label) == 0, 1.0).otherwise((total - one).cast("double") / one / 2)
    return n.select(label, "n", F.when(kinds == 2, two).otherwise(total / (kinds * F.col("n"))).alias("weight"))


def clamp(df: DataFrame, column: str, reference: DataFrame, label: str = "label", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """df with the column held between the reference labels' exact percentiles; as it is where there are none."""
    q = quantiles(cut(reference.select(label)), label, [low, high])
    if q is None:
        return df
    return df.withColumn(column, F.least(F.greatest(F.col(column), F.lit(q[0])), F.lit(q[1])))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def nan_to_num(x: Column, big: float = 1e6) -> Column:
    return F.when(x.isNull() | F.isnan(x), 0.0).when(x == float("inf"), big).when(x == float("-inf"), -big).otherwise(x)


def gather(predictions: DataFrame, seeds: DataFrame, missing: float = -100.0) -> DataFrame:
    """A prediction for every seed, `missing` where none came back."""
    return seeds.join(predictions, "SeedId", "left").select("SeedId", F.coalesce("pred", F.lit(missing)).alias("pred"))


def vq_assign(vectors: DataFrame, codebook: list[list[float]], column: str = "x") -> DataFrame:
    """vectors with the code of the nearest centroid (the codebook is a model parameter, sent with the plan)."""
    codes = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in codebook])
    far = F.transform(codes, lambda c: F.aggregate(F.zip_with(c, column, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return vectors.withColumn("code", (F.array_position(far, F.array_min(far)) - 1).cast("int"))


def vq_update(assigned: DataFrame, sizes: list[float], decay: float = 0.99, eps: float = 1e-5) -> DataFrame:
    """(code, size): moving averages of cluster sizes, smoothed so that none is zero."""
    n = assigned.groupBy("code").agg(F.count("*").alias("n"))
    k = len(sizes)
    old = assigned.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(sizes)], "code int, old double")
    moved = old.join(n, "code", "left").select("code", (F.col("old") * decay + F.coalesce("n", F.lit(0)) * (1 - decay)).alias("ema"))
    total = F.sum("ema").over(Window.partitionBy(F.lit(1)))  # one row a code
    return moved.select("code", ((F.col("ema") + eps) / (total + k * eps) * total).alias("size"))


def vq_embed_update(assigned: DataFrame, codebook: list[list[float]], sizes: list[float], sums: list[list[float]], decay: float = 0.99, eps: float = 1e-5, column: str = "x") -> DataFrame:
    """(code, k, v): the moved centroids: moving averages of each code's vector sums over its smoothed size.

    A codebook is a model parameter; the vectors are summed by code and dimension, partial on the map side.
    """
    spark = assigned.sparkSession
    moved = vq_update(assigned, sizes, decay, eps)
    new = assigned.select("code", F.posexplode(column).alias("k", "x")).groupBy("code", "k").agg(F.sum("x").alias("x"))
    old = spark.createDataFrame([(j, k, float(v)) for j, row in enumerate(sums) for k, v in enumerate(row)], "code int, k int, old double")
    both = old.join(new, ["code", "k"], "left").join(moved, "code")
    return both.select("code", "k", ((F.col("old") * decay + F.coalesce("x", F.lit(0.0)) * (1 - decay)) / F.col("size")).alias("v"))


def text_average(docs: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, k, v): mean of word vectors (word, x) over a text's words that have one, by dimension."""
    tokens = docs.select("doc_id", F.explode(F.split(F.lower(text), r"\W+")).alias("word")).where("word <> ''")
    hit = tokens.groupBy("doc_id", "word").agg(F.count("*").alias("n")).join(words, "word")
    return hit.select("doc_id", "n", F.posexplode("x").alias("k", "v")).groupBy("doc_id", "k").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
