"""Scores, bounds, ranks, rules and configurations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import t_critical
from ..operators import bounds, rules, scoring, seeds, stats
from ..operators.cut import cut
from ..sources.catalog import Database
from .registry import query
from .seed_queries import N_BATCHES, SPEND
from .stat_queries import BASE, EXTENSIONS, LONG, PATHS

DELTA = 0.1
LAYERS, FANOUT = 4, 64
_T = t_critical(DELTA, N_BATCHES - 1)
_RATE = "CASE WHEN parent = 0 THEN 0.0::DOUBLE ELSE cnt::DOUBLE / parent END"
LONG_SQL = f"""{BASE}, batched AS (SELECT *, CAST(ntile({N_BATCHES}) OVER (ORDER BY SeedId, ts) AS INT) AS batch_id FROM churn),
 long AS (SELECT b.batch_id, x.*, round(ln(1 + {_RATE}), 9) AS log_rate, round(ln(1 + cnt), 9) AS log_count FROM ({LONG}) x JOIN batched b ON b.SeedId = x.SeedId AND b.ts = x.ts)"""


def _summary_sql(value: str) -> str:
    return f"""SELECT a.batch_id, a.hop, a.prefix, a.feature, CASE WHEN h.h > 0 THEN least(greatest(m.mi / h.h, 0.0), 1.0) ELSE 0.0 END AS npmi, a.cost, a.n_samples, a.n_nonzero,
 CASE WHEN a.cost > 0 THEN (CASE WHEN h.h > 0 THEN least(greatest(m.mi / h.h, 0.0), 1.0) ELSE 0.0 END) / a.cost ELSE 0.0 END AS score
 FROM (SELECT batch_id, hop, prefix, feature, coalesce(avg(CASE WHEN cnt <> 0 THEN cnt::DOUBLE END), 0.0) AS cost, count(*) AS n_samples, CAST(sum(CASE WHEN cnt <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonzero FROM long GROUP BY ALL) a
 JOIN (SELECT batch_id, feature, greatest(sum(nxy::DOUBLE / n * ln(nxy::DOUBLE * n / (nx::DOUBLE * ny))), 0.0) AS mi FROM
  (SELECT batch_id, feature, nxy, sum(nxy) OVER (PARTITION BY batch_id, feature, v) AS nx, sum(nxy) OVER (PARTITION BY batch_id, feature, label) AS ny, sum(nxy) OVER (PARTITION BY batch_id, feature) AS n
   FROM (SELECT batch_id, feature, {value} AS v, label, count(*) AS nxy FROM long GROUP BY ALL)) GROUP BY ALL) m USING (batch_id, feature)
 JOIN (SELECT batch_id, feature, -sum(p * ln(p)) AS h FROM (SELECT batch_id, feature, n::DOUBLE / sum(n) OVER (PARTITION BY batch_id, feature) AS p FROM (SELECT batch_id, feature, label, count(*) AS n FROM long GROUP BY ALL)) GROUP BY ALL) h USING (batch_id, feature)"""


S_SQL = f"{LONG_SQL}, scores AS (SELECT *, 'log_rate' AS aggregate_type FROM ({_summary_sql('log_rate')}) UNION ALL SELECT *, 'log_count' FROM ({_summary_sql('log_count')}))"
L_SQL = f"""{S_SQL}, cover AS (SELECT hop, prefix, feature, avg(c) AS cov_mean, coalesce(stddev_samp(c), 0.0) AS cov_std, count(DISTINCT batch_id) AS n_cov_batches
  FROM (SELECT *, n_nonzero::DOUBLE / greatest(n_samples, 1) AS c FROM scores WHERE aggregate_type = 'log_rate') GROUP BY ALL),
 main AS (SELECT hop, prefix, feature, aggregate_type, avg(score) AS mu_tr, coalesce(stddev_samp(score), 0.0) AS sigma_tr, count(DISTINCT batch_id) AS n_train_batches FROM scores GROUP BY ALL),
 lcb AS (SELECT m.*, c.cov_mean, c.cov_std, c.n_cov_batches, CASE WHEN c.cov_mean > 0 THEN c.cov_std / c.cov_mean ELSE 0.0 END AS cov_cv,
  mu_tr - {_T!r} * sigma_tr / sqrt(n_train_batches) AS lcb_tr, cov_mean - {_T!r} * cov_std / sqrt(n_cov_batches) AS cov_lcb_tr FROM main m LEFT JOIN cover c USING (hop, prefix, feature)),
 wide AS (SELECT hop, prefix, feature, coalesce(max(CASE WHEN aggregate_type = 'log_rate' THEN lcb_tr END), 0.0) AS lcb_tr_log_rate, coalesce(max(CASE WHEN aggregate_type = 'log_count' THEN lcb_tr END), 0.0) AS lcb_tr_log_count,
  max(cov_mean) AS cov_mean, max(cov_std) AS cov_std, max(cov_cv) AS cov_cv, max(cov_lcb_tr) AS cov_lcb_tr FROM lcb GROUP BY ALL)"""
_PCT = lambda c: f"(rank() OVER (PARTITION BY hop ORDER BY {c}) + (count(*) OVER (PARTITION BY hop, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY hop)"
Q_SQL = f"""{L_SQL}, r AS (SELECT hop, prefix, feature, CAST({_PCT('lcb_tr_log_rate')} AS DOUBLE) AS p_rate, CAST({_PCT('lcb_tr_log_count')} AS DOUBLE) AS p_count, CAST({_PCT('cov_lcb_tr')} AS DOUBLE) AS p_cov FROM
  (SELECT hop, prefix, feature, round(lcb_tr_log_rate, 12) AS lcb_tr_log_rate, round(lcb_tr_log_count, 12) AS lcb_tr_log_count, round(cov_lcb_tr, 12) AS cov_lcb_tr FROM wide WHERE NOT (lcb_tr_log_rate = 0 AND lcb_tr_log_count = 0 AND cov_lcb_tr = 0))),
 q AS (SELECT hop, prefix, feature, greatest(p_rate, p_count) + p_cov AS Q_score, CASE WHEN p_rate > p_count THEN 'log_rate' WHEN p_rate < p_count THEN 'log_count' ELSE 'tie' END AS winner_agg, p_rate, p_count, p_cov FROM r),
 good AS (SELECT *, CAST(CASE WHEN Q_score >= 1.3 THEN 1 ELSE 0 END AS INT) AS cluster_id FROM q)"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def _round_sql(columns: str, source: str, doubles: str) -> str:
    return f"SELECT {columns}{', ' if columns else ''}" + ", ".join(f"round({d}, 9) AS {d}" for d in doubles.split()) + f" FROM {source}"


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every seed and extension with the seed's batch; the seeds are computed once."""
    db = Database(spark, sf_dir)
    return stats.long(db, cut(seeds.batches(seeds.churn(db), N_BATCHES)), [PATHS[k] for k in EXTENSIONS])


def value(kind: str) -> Column:
    """A strategy's value from cnt and parent, rounded as its SQL is."""
    return F.round(F.log1p(stats.rate(F.col("cnt"), F.col("parent"))) if kind == "log_rate" else stats.log_count(F.col("cnt")), 9)


def scores(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("log_rate", "log_count")) -> DataFrame:
    """A row for each strategy, batch and extension: few, from joint counts that are few as well."""
    return scoring.summary(scoring.joint(long(spark, sf_dir)), {k: value(k) for k in kinds})


def lcb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.lcb_summary(cut(scores(spark, sf_dir)), N_BATCHES, DELTA)


def q(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = bounds.wide(lcb(spark, sf_dir))
    return bounds.q_scores(wide.select(*[F.round(c, 12).alias(c) if t == "double" else c for c, t in wide.dtypes]))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed threshold in place of the mixture, so that SQL can follow."""
    return cut(q(spark, sf_dir)).withColumn("cluster_id", (F.col("Q_score") >= 1.3).cast("int"))


@query(f"{LONG_SQL} SELECT batch_id, feature, round(-sum(p * ln(p)), 9) AS h FROM (SELECT batch_id, feature, n::DOUBLE / sum(n) OVER (PARTITION BY batch_id, feature) AS p FROM (SELECT batch_id, feature, label, count(*) AS n FROM long GROUP BY ALL)) GROUP BY ALL")
def label_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.entropy(long(spark, sf_dir), ["batch_id", "feature"]))


@query(f"WITH {SPEND} SELECT unnest([round(x, 6) FOR x IN list_sort(list_distinct(quantile_cont(label, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1])))]) AS edge FROM spend")
def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.quantile_edges(seeds.spend(Database(spark, sf_dir)), "label", 8).select(F.explode("edges").alias("edge")).select(F.round("edge", 6).alias("edge"))


@query(f"""WITH {SPEND}, e AS (SELECT list_sort(list_distinct(quantile_cont(label, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS edges FROM spend)
 SELECT CAST(len(list_filter(edges[2:len(edges) - 1], lambda c: label > c)) AS INT) AS bin, count(*) AS n FROM spend, e GROUP BY ALL""")
def bin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = seeds.spend(Database(spark, sf_dir))
    edges = F.array(*map(F.lit, scoring.quantile_edges(df, "label", 8).first()["edges"]))
    return df.groupBy(scoring.bin_of(F.col("label"), edges).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {SPEND}, a AS (SELECT label FROM spend UNION ALL SELECT label * 2 FROM spend)
 SELECT unnest([round(x, 6) FOR x IN list_sort(list_distinct(quantile_cont(label, [0, 0.25, 0.5, 0.75, 1])))]) AS edge FROM a""")
def global_regression_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = seeds.spend(Database(spark, sf_dir))
    found = scoring.global_edges([df, df.select((F.col("label") * 2).alias("label"))], bins=4)
    return spark.createDataFrame([(round(x, 6),) for x in found], "edge double")


@query(f"""{LONG_SQL} SELECT hop, batch_id, count(*) AS n_seeds, round(avg(n), 9) AS mean_rows, max(n) AS most_rows FROM
 (SELECT hop, batch_id, SeedId, ts, CAST(sum(cnt) AS BIGINT) AS n FROM long GROUP BY ALL) GROUP BY hop, batch_id""")
def size_per_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.hop_sizes(long(spark, sf_dir)))


@query(f"""{LONG_SQL}, w AS (SELECT hop, prefix, feature, batch_id, row_number() OVER (PARTITION BY hop ORDER BY score DESC, prefix, feature, batch_id) AS place, score
  FROM (SELECT * REPLACE (round(score, 9) AS score) FROM ({_summary_sql('log_count')}))) SELECT hop, prefix, feature, batch_id, CAST(place AS INT) AS place, score FROM w""")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.in_order(rounded(scores(spark, sf_dir, ("log_count",))).select("hop", "prefix", "feature", "batch_id", "score"))


@query(f"""WITH {SPEND}, s AS (SELECT count(label) AS n, max(label) - min(label) AS w, quantile_cont(label, 0.75) - quantile_cont(label, 0.25) AS iqr FROM spend),
 t AS (SELECT *, w / (log2(n) + 1) AS sturges, 2 * iqr * pow(n, -1.0 / 3) AS fd FROM s), u AS (SELECT *, CASE WHEN fd > 0 THEN least(greatest(fd, w / sqrt(n) / 2), sturges) ELSE sturges END AS step FROM t)
 SELECT CAST(greatest(least(least(greatest(ceil(w / step), 5), 64), floor(n / 200)), 1) AS BIGINT) AS bins FROM u""")
def bin_count_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bin_count(seeds.spend(Database(spark, sf_dir)), "label")


_DOUBLES = "npmi cost score"
_IDS = "batch_id, hop, prefix, feature, n_samples, n_nonzero"


@query(f"{LONG_SQL} {_round_sql(_IDS, '(' + _summary_sql('log_rate') + ')', _DOUBLES)}")
def score_log_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores(spark, sf_dir, ("log_rate",)).drop("aggregate_type"))


@query(f"{LONG_SQL} {_round_sql(_IDS, '(' + _summary_sql('log_count') + ')', _DOUBLES)}")
def score_log_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores(spark, sf_dir, ("log_count",)).drop("aggregate_type"))


@query(f"{LONG_SQL} SELECT hop, prefix, feature, batch_id, rank, round(score, 9) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY hop ORDER BY score DESC, batch_id, prefix, feature) AS INT) AS rank FROM (SELECT * REPLACE (round(score, 12) AS score) FROM ({_summary_sql('log_count')}))) WHERE rank <= 5")
def topk_per_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir, ("log_count",)).withColumn("score", F.round("score", 12))
    return rounded(scoring.top_per_hop(s).select("hop", "prefix", "feature", "batch_id", "rank", "score"))


@query()
def knn_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.knn_mi_by_group(long(spark, sf_dir).withColumn("log_count", value("log_count")), "log_count")


_LCB = "mu_tr sigma_tr cov_mean cov_std cov_cv lcb_tr cov_lcb_tr"


@query(f"{L_SQL} {_round_sql('hop, prefix, feature, aggregate_type, n_train_batches, n_cov_batches', 'lcb', _LCB)}")
def lcb_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lcb(spark, sf_dir))


@query(f"{L_SQL} {_round_sql('hop, prefix, feature', 'wide', 'lcb_tr_log_rate lcb_tr_log_count cov_mean cov_std cov_cv cov_lcb_tr')}")
def lcb_wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bounds.wide(lcb(spark, sf_dir)))


@query(f"{L_SQL} SELECT NOT (lcb_tr_log_rate = 0 AND lcb_tr_log_count = 0 AND cov_lcb_tr = 0) AS live, count(*) AS n FROM wide GROUP BY ALL")
def dead_and_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = bounds.wide(lcb(spark, sf_dir))
    return bounds.live(wide).select(F.lit(True).alias("live")).unionByName(bounds.dead(wide).select(F.lit(False).alias("live"))).groupBy("live").agg(F.count("*").alias("n"))


@query(f"{Q_SQL} {_round_sql('hop, prefix, feature, winner_agg', 'q', 'Q_score p_rate p_count p_cov')}")
def q_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(q(spark, sf_dir))


@query()
def gmm_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.split(q(spark, sf_dir))


_PATH = "regexp_replace(feature, '__cnt_.*$', '')"
_GOOD = f"EXISTS (SELECT 1 FROM good d WHERE d.cluster_id >= 1 AND (regexp_replace(d.feature, '__cnt_.*$', '') = {{p}} OR starts_with(regexp_replace(d.feature, '__cnt_.*$', ''), {{p}} || '__')))"
R_SQL = f"""{Q_SQL}, dec AS (SELECT hop, prefix, substring({_PATH}, length(prefix) + 3) AS edge, {_GOOD.format(p="regexp_replace(g.feature, '__cnt_.*$', '')")} AS expand FROM good g)"""


@query(f"{Q_SQL} SELECT hop, prefix, {_PATH} AS path, substring({_PATH}, length(prefix) + 3) AS edge FROM good")
def edge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rules.meta_path(F.col("feature"))
    return judged(spark, sf_dir).select("hop", "prefix", path.alias("path")).withColumn("edge", rules.edge_of(F.col("prefix"), F.col("path")))


@query(f"{R_SQL} SELECT prefix || '__' || edge AS path, expand AS good FROM dec")
def has_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.has_good(rules.normalise(judged(spark, sf_dir)))


@query(f"{R_SQL} SELECT hop, prefix, edge, expand FROM dec")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decisions(rules.normalise(judged(spark, sf_dir))).drop("reason")


_REV = "split_part(edge, '__', 2) AS src, CASE WHEN starts_with(edge, 'rev_') THEN substring(split_part(edge, '__', 1), 5) ELSE 'rev_' || split_part(edge, '__', 1) END AS rel, list_extract(string_split(prefix, '__'), -1) AS dst"


@query(f"{R_SQL} SELECT hop, prefix, edge FROM dec WHERE NOT expand")
def prune_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.prune_rules(rules.normalise(judged(spark, sf_dir))).select("hop", "prefix", "edge")


@query(f"{R_SQL} SELECT hop, {_REV} FROM dec")
def reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decisions(rules.normalise(judged(spark, sf_dir))).select("hop", *rules.sampler_edge(F.col("prefix"), F.col("edge")))


@query(f"""{R_SQL}, cut AS (SELECT hop, {_REV} FROM dec WHERE NOT expand), by_edge AS (SELECT src, rel, dst, list(hop) AS hops FROM cut GROUP BY ALL)
 SELECT src, rel, dst, array_to_string([CASE WHEN list_contains(hops, h) THEN 0 ELSE {FANOUT} END FOR h IN range({LAYERS})], ',') AS fanout FROM by_edge""")
def prune_mask_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = rules.pruned_config(rules.prune_rules(rules.normalise(judged(spark, sf_dir))), LAYERS, FANOUT)
    return config.withColumn("fanout", F.array_join("fanout", ","))
