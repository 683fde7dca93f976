"""Search, log, configuration and metric queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, rules, search, seeds
from ..sources.catalog import Database
from .registry import query
from .seed_queries import CHURN, SPEND

THETA = [0.5, 0.25]
_AT = "1999-01-01"
SETUP = f"""WITH {CHURN}, bags AS (SELECT SeedId AS bag_id, SeedId AS id, 1.0::DOUBLE AS alpha, label AS y FROM churn WHERE ts = TIMESTAMP '{_AT}'),
 feats AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x1, 1.0::DOUBLE AS x2 FROM customer UNION ALL SELECT 1000000000 + o_orderkey, o_totalprice / 100000, 2.0 FROM orders),
 edges AS (SELECT o_custkey AS src, 'rev_f2p_o_custkey' AS rel, 1000000000 + o_orderkey AS dst FROM orders UNION ALL SELECT 1000000000 + o_orderkey, 'f2p_o_custkey', o_custkey FROM orders)"""
_H = "(0.5 * x1 + 0.25 * x2)"


def _setup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    db = Database(spark, sf_dir)
    bags = seeds.churn(db, [_AT]).select(F.col("SeedId").alias("bag_id"), F.col("SeedId").alias("id"), F.lit(1.0).alias("alpha"), F.col("label").alias("y"))
    order = (F.col("o_orderkey") + 1000000000).alias
    own = db.read("customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.lit(1.0)).alias("x"))
    feats = own.unionByName(db.read("orders").select(order("id"), F.array(F.col("o_totalprice") / 100000, F.lit(2.0)).alias("x")))
    out = db.read("orders").select(F.col("o_custkey").alias("src"), F.lit("rev_f2p_o_custkey").alias("rel"), order("dst"))
    return bags, feats, out.unionByName(db.read("orders").select(order("src"), F.lit("f2p_o_custkey").alias("rel"), F.col("o_custkey").alias("dst")))


@query(f"{SETUP} SELECT DISTINCT rel FROM edges WHERE src IN (SELECT id FROM bags)")
def relation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags, _, edges = _setup(spark, sf_dir)
    return search.relation_candidates(edges, bags)


_BAGS2 = f"bags2 AS (SELECT b.bag_id, e.dst AS id, b.y, sum(b.alpha * {_H}) AS alpha FROM bags b JOIN feats f USING (id) JOIN (SELECT DISTINCT src, dst FROM edges WHERE rel = 'rev_f2p_o_custkey') e ON e.src = b.id GROUP BY ALL)"


@query(f"{SETUP}, {_BAGS2} SELECT bag_id, id, y, round(alpha, 9) AS alpha FROM bags2")
def bag_expand_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags, feats, edges = _setup(spark, sf_dir)
    return search.expand_bags(bags, edges, feats, "rev_f2p_o_custkey", THETA).withColumn("alpha", F.round("alpha", 9))


def _scores(spark: SparkSession, sf_dir: str, per_node: bool) -> DataFrame:
    bags, feats, edges = _setup(spark, sf_dir)
    grown = search.expand_bags(bags, edges, feats, "rev_f2p_o_custkey", THETA)
    weights = feats.select("id", (F.element_at("x", 1) / 10).alias("w"))
    return search.bag_scores(grown, edges, feats, weights, "f2p_o_custkey", THETA, per_node)


_ROWS = f"rows_ AS (SELECT b.bag_id, b.y, {_H} AS h, coalesce(s.s, 1.0) * b.alpha AS a FROM bags2 b JOIN feats f USING (id) LEFT JOIN (SELECT e.src AS id, sum(f.x1 / 10) AS s FROM (SELECT DISTINCT src, dst FROM edges WHERE rel = 'f2p_o_custkey') e JOIN feats f ON f.id = e.dst GROUP BY e.src) s ON s.id = b.id)"


@query(f"{SETUP}, {_BAGS2}, {_ROWS} SELECT bag_id, y, round(sum(h) * sum(a), 6) AS score FROM rows_ GROUP BY bag_id, y")
def bag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, False).withColumn("score", F.round("score", 6))


@query(f"{SETUP}, {_BAGS2}, {_ROWS} SELECT bag_id, y, round(sum(h * a), 6) AS score FROM rows_ GROUP BY bag_id, y")
def bag_scores_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, True).withColumn("score", F.round("score", 6))


@query(f"{SETUP}, {_BAGS2}, {_ROWS}, s AS (SELECT bag_id, y, round(sum(h * a), 6) AS score FROM rows_ GROUP BY bag_id, y) SELECT round(sum(1 / (1 + exp(-(n.score - p.score)))), 4) AS loss, count(*) AS n_pairs FROM s p, s n WHERE p.y = 1 AND n.y = 0")
def pairwise_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.pairwise_loss(_scores(spark, sf_dir, True).withColumn("score", F.round("score", 6)))
    return out.select(F.round("loss", 4).alias("loss"), "n_pairs")


_LOSS_SQL = "(SELECT event_type AS rel, round(avg(value), 9) AS loss FROM events GROUP BY event_type)"


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Database(spark, sf_dir).read("events").groupBy(F.col("event_type").alias("rel")).agg(F.round(F.avg("value"), 9).alias("loss"))


@query(f"SELECT * FROM {_LOSS_SQL} ORDER BY loss, rel LIMIT 3")
def relation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_relations(_losses(spark, sf_dir), 3)


@query(f"SELECT * FROM {_LOSS_SQL} ORDER BY loss DESC, rel LIMIT 2")
def relation_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.worst_relations(_losses(spark, sf_dir), 2)


@query("SELECT c_name AS path, c_acctbal / CASE WHEN c_nationkey = 0 THEN NULL ELSE 1000 END AS auc FROM customer WHERE c_nationkey <> 0 ORDER BY c_acctbal DESC, c_name LIMIT 20")
def beam_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Database(spark, sf_dir).read("customer")
    auc = F.when(F.col("c_nationkey") == 0, F.when(F.col("c_custkey") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("c_acctbal") / 1000)
    return search.beam_prune(own.select(F.col("c_name").alias("path"), auc.alias("auc")), "auc", 20)


_SUMS = "b1 AS (SELECT bag_id, y, round(sum(alpha), 9) AS s FROM bags2 GROUP BY ALL), b2 AS (SELECT bag_id, y, round(sum(alpha), 9) AS s FROM bags3 GROUP BY ALL)"
_BAGS3 = f"bags3 AS (SELECT b.bag_id, e.dst AS id, b.y, sum(b.alpha * {_H}) AS alpha FROM bags2 b JOIN feats f USING (id) JOIN (SELECT DISTINCT src, dst FROM edges WHERE rel = 'f2p_o_custkey') e ON e.src = b.id GROUP BY ALL)"


def _auc_sql(path: str, hop: int, source: str) -> str:
    return f"""SELECT '{path}' AS path, CAST({hop} AS INT) AS hop, round((s - p * (p + 1) / 2.0) / (p * n::DOUBLE), 6) AS auc FROM (SELECT CAST(sum(CASE WHEN y = 1 THEN k END) AS DOUBLE) AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n
 FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM {source}))"""


@query(f"{SETUP}, {_BAGS2}, {_BAGS3}, {_SUMS} {_auc_sql('rev_f2p_o_custkey', 1, 'b1')} UNION ALL {_auc_sql('rev_f2p_o_custkey__f2p_o_custkey', 2, 'b2')}")
def beam_search_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags, feats, edges = _setup(spark, sf_dir)
    weights = feats.select("id", (F.element_at("x", 1) / 10).alias("w"))
    return search.beam_over_tables(bags, edges, feats, weights, THETA, rounds=2, top=2, width=2).withColumn("auc", F.round("auc", 6))


@query(f"{SETUP}, {_BAGS2}, {_BAGS3} SELECT bag_id, y, round(sum(alpha), 6) AS total, count(*) AS n FROM bags3 GROUP BY ALL")
def replay_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags, feats, edges = _setup(spark, sf_dir)
    end = search.replay(bags, edges, feats, ["rev_f2p_o_custkey", "f2p_o_custkey"], THETA)
    return end.groupBy("bag_id", "y").agg(F.round(F.sum("alpha"), 6).alias("total"), F.count("*").alias("n"))


@query(f"{SETUP}, n AS (SELECT y, count(DISTINCT bag_id) AS n FROM bags GROUP BY y) SELECT y, CAST(round_even(0.25 * n, 0) AS BIGINT) AS first, n - CAST(round_even(0.25 * n, 0) AS BIGINT) AS second FROM n")
def stratified_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = search.split_bags(_setup(spark, sf_dir)[0], 0.25)
    both = first.select("y", F.lit(1).alias("a")).unionByName(second.select("y", F.lit(0).alias("a")))
    return both.groupBy("y").agg(F.sum("a").alias("first"), F.sum(1 - F.col("a")).alias("second"))


@query("""WITH s AS (SELECT doc_id, toxic AS y, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS INT) / 256.0 * 0.5 + toxic * 0.25 AS score FROM labels),
 g AS (SELECT score, sum(y) AS p, count(*) AS n FROM s GROUP BY score), c AS (SELECT p, sum(p) OVER w AS hit, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC))
 SELECT round(CAST(sum(p * hit / seen::DOUBLE) / sum(p) AS DOUBLE), 9) AS auprc FROM c""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_predictions(spark, sf_dir)).select(F.round("auprc", 9).alias("auprc"))


@query(f"{SETUP} SELECT e.src AS id, round(sum(f.x1), 4) AS x1, round(sum(f.x2), 4) AS x2 FROM edges e JOIN feats f ON f.id = e.dst WHERE e.rel = 'rev_f2p_o_custkey' GROUP BY e.src")
def message_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, feats, edges = _setup(spark, sf_dir)
    return search.message_sum(edges, feats, "rev_f2p_o_custkey").select("id", F.round(F.element_at("x", 1), 4).alias("x1"), F.round(F.element_at("x", 2), 4).alias("x2"))


LOG = [
    "2026-01-01 00:00:00 - INFO - (path=[2, 1], hop=2, sort_by=auc_roc) rank=1 auc_roc=0.8125",
    "2026-01-01 00:00:00 - INFO - hop 1 scored",
    "2026-01-01 00:00:01 - INFO - (path=[1], hop=1, sort_by=auc_roc) rank=2 auc_roc=0.75",
    "  rel=1   loss=3.5 name=('customer', 'rev_f2p_o_custkey', 'orders')",
    "2026-01-01 00:00:02 - INFO - (path=[3, 2, 1], hop=3, sort_by=auc_roc) rank=3 auc_roc=0.5",
    "2026-01-01 00:00:03 - INFO - (path=[0], hop=1, sort_by=auc_roc) rank=4 auc_roc=0.25",
]
RELATIONS = [(0, "customer", "f2p_c_nationkey", "nation"), (1, "customer", "rev_f2p_o_custkey", "orders"), (2, "orders", "rev_f2p_l_orderkey", "lineitem"), (3, "lineitem", "f2p_l_partkey", "part")]
_LINES = "lines(value) AS (VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in LOG) + ")"
_RELS = "rels(id, src, rel, dst) AS (VALUES " + ", ".join(str(r) for r in RELATIONS) + ")"
_RANKED = f"""WITH {_LINES}, {_RELS}, ranked AS (SELECT CAST(regexp_extract(value, 'rank=(\\d+)', 1) AS INT) AS rank, CAST(regexp_extract(value, 'hop=(\\d+)', 1) AS INT) AS hop, regexp_extract(value, 'sort_by=(\\w+)', 1) AS sort_by,
 CAST(regexp_extract(value, 'rank=\\d+ \\w+=(-?[\\d.]+)', 1) AS DOUBLE) AS metric, CAST(regexp_extract(value, 'path=(\\[[\\d, ]*\\])', 1) AS INT[]) AS path FROM lines WHERE regexp_matches(value, 'path=\\[[\\d, ]*\\], hop=\\d+, sort_by=\\w+\\) rank='))"""


def _ranked(spark: SparkSession) -> DataFrame:
    return rules.parse_ranked(spark.createDataFrame([(x,) for x in LOG], "value string"))


@query(f"{_RANKED} SELECT rank, hop, sort_by, metric, array_to_string(path, '-') AS path FROM ranked")
def ranked_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "-"))


_STEPS = f"{_RANKED}, steps AS (SELECT rank, hop, CAST(i AS INT) AS position, list_reverse(path)[i + 1] AS id FROM (SELECT *, unnest(range(len(path))) AS i FROM ranked))"


def _relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "id int, src string, rel string, dst string")


@query(f"{_STEPS} SELECT rank, hop, position, src, rel, dst FROM steps JOIN rels USING (id)")
def decode_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.forward_paths(_ranked(spark), _relations(spark))


@query(f"""{_STEPS}, kept AS (SELECT * FROM steps WHERE rank IN (SELECT rank FROM ranked WHERE hop <= 3 ORDER BY rank LIMIT 3)),
 by_edge AS (SELECT r.dst AS src, CASE WHEN starts_with(r.rel, 'rev_') THEN substring(r.rel, 5) ELSE 'rev_' || r.rel END AS rel, r.src AS dst, list(position) AS spots FROM kept k JOIN rels r USING (id) GROUP BY ALL)
 SELECT src, rel, dst, array_to_string([CASE WHEN list_contains(spots, h) THEN 64 ELSE 0 END FOR h IN range(3)], ',') AS fanout FROM by_edge""")
def topk_merge_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.merge_top(_ranked(spark), _relations(spark), 3, 3, 64).withColumn("fanout", F.array_join("fanout", ","))


_PRED = "pred AS (SELECT doc_id, toxic AS y, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS INT) / 256.0 * 0.5 + toxic * 0.25 AS score FROM labels)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("double") / 256 * 0.5 + F.col("toxic") * 0.25
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("y"), score.alias("score"))


@query(f"WITH {_PRED} SELECT round(avg(CASE WHEN (score >= 0.4) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS micro_f1 FROM pred")
def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro_f1(_predictions(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.4).cast("int"))).select(F.round("micro_f1", 9).alias("micro_f1"))


_AUC = "r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM p), a AS (SELECT CAST(sum(CASE WHEN y = 1 THEN k END) AS DOUBLE) AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM r) SELECT round((s - p * (p + 1) / 2.0) / (p * n::DOUBLE), 9) AS auc FROM a"


@query(f"WITH {_PRED}, p AS (SELECT y, score AS s FROM pred), {_AUC}")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_predictions(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {_PRED}, p AS (SELECT y, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS s FROM pred), {_AUC}")
def roc_auc_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_predictions(spark, sf_dir).withColumn("score", (F.col("score") >= 0.4).cast("int"))).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {_PRED} SELECT round(avg(abs(score - y)), 9) AS mae FROM pred")
def mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mae(_predictions(spark, sf_dir).withColumn("pred", F.col("score"))).select(F.round("mae", 9).alias("mae"))


@query(f"WITH {SPEND}, q AS (SELECT quantile_cont(label, 0.02) AS a, quantile_cont(label, 0.98) AS b FROM spend) SELECT SeedId, CAST(ts AS VARCHAR) AS ts, round(least(greatest(label * 1.5 - 10, a), b), 4) AS pred FROM spend, q")
def pred_clamp_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = seeds.spend(Database(spark, sf_dir))
    out = metrics.clamp(own.withColumn("pred", F.col("label") * 1.5 - 10), "pred", own)
    return out.select("SeedId", F.col("ts").cast("string").alias("ts"), F.round("pred", 4).alias("pred"))


@query(f"WITH {CHURN}, n AS (SELECT label, greatest(count(*), 1) AS n FROM churn GROUP BY label), t AS (SELECT max(CASE WHEN label = 1 THEN n END) AS p, max(CASE WHEN label = 0 THEN n END) AS q FROM n) SELECT label, n, round(CASE WHEN label = 0 THEN 1.0 ELSE q::DOUBLE / p / 2 END, 9) AS weight FROM n, t")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(seeds.churn(Database(spark, sf_dir))).withColumn("weight", F.round("weight", 9))


@query("SELECT c_custkey AS SeedId, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE -100.0 END AS pred FROM customer")
def prediction_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Database(spark, sf_dir).read("customer").select(F.col("c_custkey").alias("SeedId"), F.col("c_acctbal").alias("pred"))
    return metrics.gather(own.where("pred > 0"), own.select("SeedId"))


CODEBOOK = [[((j * 7 + i * 3) % 11 - 5) / 20 for i in range(64)] for j in range(5)]
_CODES = "codes(code, c) AS (VALUES " + ", ".join(f"({j}, [{', '.join(f'{v!r}::DOUBLE' for v in c)}])" for j, c in enumerate(CODEBOOK)) + ")"
_VQ = f"WITH {_CODES}, d AS (SELECT vec_id, code, list_sum([(embedding[i]::DOUBLE - c[i]) * (embedding[i]::DOUBLE - c[i]) FOR i IN range(1, 65)]) AS far FROM embeddings, codes), a AS (SELECT vec_id, CAST(code AS INT) AS code FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY far, code) AS k FROM d) WHERE k = 1)"


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return metrics.vq_assign(own, CODEBOOK).select("vec_id", "code")


@query(f"{_VQ} SELECT vec_id, code FROM a")
def vq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)


@query(f"{_VQ}, e AS (SELECT CAST(c.code AS INT) AS code, 10.0 * 0.99 + count(a.vec_id) * (1 - 0.99) AS ema FROM codes c LEFT JOIN a ON a.code = c.code GROUP BY c.code), t AS (SELECT sum(ema) AS total FROM e) SELECT code, round((ema + 1e-5) / (total + 5 * 1e-5) * total, 6) AS size FROM e, t")
def vq_ema_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.vq_update(_assigned(spark, sf_dir), [10.0] * 5).withColumn("size", F.round("size", 6))


@query(f"{_VQ}, e AS (SELECT CAST(c.code AS INT) AS code, 10.0 * 0.99 + count(a.vec_id) * (1 - 0.99) AS ema FROM codes c LEFT JOIN a ON a.code = c.code GROUP BY c.code), t AS (SELECT sum(ema) AS total FROM e), z AS (SELECT code, (ema + 1e-5) / (total + 5 * 1e-5) * total AS size FROM e, t), d2 AS (SELECT i - 1 AS k, a.code, sum(e.embedding[i]::DOUBLE) AS x FROM a JOIN embeddings e USING (vec_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) SELECT z.code, CAST(g.k AS INT) AS k, round((c.c[g.k + 1] * 10.0 * 0.99 + coalesce(d2.x, 0.0) * (1 - 0.99)) / z.size, 6) AS v FROM z JOIN codes c ON c.code = z.code CROSS JOIN (SELECT unnest(range(64)) AS k) g LEFT JOIN d2 ON d2.code = z.code AND d2.k = g.k")
def vq_ema_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    moved = metrics.vq_embed_update(metrics.vq_assign(own, CODEBOOK), CODEBOOK, [10.0] * 5, [[v * 10.0 for v in c] for c in CODEBOOK])
    return moved.withColumn("v", F.round("v", 6))


WORDS = [("the", [1.0, 0.0]), ("of", [0.0, 1.0]), ("que", [2.0, 1.0]), ("der", [-1.0, 0.5])]
_WORDS = "words(word, x) AS (VALUES " + ", ".join(f"('{w}', {x}::DOUBLE[])" for w, x in WORDS) + ")"


@query(f"WITH {_WORDS}, t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\W+')) AS word FROM documents), h AS (SELECT t.doc_id, w.x FROM t JOIN words w USING (word)) SELECT doc_id, CAST(i AS INT) AS k, round(avg(x[i + 1]), 9) AS v FROM h, (SELECT unnest(range(2)) AS i) GROUP BY ALL")
def text_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return metrics.text_average(docs, spark.createDataFrame(WORDS, "word string, x array<double>")).withColumn("v", F.round("v", 9))
