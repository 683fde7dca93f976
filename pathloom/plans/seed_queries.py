"""Task tables, samplers and batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frontier, seeds
from ..sources.catalog import Database
from .registry import query

_CUT = "(VALUES (TIMESTAMP '1998-01-01'), (TIMESTAMP '1999-01-01'), (TIMESTAMP '2000-01-01')) k(ts)"
_WINDOW = "o.o_custkey = c.c_custkey AND o.o_orderdate >= k.ts AND o.o_orderdate < k.ts + INTERVAL 90 DAY"
CHURN = f"""churn AS (SELECT c.c_custkey AS SeedId, k.ts AS ts, CAST(CASE WHEN count(o.o_orderkey) = 0 THEN 1 ELSE 0 END AS DOUBLE) AS label
 FROM customer c CROSS JOIN {_CUT} LEFT JOIN orders o ON {_WINDOW} GROUP BY c.c_custkey, k.ts)"""
SPEND = f"""spend AS (SELECT c.c_custkey AS SeedId, k.ts AS ts, coalesce(sum(o.o_totalprice), 0.0) AS label
 FROM customer c CROSS JOIN {_CUT} LEFT JOIN orders o ON {_WINDOW} GROUP BY c.c_custkey, k.ts)"""
ENGAGED = """engaged AS (SELECT c.c_custkey AS SeedId, k.ts AS ts, CAST(CASE WHEN count(e.event_id) = 0 THEN 0 ELSE 1 END AS DOUBLE) AS label
 FROM customer c CROSS JOIN (VALUES (TIMESTAMP '2024-01-10'), (TIMESTAMP '2024-01-20')) k(ts)
 LEFT JOIN events e ON e.user_id = c.c_custkey AND e.ts >= k.ts AND e.ts < k.ts + INTERVAL 7 DAY GROUP BY c.c_custkey, k.ts)"""
SHOW = "SeedId, CAST(ts AS VARCHAR) AS ts, label"
KEY = "md5(concat_ws('|', 's', CAST(SeedId AS VARCHAR), CAST(ts AS VARCHAR)))"
N_BATCHES = 4


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("string"))


def _churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.churn(Database(spark, sf_dir))


@query(f"WITH {CHURN} SELECT {SHOW} FROM churn")
def churn_task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_churn(spark, sf_dir))


@query(f"WITH {SPEND} SELECT SeedId, CAST(ts AS VARCHAR) AS ts, round(label, 4) AS label FROM spend")
def spend_task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(seeds.spend(Database(spark, sf_dir))).withColumn("label", F.round("label", 4))


@query(f"WITH {ENGAGED} SELECT {SHOW} FROM engaged")
def engagement_task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(seeds.engagement(Database(spark, sf_dir)))


@query(f"WITH {CHURN} SELECT DISTINCT CAST(SeedId AS BIGINT) AS SeedId FROM churn")
def distinct_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _churn(spark, sf_dir).select("SeedId").distinct()


@query(f"WITH {CHURN} SELECT {SHOW}, CAST(ntile({N_BATCHES}) OVER (ORDER BY SeedId, churn.ts) AS INT) AS batch_id FROM churn")
def seed_batches_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(seeds.batches(_churn(spark, sf_dir), N_BATCHES))


@query(f"WITH {CHURN} SELECT batch_id, count(*) AS n_rows, count(DISTINCT SeedId) AS n_seeds FROM (SELECT *, CAST(ntile(7) OVER (ORDER BY SeedId, ts) AS INT) AS batch_id FROM churn) GROUP BY batch_id")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.batch_summary(seeds.batches(_churn(spark, sf_dir), 7))


@query(f"WITH {CHURN} SELECT label, count(*) AS n FROM churn GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _churn(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {SPEND} SELECT CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, CAST(sum(CASE WHEN label <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS nonzeros, CAST(sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, count(*) AS n_rows FROM spend")
def zero_nonzero_nan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.label_counts(seeds.spend(Database(spark, sf_dir)))


def _taken(table: str, where: str, n: str) -> str:
    return f"SELECT * FROM (SELECT * FROM {table} WHERE {where} ORDER BY {KEY}, SeedId, ts LIMIT {n})"


@query(f"WITH {CHURN} SELECT {SHOW} FROM (SELECT * FROM churn WHERE label = 0 UNION ALL {_taken('churn', 'label = 1', '500')}) x")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(seeds.balanced(_churn(spark, sf_dir), 0.0, 1.0, 500))


@query(f"""WITH {CHURN}, q AS (SELECT count(*) FILTER (label = 1) AS a, count(*) AS n FROM churn),
 share AS (SELECT CAST(round_even(700.0 * a / n, 0) AS BIGINT) AS na FROM q),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {KEY}, SeedId, ts) AS k FROM churn)
 SELECT {SHOW} FROM ranked, share WHERE (label = 1 AND k <= na) OR (label = 0 AND k <= 700 - na)""")
def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(seeds.proportional(_churn(spark, sf_dir), 1.0, 0.0, 700))


@query(f"WITH {SPEND} SELECT SeedId, CAST(ts AS VARCHAR) AS ts, round(label, 4) AS label FROM (SELECT * FROM spend WHERE label <> 0 UNION ALL {_taken('spend', 'label = 0', '300')}) x")
def nonzero_plus_zero_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(seeds.nonzero_plus_zero(seeds.spend(Database(spark, sf_dir)), 300)).withColumn("label", F.round("label", 4))


@query(f"WITH {SPEND} SELECT SeedId, CAST(ts AS VARCHAR) AS ts, round(label, 4) AS label FROM ({_taken('spend', 'label = 0', '200')} UNION ALL {_taken('spend', 'label <> 0', '250')}) x")
def zero_nonzero_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(seeds.zero_nonzero(seeds.spend(Database(spark, sf_dir)), 200, 250)).withColumn("label", F.round("label", 4))


@query(f"WITH {CHURN} SELECT {SHOW} FROM ({_taken("churn", "label = 1", "150")} UNION ALL {_taken("churn", "label = 0", "100")}) x")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(seeds.sample_n(_churn(spark, sf_dir), 150, 100))


@query()
def sample_n_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(seeds.sample_n(_churn(spark, sf_dir), 300, 200, replacement=True))


@query("SELECT doc_id, CAST(CAST(toxic AS BOOLEAN) AS TINYINT) AS toxic FROM labels")
def bool_to_int_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", seeds.bool_labels("toxic").alias("toxic"))


@query(f"WITH {CHURN} SELECT CAST(r.r AS INT) AS rank, CAST(ceil(c.n / 8.0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM churn) c, (SELECT unnest(range(8)) AS r) r")
def rank_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.ranks(_churn(spark, sf_dir), 8).groupBy("rank").agg(F.count("*").alias("n"))


@query(f"WITH {CHURN} SELECT SeedId, CAST(ts AS VARCHAR) AS ts, SeedId AS last_id FROM churn")
def seed_frontier0_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(frontier.start(Database(spark, sf_dir), _churn(spark, sf_dir), "customer", timed=False))


@query("""SELECT o.o_orderkey AS SeedId, CAST(k.ts AS VARCHAR) AS ts, o.o_orderkey AS last_id FROM orders o
 CROSS JOIN (VALUES (TIMESTAMP '1998-01-01')) k(ts) WHERE o.o_orderdate < k.ts""")
def seed_frontier0_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, sf_dir)
    own = seeds.cutoffs(db.read("orders").select(F.col("o_orderkey").alias("SeedId")), ["1998-01-01"])
    return shown(frontier.start(db, own, "orders"))
