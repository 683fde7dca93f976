"""Frontier and statistic queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frontier, graph, seeds, stats
from ..sources.catalog import Database
from .registry import query
from .seed_queries import CHURN, ENGAGED, shown

_O = ("customer", "rev_f2p_o_custkey", "orders")
_N = ("customer", "f2p_c_nationkey", "nation")
_L = ("orders", "rev_f2p_l_orderkey", "lineitem")
PATHS: dict[str, graph.Path] = {
    "orders": (_O,),
    "nation": (_N,),
    "region": (_N, ("nation", "f2p_n_regionkey", "region")),
    "sibling": (_N, ("nation", "rev_f2p_c_nationkey", "customer")),
    "supplier": (_N, ("nation", "rev_f2p_s_nationkey", "supplier")),
    "lineitem": (_O, _L),
    "part": (_O, _L, ("lineitem", "f2p_l_partkey", "part")),
    "seller": (_O, _L, ("lineitem", "f2p_l_suppkey", "supplier")),
}
PARENT = {"region": "nation", "sibling": "nation", "supplier": "nation", "lineitem": "orders", "part": "lineitem", "seller": "lineitem"}
#: Frontiers in SQL, each from the one before it; id is what a frontier's rows are told apart by.
F_SQL = {
    "orders": "SELECT s.SeedId, s.ts, o.o_orderkey AS id FROM churn s JOIN orders o ON o.o_custkey = s.SeedId AND o.o_orderdate < s.ts",
    "nation": "SELECT s.SeedId, s.ts, CAST(c.c_nationkey AS BIGINT) AS id FROM churn s JOIN customer c ON c.c_custkey = s.SeedId JOIN nation n ON n.n_nationkey = c.c_nationkey",
    "region": "SELECT DISTINCT f.SeedId, f.ts, CAST(n.n_regionkey AS BIGINT) AS id FROM f_nation f JOIN nation n ON n.n_nationkey = f.id",
    "sibling": "SELECT DISTINCT f.SeedId, f.ts, c.c_custkey AS id FROM f_nation f JOIN customer c ON c.c_nationkey = f.id",
    "supplier": "SELECT DISTINCT f.SeedId, f.ts, s.s_suppkey AS id FROM f_nation f JOIN supplier s ON s.s_nationkey = f.id",
    "lineitem": "SELECT f.SeedId, f.ts, l.rid AS id FROM f_orders f JOIN line l ON l.l_orderkey = f.id AND l.l_shipdate < f.ts",
    "part": "SELECT DISTINCT f.SeedId, f.ts, l.l_partkey AS id FROM f_lineitem f JOIN line l ON l.rid = f.id",
    "seller": "SELECT DISTINCT f.SeedId, f.ts, l.l_suppkey AS id FROM f_lineitem f JOIN line l ON l.rid = f.id",
}
FRONTIERS = "line AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM lineitem), " + ", ".join(f"f_{k} AS ({v})" for k, v in F_SQL.items())
COUNTS = ", ".join(f"c_{k} AS (SELECT SeedId, ts, count(*) AS cnt FROM f_{k} GROUP BY SeedId, ts)" for k in F_SQL)
BASE = f"WITH {CHURN}, {FRONTIERS}, {COUNTS}"
EXTENSIONS = ["region", "sibling", "supplier", "lineitem", "part", "seller"]
LONG = " UNION ALL ".join(
    f"SELECT s.SeedId, s.ts, s.label, CAST({len(PATHS[k]) - 1} AS INT) AS hop, '{graph.path_name(PATHS[k][:-1])}' AS prefix, '{graph.feature_name(PATHS[k])}' AS feature, "
    f"coalesce(c.cnt, 0) AS cnt, coalesce(p.cnt, 0) AS parent FROM churn s LEFT JOIN c_{k} c ON c.SeedId = s.SeedId AND c.ts = s.ts LEFT JOIN c_{PARENT[k]} p ON p.SeedId = s.SeedId AND p.ts = s.ts"
    for k in EXTENSIONS
)
_AT = "SeedId, CAST(ts AS VARCHAR) AS ts"


def _set(spark: SparkSession, sf_dir: str) -> tuple[Database, DataFrame]:
    db = Database(spark, sf_dir)
    return db, seeds.churn(db)


def _frontier(name: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(frontier.along(*_set(spark, sf_dir), PATHS[name]))

    return run


for _k in PATHS:
    if _k not in ("lineitem", "sibling"):
        query(f"WITH {CHURN}, {FRONTIERS} SELECT {_AT}, id AS last_id FROM f_{_k}", f"frontier_h{len(PATHS[_k])}_{_k}")(_frontier(_k))


@query(f"WITH {CHURN}, {FRONTIERS} SELECT f.SeedId, CAST(f.ts AS VARCHAR) AS ts, l.l_partkey, l.l_suppkey, l.l_linenumber FROM f_lineitem f JOIN line l ON l.rid = f.id")
def frontier_h2_lineitem_norowpk(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, own = _set(spark, sf_dir)
    rows = db.keyed("lineitem").select(F.col("_rowid").alias("last_id"), "l_partkey", "l_suppkey", "l_linenumber")
    return shown(frontier.along(db, own, PATHS["lineitem"]).join(rows, "last_id").drop("last_id"))


@query(f"WITH {CHURN}, {FRONTIERS} SELECT {_AT}, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM f_sibling GROUP BY SeedId, ts")
def frontier_h2_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = frontier.packed(*_set(spark, sf_dir), PATHS["sibling"]).groupBy("SeedId", "ts")
    return shown(reached.agg(F.sum(F.size("rows")).alias("n"), F.min(F.array_min("rows")).alias("first_id"), F.max(F.array_max("rows")).alias("last_id")))


@query(f"WITH {ENGAGED} SELECT s.SeedId, CAST(s.ts AS VARCHAR) AS ts, e.event_id AS last_id FROM engaged s JOIN events e ON e.user_id = s.SeedId AND e.ts < s.ts")
def frontier_h1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, sf_dir)
    return shown(frontier.along(db, seeds.engagement(db), (("customer", "rev_f2p_user_id", "events"),)))


def _count(name: str, strategy: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db, own = _set(spark, sf_dir)
        path = PATHS[name]
        child = stats.counts(db, own, path)
        if len(path) > 1:
            both = stats.with_parent(child, stats.counts(db, own, path[:-1]))
            values = stats.strategies(F.coalesce("cnt", F.lit(0)), F.col("parent"))
        else:
            both, values = child, stats.strategies(F.col("cnt"), None)
        value = dict(zip(("cnt", "log_count", "rate", "log_rate"), values, strict=True))[strategy]
        if strategy in ("cnt", "log_count"):
            both = both.where("cnt is not null")
        return shown(both.select("SeedId", "ts", (value if strategy == "cnt" else F.round(value, 9)).alias(strategy)))

    return run


for _k, _p in PATHS.items():
    query(f"{BASE} SELECT {_AT}, cnt FROM c_{_k}", f"count_h{len(_p)}_{_k}")(_count(_k, "cnt"))
    query(f"{BASE} SELECT {_AT}, round(ln(1 + cnt), 9) AS log_count FROM c_{_k}", f"log_count_h{len(_p)}_{_k}")(_count(_k, "log_count"))
for _k, _up in PARENT.items():
    _both = f"(SELECT SeedId, ts, coalesce(c.cnt, 0) AS child, p.cnt AS parent FROM c_{_k} c FULL OUTER JOIN c_{_up} p USING (SeedId, ts))"
    _rate = "CASE WHEN coalesce(parent, 0) = 0 THEN 0.0::DOUBLE ELSE child::DOUBLE / parent END"
    query(f"{BASE} SELECT {_AT}, round({_rate}, 9) AS rate FROM {_both}", f"rate_h{len(PATHS[_k])}_{_k}")(_count(_k, "rate"))
    query(f"{BASE} SELECT {_AT}, round(ln(1 + {_rate}), 9) AS log_rate FROM {_both}", f"log_rate_h{len(PATHS[_k])}_{_k}")(_count(_k, "log_rate"))


@query(f"{BASE} SELECT {_AT}, label, hop, prefix, feature, cnt, parent FROM ({LONG})")
def stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stats.long(*_set(spark, sf_dir), [PATHS[k] for k in EXTENSIONS]))


def _wide(names: list[str], strategy: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = stats.wide(*_set(spark, sf_dir), [PATHS[k] for k in names], strategy)
        return shown(out.select("SeedId", "ts", "label", *[F.round(graph.feature_name(PATHS[k]), 9).alias(f"x_{k}") for k in names]))

    return run


for _names, _tag in ((["orders", "nation"], "h1"), (["region", "supplier", "lineitem"], "h2")):
    _cols = ", ".join(f"round(coalesce(ln(1 + c_{k}.cnt), 0), 9) AS x_{k}" for k in _names)
    _joins = " ".join(f"LEFT JOIN c_{k} ON c_{k}.SeedId = s.SeedId AND c_{k}.ts = s.ts" for k in _names)
    query(f"{BASE} SELECT s.SeedId, CAST(s.ts AS VARCHAR) AS ts, s.label, {_cols} FROM churn s {_joins}", f"wide_export_{_tag}")(_wide(_names, "log_count"))
