"""Schema graph queries. The SQL lists the foreign keys once more, as values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.catalog import SHOP
from .registry import query

EDGES = graph.edge_types(SHOP)
_FK = """fk(child, col, parent) AS (VALUES ('nation','n_regionkey','region'),('customer','c_nationkey','nation'),
 ('supplier','s_nationkey','nation'),('orders','o_custkey','customer'),('lineitem','l_orderkey','orders'),
 ('lineitem','l_partkey','part'),('lineitem','l_suppkey','supplier'),('events','user_id','customer'))"""
E_SQL = f"""{_FK}, edges AS (SELECT child AS src, 'f2p_' || col AS rel, parent AS dst FROM fk
 UNION ALL SELECT parent, 'rev_f2p_' || col, child FROM fk)"""
_WALK = f"""WITH RECURSIVE {E_SQL}, walk AS (
 SELECT src || '__' || rel || '__' || dst AS path, 1 AS hop, src AS last_src, rel AS last_rel, dst AS last_dst FROM edges WHERE src = 'customer'
 UNION ALL
 SELECT w.path || '__' || e.rel || '__' || e.dst, w.hop + 1, e.src, e.rel, e.dst FROM walk w JOIN edges e ON e.src = w.last_dst
 WHERE w.hop < {{n}} AND NOT (w.last_rel LIKE 'rev\\_%' ESCAPE '\\' AND replace(w.last_rel, 'rev_', '') = e.rel AND w.last_src = e.dst))"""


@query(f"WITH {E_SQL} SELECT * FROM edges")
def schema_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_frame(spark, EDGES)


@query(f"WITH {E_SQL} SELECT src AS node_type, count(*) AS n_edges, string_agg(rel || '>' || dst, ',' ORDER BY rel, dst) AS leads_to FROM edges GROUP BY src")
def schema_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.struct("rel", "dst")
    by = graph.edges_frame(spark, EDGES).groupBy(F.col("src").alias("node_type")).agg(F.count("*").alias("n_edges"), F.array_sort(F.collect_list(step)).alias("s"))
    return by.select("node_type", "n_edges", F.array_join(F.transform("s", lambda x: F.concat_ws(">", x["rel"], x["dst"])), ",").alias("leads_to"))


@query(f"WITH {E_SQL} SELECT node_type, CAST(row_number() OVER (ORDER BY node_type) - 1 AS INT) AS type_id FROM (SELECT DISTINCT src AS node_type FROM edges UNION SELECT DISTINCT dst FROM edges)")
def schema_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(graph.vocabulary(EDGES).items()), "node_type string, type_id int")


@query(f"WITH {E_SQL} SELECT rel, replace(rel, 'rev_', '') AS base_rel, rel LIKE 'rev\\_%' ESCAPE '\\' AS is_reverse FROM edges")
def base_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e[1], graph.base(e[1]), graph.is_reverse(e[1])) for e in EDGES], "rel string, base_rel string, is_reverse boolean")


def _paths(hops: int):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph.paths_frame(graph.edges_frame(spark, EDGES), "customer", hops).select("path", "hop").where(F.col("hop") == hops)

    return run


for _n in (1, 2, 3, 4):
    query(_WALK.format(n=_n) + f" SELECT path, hop FROM walk WHERE hop = {_n}", f"metapaths_h{_n}")(_paths(_n))


@query(_WALK.format(n=3) + " SELECT path, hop FROM walk")
def metapaths_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(graph.path_name(p), len(p)) for p in graph.metapaths(EDGES, "customer", 3)], "path string, hop int")


@query(_WALK.format(n=3) + " SELECT w.path AS prefix, w.hop, e.rel, e.dst FROM walk w JOIN edges e ON e.src = w.last_dst WHERE w.hop < 3 AND NOT (w.last_rel LIKE 'rev\\_%' ESCAPE '\\' AND replace(w.last_rel, 'rev_', '') = e.rel AND w.last_src = e.dst)")
def candidate_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = graph.by_hop(graph.metapaths(EDGES, "customer", 2), graph.adjacency(EDGES))
    return spark.createDataFrame([(graph.path_name(p), hop, e[1], e[2]) for hop, items in groups.items() for p, found in items for e in found], "prefix string, hop int, rel string, dst string")


@query(f"WITH {E_SQL} SELECT a.src || '__' || a.rel || '__' || a.dst || '__' || b.rel || '__' || b.dst AS path, a.rel LIKE 'rev\\_%' ESCAPE '\\' AS trivial FROM edges a JOIN edges b ON b.src = a.dst AND b.dst = a.src AND replace(a.rel, 'rev_', '') = replace(b.rel, 'rev_', '') AND a.rel <> b.rel")
def inverse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(graph.path_name((a, b)), graph.is_backtrack(a, b)) for a in EDGES for b in EDGES if a[2] == b[0] and graph.is_inverse(a, b)]
    return spark.createDataFrame(pairs, "path string, trivial boolean")


@query(_WALK.format(n=2) + " SELECT path || '__cnt_' || last_dst || '_h' || hop AS feature FROM walk")
def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(graph.feature_name(p),) for p in graph.metapaths(EDGES, "customer", 2)], "feature string")


@query(_WALK.format(n=2) + " SELECT DISTINCT w.path AS prefix, replace(e.rel, 'f2p_', '') AS fk FROM walk w JOIN edges e ON e.src = w.last_dst WHERE e.rel NOT LIKE 'rev\\_%' ESCAPE '\\' AND NOT (w.last_rel LIKE 'rev\\_%' ESCAPE '\\' AND replace(w.last_rel, 'rev_', '') = e.rel AND w.last_src = e.dst)")
def required_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = graph.adjacency(EDGES)
    return spark.createDataFrame([(graph.path_name(p), c) for p in graph.metapaths(EDGES, "customer", 2) for c in graph.forward_columns(p, steps)], "prefix string, fk string")
