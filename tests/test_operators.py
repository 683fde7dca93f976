"""Edge cases of the relational operators."""

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions.special import digamma, t_cdf, t_critical
from pathloom.operators import bounds, frontier, graph, metrics, rules, sampling, scoring, search, seeds, stats
from pathloom.plans import registry, stat_queries
from pathloom.plans import sampling_queries as sq
from pathloom.plans.seed_queries import CHURN
from pathloom.sources import catalog
from pathloom.sources.catalog import SHOP, Database, TableMeta

from .conftest import SF

EDGES = graph.edge_types(SHOP)


class Made(Database):
    """A database of frames given by hand."""

    def __init__(self, spark, frames, tables):
        super().__init__(spark, "", tables)
        self.frames = frames

    def read(self, name):
        return self.frames[name]


@pytest.fixture
def made(spark):
    tables = {"a": TableMeta("a", "id"), "b": TableMeta("b", "id", "at", {"a_id": "a", "up": "b"})}
    a = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    b = spark.sql("""SELECT * FROM VALUES (10L, 1L, NULL, timestamp_ntz'2020-01-01 00:00:00'), (11L, 1L, 10L, timestamp_ntz'2019-12-31 23:59:59.999999'),
        (12L, 1L, 10L, timestamp_ntz'2020-01-01 00:00:00.000001'), (13L, NULL, 11L, timestamp_ntz'2019-01-01'), (14L, 99L, 11L, timestamp_ntz'2019-01-01'), (15L, 2L, 11L, timestamp_ntz'2018-01-01') AS t(id, a_id, up, at)""")
    own = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 1.0)], "SeedId long, label double").withColumn("ts", F.lit("2020-01-01").cast("timestamp_ntz"))
    return Made(spark, {"a": a, "b": b}, tables), own


def ids(df):
    return sorted((r["SeedId"], r["last_id"]) for r in df.collect())


def test_strictly_before_nulls_and_orphans(made):
    db, own = made
    assert ids(frontier.along(db, own, (("a", "rev_f2p_a_id", "b"),))) == [(1, 11), (2, 15)]
    first = frontier.start(db, own, "a", timed=False)
    assert ids(frontier.extend(db, first, ("a", "rev_f2p_a_id", "b"), inclusive=True)) == [(1, 10), (1, 11), (2, 15)]


def test_self_reference_and_forward_time(made):
    db, own = made
    path = (("a", "rev_f2p_a_id", "b"), ("b", "f2p_up", "b"))
    assert ids(frontier.along(db, own, path)) == [(2, 11)]  # 11's own parent is not before the seed
    down = (("a", "rev_f2p_a_id", "b"), ("b", "rev_f2p_up", "b"))
    assert ids(frontier.along(db, own, down)) == [(1, 13), (1, 14), (1, 15)]


def test_forward_to_table_without_key(made):
    db, own = made
    db.tables = {**db.tables, "a": TableMeta("a")}
    with pytest.raises(ValueError, match="no primary key"):
        frontier.extend(db, own.select("SeedId", "ts", F.lit(11).cast("long").alias("last_id")), ("b", "f2p_a_id", "a"))


def test_counts_fill_with_zero_and_rates(made):
    db, own = made
    path = (("a", "rev_f2p_a_id", "b"), ("b", "rev_f2p_up", "b"))
    rows = {r["SeedId"]: (r["cnt"], r["parent"]) for r in stats.long(db, own, [path]).collect()}
    assert rows == {1: (3, 1), 2: (0, 1), 3: (0, 0)}
    wide = stats.wide(db, own, [path], "rate").collect()
    assert sorted(r[graph.feature_name(path)] for r in wide) == [0.0, 0.0, 3.0]


def test_graph_rules():
    a, b = ("customer", "rev_f2p_o_custkey", "orders"), ("orders", "f2p_o_custkey", "customer")
    assert graph.is_backtrack(a, b) and not graph.is_backtrack(b, a) and graph.is_inverse(b, a)
    assert [len([p for p in graph.metapaths(EDGES, "customer", 4) if len(p) == n]) for n in (1, 2, 3, 4)] == [3, 4, 6, 8]
    assert len(graph.metapaths(EDGES, "customer", 3, strict=True)) < len(graph.metapaths(EDGES, "customer", 3))
    assert "hop 2" in graph.pretty(graph.metapaths(EDGES, "customer", 2))
    with pytest.raises(ValueError):
        TableMeta("a__b")


def test_schema_inference():
    assert catalog.infer_task_schema(["u", "t", "y"], ["u"], "t") == ("u", "t", "y")
    for bad in ((["u", "y"], ["u"], None), (["t", "y"], [], "t"), (["u", "t", "y", "z"], ["u"], "t")):
        with pytest.raises(ValueError):
            catalog.infer_task_schema(*bad)


def test_quotas():
    assert seeds.quotas(5, 10, 10) == (2, 3)  # 2.5 rounds to even, 2 of a
    assert seeds.quotas(10, 2, 100) == (0, 10)
    assert seeds.quotas(10, 3, 4) == (3, 4)
    with pytest.raises(ValueError):
        seeds.quotas(10, 3, 4, strict=True)


def test_samplers(spark):
    df = spark.createDataFrame([(i, float(i % 5 == 0), "x") for i in range(100)], "SeedId long, label double, ts string")
    assert seeds.balanced(df, 1.0, 0.0, 20).count() == 40
    assert seeds.balanced(df, 1.0, 0.0, 500).count() == 100
    with pytest.raises(ValueError):
        seeds.balanced(df, 1.0, 0.0, 500, strict=True)
    with pytest.raises(ValueError):
        seeds.sample_n(df, 21, 1)
    assert seeds.sample_n(df, 50, 10, replacement=True).count() == 60
    nan = df.unionByName(spark.createDataFrame([(999, float("nan"), "x")], df.schema))
    assert seeds.nonzero_plus_zero(nan, 5).count() == 26
    assert [r["n"] for r in seeds.ranks(df, 8).groupBy("rank").agg(F.count("*").alias("n")).collect()] == [13] * 8
    sizes = [r["n"] for r in seeds.batches(df, 7, order=("SeedId",)).groupBy("batch_id").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    assert seeds.batches(df.limit(3), 7, order=("SeedId",)).count() == 3


def test_special_functions():
    for d in (0.1, 0.2, 0.4):
        assert math.isclose(t_critical(d, 1), math.tan(math.pi * (0.5 - d)), rel_tol=1e-9)
    assert math.isclose(t_critical(0.1, 31), 1.3094635494946, rel_tol=1e-9)
    assert t_critical(0.1, 0) == 0 and math.isclose(t_cdf(-1.5, 4) + t_cdf(1.5, 4), 1)
    assert math.isclose(digamma(60), digamma(59) + 1 / 59, rel_tol=1e-10)


def test_binning(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (float("nan"),), (None,)], "x double").withColumn("e", F.array(*map(F.lit, (0.0, 1.0, 2.0, 9.0))))
    got = [r[0] for r in df.where("x is not null and not isnan(x)").select(scoring.bin_of(F.col("x"), F.col("e"))).collect()]
    assert got == np.digitize([1.0, 2.0, 2.5], [1.0, 2.0], right=True).tolist()
    assert scoring.quantile_edges(df.where("isnan(x)"), "x", 4).first()["edges"] == [0.0, 1.0]


def test_information(spark):
    rows = [(1, 1, "p", "f", float(i % 2), i % 2, i % 2) for i in range(20)] + [(1, 1, "p", "g", float(i % 2), 3, 3) for i in range(20)] + [(1, 1, "p", "h", 1.0, i % 2, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "batch_id int, hop int, prefix string, feature string, label double, v int, cnt int")
    out = {r["feature"]: r for r in scoring.summary(scoring.joint(df.withColumnRenamed("v", "parent")), {"x": F.col("parent")}).collect()}
    assert {r["feature"]: round(r["mi"], 9) for r in scoring.plugin_mi(df, "v").collect()}["f"] == round(math.log(2), 9)
    assert math.isclose(out["f"]["npmi"], 1) and abs(out["g"]["npmi"]) < 1e-12 and out["h"]["npmi"] == 0
    assert out["f"]["n_nonzero"] == 10 <= out["f"]["n_samples"] and out["f"]["cost"] == 1
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    assert scoring.knn_mi(y + 0.01 * rng.standard_normal(600), y, True) > 0.6
    assert scoring.knn_mi(rng.standard_normal(600), y, True) < 0.05
    x = rng.standard_normal(600)
    assert scoring.knn_mi(x, x + 0.1 * rng.standard_normal(600), False) > 1.5
    assert scoring.knn_mi(np.ones(9), y[:9], True) == 0


def test_equal_rows_stay_apart(spark, tmp_path):
    """Rows of a table without a key are told apart by their place, in files and in frames."""
    rows = [(1, 7, 5), (1, 7, 5), (1, 8, 5), (2, 7, 5), (2, 7, 5), (2, 7, 5)]
    line = spark.createDataFrame(rows, "o long, p long, q long").withColumn("at", F.lit("2019-01-01").cast("timestamp_ntz"))
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    own = parent.select(F.col("id").alias("SeedId"), F.lit(1.0).alias("label"), F.lit("2020-01-01").cast("timestamp_ntz").alias("ts"))
    meta = {"a": TableMeta("a", "id"), "c": TableMeta("c", "id"), "l": TableMeta("l", None, "at", {"o": "a", "p": "c"})}
    for frame, folder in ((parent, "a"), (spark.createDataFrame([(7,), (8,)], "id long"), "c"), (line.repartition(2, "q", "o"), "l")):
        frame.write.parquet(str(tmp_path / f"{folder}.parquet"))
    line.coalesce(1).write.mode("append").parquet(str(tmp_path / "l.parquet"))  # so two files or more, and each row twice
    files = Database(spark, str(tmp_path), meta)
    frames = Database(spark, str(tmp_path), meta)
    frames.add(meta["l"], line)
    path = (("a", "rev_f2p_o", "l"), ("l", "f2p_p", "c"))
    for db, times in ((files, 2), (frames, 1)):
        assert db.keyed("l").select("_rowid").distinct().count() == 6 * times
        assert {r["SeedId"]: (r["cnt"], r["parent"]) for r in stats.long(db, own, [path]).collect()} == {1: (2, 3 * times), 2: (1, 3 * times), 3: (0, 0)}
        reached = frontier.along(db, own, path[:1])
        assert reached.count() == reached.distinct().count() == 6 * times
        assert sampling.nodes(db, ["a", "l"]).groupBy("type").count().collect().__len__() == 2
        assert sampling.edges(db, ["a", "c", "l"]).count() == 24 * times
        seeds_ = own.withColumn("type", F.lit("a"))
        near = sampling.bfs(seeds_, sampling.edges(db, ["a", "c", "l"]), 2).groupBy("SeedId", "hop").count().collect()
        assert {(r["SeedId"], r["hop"]): r["count"] for r in near} == {(1, 0): 1, (1, 1): 3 * times, (1, 2): 2, (2, 0): 1, (2, 1): 3 * times, (2, 2): 1, (3, 0): 1}
    assert files.foreign_keys("l") == [("o", "a"), ("p", "c")] and files.columns("a") == [("id", "bigint")]
    assert catalog.read_schema_cache(catalog.schema_cache(line)) == line.schema


def test_quantiles_by_slices(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, 700), np.zeros(300), rng.exponential(50, 200)]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    shares = [0, 0.02, 0.25, 1 / 3, 0.5, 0.9, 0.98, 1]
    assert np.allclose(seeds.quantiles(df, "x", shares), np.quantile(x, shares))
    assert seeds.quantiles(df.where("x > 1e9"), "x", shares) is None
    assert metrics.clamp(df.where("x = 0"), "x", df.where("x > 1e9"), "x").count() == 300


def test_samples_by_kind(spark):
    df = spark.createDataFrame([(i, float(i % 5 == 0), "x") for i in range(100)], "SeedId long, label double, ts string")
    count = lambda kind, n: {r["label"]: r["n"] for r in seeds.sample_for(df, kind, n).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert count("binary", 30) == {1.0: 20, 0.0: 30} and count("share", 50) == {1.0: 10, 0.0: 40}
    assert count("amount", 7) == {1.0: 20, 0.0: 7} and count("capped", 9) == {1.0: 9, 0.0: 9} and count("all", 1) == {1.0: 20, 0.0: 80}
    with pytest.raises(ValueError):
        seeds.sample_for(df, "other", 1)
    with pytest.raises(ValueError):
        seeds.sample_n(df, 5, 81)


def test_edge_of_any_columns(spark):
    df = spark.createDataFrame([("c__r__o", "c__r__o__s__l"), ("c__r", "x__s")], "a string, b string")
    assert [r[0] for r in df.select(rules.edge_of(F.col("a"), F.col("b"))).collect()] == ["s__l", None]
    ways = spark.createDataFrame([("rev_f2p_x",), ("f2p_x",)], "r string").select(rules.other_way(F.col("r")))
    assert [r[0] for r in ways.collect()] == ["f2p_x", "rev_f2p_x"]


def test_config_by_path(tmp_path):
    (tmp_path / "c.json").write_text('{"default": [1, 2], "values": {"a|x|b": [3, 4]}}')
    assert rules.read_config(f"@{tmp_path / 'c.json'}") == ({("a", "x", "b"): [3, 4]}, [1, 2])


def test_metric_choice_and_stop():
    assert metrics.tune_metric("regression") == ("mae", False)
    assert metrics.best_epoch([0.5, 0.7, 0.6, float("nan"), 0.65, 0.9], True, 3) == (1, 4)
    assert metrics.best_epoch([3.0, 2.0, 2.0], False, 5) == (1, 2)
    with pytest.raises(ValueError):
        metrics.tune_metric("other")


def test_knn_mi_against_plain_counts():
    """Ross' estimator, by its definition over all pairs."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 150)
    x = rng.standard_normal(150) + y
    got = scoring.knn_mi(x, y, True)
    noise = np.random.default_rng(0)
    z = x / x.std() + 1e-10 * max(1.0, np.abs(x / x.std()).mean()) * noise.standard_normal(150)
    total = 0.0
    for i in range(150):
        same = np.sort([abs(z[i] - z[j]) for j in range(150) if j != i and y[j] == y[i]])
        reach = same[2]
        m = sum(abs(z[i] - z[j]) < reach for j in range(150))
        total += digamma(150) + digamma(3) - digamma(int((y == y[i]).sum())) - digamma(m)
    assert abs(got - max(0.0, total / 150)) < 1e-9


def test_bounds(spark):
    rows = [(1, "p", "a", "log_rate", 1, 0.5, 10, 5), (1, "p", "a", "log_count", 1, 0.25, 10, 5), (1, "p", "dead", "log_rate", 1, 0.0, 10, 0)]
    scores = spark.createDataFrame(rows, "hop int, prefix string, feature string, aggregate_type string, batch_id int, score double, n_samples long, n_nonzero long")
    wide = {r["feature"]: r for r in bounds.wide(bounds.lcb_summary(scores, 1)).collect()}
    assert wide["a"]["lcb_tr_log_rate"] == 0.5 and wide["a"]["cov_cv"] == 0 and wide["dead"]["lcb_tr_log_count"] == 0
    assert bounds.dead(bounds.wide(bounds.lcb_summary(scores, 1))).count() == 1
    ties = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (2, 5.0)], "hop int, x double").withColumn("p", bounds.pct_rank("x"))
    assert sorted(r["p"] for r in ties.collect()) == [0.5, 0.5, 1.0, 1.0]


def test_mixture():
    rng = np.random.default_rng(1)
    q = np.r_[rng.normal(0, 0.1, 30), rng.normal(2, 0.1, 10)]
    assert bounds.mixture(q).tolist() == [0] * 30 + [1] * 10
    assert bounds.mixture(np.ones(5)).tolist() == [1] * 5 and bounds.mixture(np.array([3.0])).tolist() == [1]


def test_rules(spark):
    rows = [("1", " c__r__o ", "c__r__o__s__l__cnt_l_h2", "0"), ("2", "c__r__o__s__l", "c__r__o__s__l__t__p__cnt_p_h3", "1"), ("1", "c__n__n", "c__n__n__s__l__cnt_l_h2", "0"), ("9", "c__n__n", "c__n__n__u__z__cnt_z_h2", "0"), ("x", "a", "b", "0"), ("1", "c__n__n", "other__cnt_x_h2", "0")]
    df = rules.normalise(spark.createDataFrame(rows, "hop string, prefix string, feature string, cluster_id string"))
    assert df.count() == 5
    found = {(r["hop"], r["prefix"], r["edge"]): r["expand"] for r in rules.decisions(df).collect()}
    assert found[1, "c__r__o", "s__l"] is True  # a good descendant
    assert found[1, "c__n__n", "s__l"] is False and found[1, "c__n__n", None] is False
    cut = rules.prune_rules(df)
    assert cut.where("edge is null").count() == 0
    config = rules.pruned_config(cut, 3, 64)
    assert [tuple(r) for r in config.collect()] == [("l", "rev_s", "n", [64, 0, 64])]
    text = rules.config_json(config, 3, 64)
    assert json.loads(text)["neighbors"] == {"('l', 'rev_s', 'n')": [64, 0, 64]}
    assert rules.read_config(text) == ({("l", "rev_s", "n"): [64, 0, 64]}, [64, 64, 64])


def test_config_forms():
    edges = {("b", "rev_x", "a"): [4, 0], ("a", "x", "b"): [0, 4]}
    assert rules.read_config(rules.config_text(edges, 2)) == (edges, [0, 0])
    assert rules.read_config('{"default": [1, 2], "values": {"a|x|b": [3, 4]}}') == ({("a", "x", "b"): [3, 4]}, [1, 2])
    assert rules.read_config("8, 4") == ({}, [8, 4])
    assert rules.config_tag("") == "random" and rules.config_tag("/x/t_3hops.py") == "t_3hops"
    with pytest.raises(ValueError):
        rules.config_tag("x.txt")



def test_decoded_blocks():
    good = "rank=2 auc=0.5 hop=2 sort_by=auc path=[3, 1]\nlogged order\n    3 ('o', 's', 'l')\n    1 ('c', 'r', 'o')\nforward order\n    1 ('c', 'r', 'o')\n    3 ('o', 's', 'l')\n"
    assert rules.parse_decoded(good + "\nrank=3 hop=2\nforward order\n    1 ('c', 'r', 'o')\n\nnoise\n") == [(2, 2, [("c", "r", "o"), ("o", "s", "l")])]


def test_tokens(spark):
    reached = spark.createDataFrame([(1, "s", 1, 0)] + [(1, "o", 10 + k, 1) for k in range(9)] + [(2, "s", 2, 0), (2, "o", 50, 1), (3, "s", 3, 0)], "SeedId long, type string, id long, hop int").withColumn("ts", F.lit("2020-01-01").cast("timestamp_ntz"))
    times = spark.createDataFrame([("o", 50)], "type string, id long").withColumn("time", F.lit("2021-01-01").cast("timestamp_ntz"))
    found = sampling.tokens(reached, times, 5, 2)
    rows = {}
    for r in found.orderBy("SeedId", "pos").collect():
        rows.setdefault(r["SeedId"], []).append((r["pos"], r["type"], r["hop"], r["days"]))
    assert [len(v) for v in rows.values()] == [5, 5, 5] and [p for p, *_ in rows[1]] == [0, 1, 2, 3, 4]
    assert {x[1] for x in rows[3][1:]} == {"#pad"} and rows[3][1][2:] == (3, -1.0)
    assert rows[2][1][3] == 0.0  # later than the seed: held at zero
    edges = spark.createDataFrame([("s", 2, "o", 50)], "src_type string, src long, dst_type string, dst long")
    assert [(r["src_pos"], r["dst_pos"]) for r in sampling.induced(found, edges).collect()] == [(0, 4)]  # the last place counts


def test_token_store(spark, tmp_path):
    from pathloom.sources import tokens

    at = F.lit("2020-01-01").cast("timestamp_ntz")
    found = spark.createDataFrame([(1, 0, "s", 1, 0, 0.0), (1, 1, "o", 7, 1, 2.5), (2, 0, "s", 2, 0, 0.0), (2, 1, "#pad", 0, 2, -1.0)], "SeedId long, pos int, type string, id long, hop int, days double").withColumn("ts", at)
    edges = spark.createDataFrame([(1, 0, 1)], "SeedId long, src_pos int, dst_pos int").withColumn("ts", at)
    tokens.pack(found, edges, {"o": 0, "s": 1}).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {r["SeedId"]: (r["types"], r["edge_src"], r["edge_dst"]) for r in back.collect()} == {1: ([1, 0], [0], [1]), 2: ([1, 2], [], [])}
    rows = {(r["SeedId"], r["pos"]): (r["type_id"], r["id"], r["hop"], r["days"]) for r in tokens.unpack(back).collect()}
    assert rows[1, 1] == (0, 7, 1, 2.5) and rows[2, 1] == (2, 0, 2, -1.0)
    places = spark.createDataFrame([(1, 0), (2, 1)], "SeedId long, b int").withColumn("ts", at)
    assert sorted(r["flat"] for r in tokens.flat_positions(found, places, 2).collect()) == [0, 1, 2, 3]


def test_quota_is_whole(spark):
    sizes = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (1, 3, 1), (2, 1, 7)], "SeedId long, hop int, n long").withColumn("ts", F.lit("x"))
    out = {(r["SeedId"], r["hop"]): r["quota"] for r in sampling.quota(sizes, 4).collect()}
    assert out == {(1, 1): 2, (1, 2): 2, (1, 3): 0, (2, 1): 4}


def _plain_bfs(seeds_, links, hops):
    """(SeedId, ts, type, id, hop) by walking from each seed."""
    out = set()
    for s, ts, kind in seeds_:
        seen = level = {(kind, s)}
        out |= {(s, ts, kind, s, 0)}
        for hop in range(1, hops + 1):
            level = {b for a, b in links if a in level} - seen
            seen = seen | level
            out |= {(s, ts, *x, hop) for x in level}
    return out


@pytest.mark.parametrize("hops", [0, 1, 2, 3])
def test_shared_walks(spark, monkeypatch, hops):
    monkeypatch.setattr(sampling, "SHARED", 3)
    rng = np.random.default_rng(5)
    names = [("ab"[k % 2], k) for k in range(24)]
    links = [(names[i], names[j]) for i, j in rng.integers(0, 24, (36, 2))] + [(names[k], names[20]) for k in range(9)] + [(names[20], names[k]) for k in range(9)]
    links += [(names[9], names[k]) for k in range(7)] + links[:5]
    seeds_ = [(k, t, n) for n, k in names for t in ("x", "y") if k % 3 or t == "x"]
    graph_ = spark.createDataFrame([(*a, "r", *b) for a, b in links], "src_type string, src long, rel string, dst_type string, dst long")
    own = spark.createDataFrame(seeds_, "SeedId long, ts string, type string")
    want = _plain_bfs(seeds_, links, hops)
    got = [(r["SeedId"], r["ts"], r["type"], r["id"], r["hop"]) for r in sampling.bfs(own, graph_, hops).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if hops:
        counted = [tuple(r) for r in sampling.bfs_buckets(own, graph_, hops).collect()]
        assert sorted(counted) == sorted(tuple(r) for r in sampling.buckets(sampling.bfs(own, graph_, hops)).collect())


def test_walks_send_no_row_for_each_seed_and_node(spark):
    """400 seeds around one node of 400: buckets, and the rows that are shuffled, stay linear."""
    links = [("a", k, "r", "h", 0) for k in range(400)] + [("h", 0, "r", "a", k) for k in range(400)]
    graph_ = spark.createDataFrame(links, "src_type string, src long, rel string, dst_type string, dst long")
    own = spark.range(400).select(F.col("id").alias("SeedId"), F.lit("x").alias("ts"), F.lit("a").alias("type"))
    members, seen = sampling._walked(own, graph_, 2)
    assert members.count() == 400 and seen.count() == 401
    assert {(r["hop"], r["n"]) for r in sampling.bfs_buckets(own, graph_, 2).collect()} == {(1, 1), (2, 399)}


def test_two_hop_follows_all(spark, monkeypatch):
    """A node with more neighbours than any cap gives them all; the SQL of the query has no cap."""
    db = Database(spark, SF)
    own, graph_, times = sq._seeds(db, "supplier"), *sq._graph(db, sq.PLACES)
    whole = {tuple(r) for r in sampling.two_hop(own, graph_, times, None, None).collect()}
    assert whole == {tuple(r) for r in sampling.two_hop(own, graph_, times, 10**6, 10**6).collect()}
    near = spark.createDataFrame([("supplier", k, "r", "nation", 0) for k in range(3)] + [("nation", 0, "r", "customer", k) for k in range(1500)], "src_type string, src long, rel string, dst_type string, dst long")
    nodes_ = spark.createDataFrame([("nation", 0)] + [("customer", k) for k in range(1500)], "type string, id long").withColumn("time", F.lit(None).cast("timestamp_ntz"))
    seeds_ = spark.range(3).select(F.col("id").alias("SeedId"), F.lit("2000-01-01").cast("timestamp_ntz").alias("ts"), F.lit("supplier").alias("type"))
    monkeypatch.setattr(sq, "_seeds", lambda db, table: seeds_)
    monkeypatch.setattr(sq, "_graph", lambda db, tables: (near, nodes_))
    assert sq.two_hop_with_caps(spark, SF).groupBy("hop").count().orderBy("hop").collect() == [(1, 3), (2, 4500)]


def test_siblings_are_aggregated_once(spark):
    """Seeds on one parent get its children's aggregates, as a row for each seed and sibling would give them."""
    tables = {"p": TableMeta("p", "id"), "c": TableMeta("c", "id", None, {"up": "p"})}
    frames = {"p": spark.range(2), "c": spark.range(600).select("id", F.when(F.col("id") < 599, 0).otherwise(1).cast("long").alias("up"))}
    own = spark.range(600).select(F.col("id").alias("SeedId"), F.lit("2020-01-01").cast("timestamp_ntz").alias("ts"))
    path = (("c", "f2p_up", "p"), ("p", "rev_f2p_up", "c"))
    out = stats.ends(Made(spark, frames, tables), own, path, F.count("*").alias("n"), F.min("last_id").alias("low"), F.max("last_id").alias("high"))
    got = {r["SeedId"]: (r["n"], r["low"], r["high"]) for r in out.collect()}
    assert got == {k: (599, 0, 598) for k in range(599)} | {599: (1, 599, 599)}
    plain = frontier.along(Made(spark, frames, tables), own, path).groupBy("SeedId").agg(F.count("*").alias("n"), F.min("last_id").alias("low"), F.max("last_id").alias("high"))
    assert got == {r["SeedId"]: (r["n"], r["low"], r["high"]) for r in plain.collect()}


def test_sibling_frontier_is_distinct_for_each_seed(spark, tmp_path):
    """Customers and nations that repeat, null keys, a customer in two nations: each seed's frontier has each row once, as in the SQL."""
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute("INSERT INTO nation SELECT * FROM nation WHERE n_nationkey < 3")
    con.execute("INSERT INTO customer SELECT * FROM customer WHERE c_custkey < 10 UNION ALL SELECT * REPLACE ((c_nationkey + 1) % 25 AS c_nationkey) FROM customer WHERE c_custkey < 5")
    con.execute("INSERT INTO customer SELECT * REPLACE (NULL AS c_custkey) FROM customer WHERE c_custkey < 3 UNION ALL SELECT * REPLACE (NULL AS c_nationkey, c_custkey + 1000 AS c_custkey) FROM customer WHERE c_custkey < 3")
    for t in ("nation", "customer", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()["frontier_h2_sibling"]).fetchall()
    got = registry.queries()["frontier_h2_sibling"](spark, str(tmp_path)).select("SeedId", "ts", "n", "first_id", "last_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    db = Database(spark, str(tmp_path))
    rows = frontier.whole(db, seeds.churn(db), stat_queries.PATHS["sibling"]).withColumn("ts", F.col("ts").cast("string"))
    listed = con.execute(f"WITH {CHURN}, {stat_queries.FRONTIERS} SELECT SeedId, CAST(ts AS VARCHAR), id FROM f_sibling").fetchall()
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, listed))


def test_whole_frontier_of_other_paths(made):
    """Paths with times, or that branch before the end, have the same rows as along()."""
    db, own = made
    for path in ((("a", "rev_f2p_a_id", "b"),), (("a", "rev_f2p_a_id", "b"), ("b", "f2p_up", "b")), (("a", "rev_f2p_a_id", "b"), ("b", "rev_f2p_up", "b"))):
        assert ids(frontier.whole(db, own.unionByName(own), path)) == ids(frontier.along(db, own, path))


def _loss(spark, pos, neg):
    df = spark.createDataFrame([(k, 1.0, x) for k, x in enumerate(pos)] + [(-k - 1, 0.0, x) for k, x in enumerate(neg)], "bag_id long, y double, score double")
    return tuple(search.pairwise_loss(df).first())


@pytest.mark.parametrize("width", [0.5, 30.0, 3000.0, 1e7])
def test_pairwise_loss_against_pairs(spark, width):
    rng = np.random.default_rng(3)
    pos, neg = np.round(rng.normal(0, width, 300), 6), np.round(rng.normal(-width / 3, width, 200), 6)
    neg[:20] = pos[:20]
    loss, n = _loss(spark, pos.tolist(), neg.tolist())
    gap = neg[None, :] - pos[:, None]
    with np.errstate(over="ignore"):
        want = math.fsum((1 / (1 + np.exp(-gap))).ravel())
    assert n == 60_000 and loss == pytest.approx(want, rel=1e-13)


def test_pairwise_loss_edges(spark):
    far = _loss(spark, [100.0, 2000.0], [0.0])
    assert far == (pytest.approx(math.exp(-100), rel=1e-12), 2)
    assert _loss(spark, [1e300, 1e18], [1e300, -1e300, 1e18]) == (pytest.approx(0.5 + 1 + 0.5, rel=1e-13), 6)
    assert _loss(spark, [1.0], []) == (0.0, 0)
    assert _loss(spark, [None, 0.0], [0.0, None]) == (pytest.approx(0.5, rel=1e-13), 4)
    inf = float("inf")
    assert _loss(spark, [inf, 0.0], [0.0, -inf]) == (pytest.approx(0.5, rel=1e-13), 4) and _loss(spark, [-inf, 0.0], [inf]) == (2.0, 2)
    assert math.isnan(_loss(spark, [inf], [inf])[0]) and math.isnan(_loss(spark, [float("nan")], [0.0])[0])


def test_pairwise_loss_makes_no_pairs(spark):
    """10^10 pairs, which no pairwise evaluation ends in the time of a test."""
    df = spark.range(200_000).select(F.col("id").alias("bag_id"), (F.col("id") % 2).cast("double").alias("y"), (F.floor(F.col("id") / 2) / 7).alias("score"))
    loss, n = search.pairwise_loss(df).first()
    assert n == 10**10 and loss == pytest.approx(10**10 / 2, rel=1e-12)  # alike on both sides: sigmoids of x and -x add up to 1


def test_beam_judges_only_to_choose(spark, monkeypatch):
    """Losses decide between relations; where all are taken none is computed."""
    edges = spark.createDataFrame([(1, "a", 3), (2, "b", 3), (1, "b", 4), (2, "a", 4)], "src long, rel string, dst long")
    bags = spark.createDataFrame([(1, 1, 1.0, 1.0), (2, 2, 1.0, 0.0)], "bag_id long, id long, alpha double, y double")
    feats = spark.createDataFrame([(k, [float(k)]) for k in range(1, 5)], "id long, x array<double>")
    weights = feats.select("id", F.lit(0.5).alias("w"))
    judged, plain = [], search.pairwise_loss
    monkeypatch.setattr(search, "pairwise_loss", lambda scores: judged.append(1) or plain(scores))
    both = search.beam_over_tables(bags, edges, feats, weights, [1.0], 1, 2, 2).collect()
    assert {r["path"] for r in both} == {"a", "b"} and not judged
    best = search.beam_over_tables(bags, edges, feats, weights, [1.0], 1, 1, 2).collect()
    assert len(best) == 1 and len(judged) == 2 and best[0] in both


def test_search():
    assert search.beam_search([0, 1, 2], lambda p: [3, 4], lambda p: len(p) + p[0] / 10 if p[0] != 4 else math.nan, 2, 2, 2)[0][0] == (3, 3, 1)
    x, bag, y = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.2]]), np.array([0, 1, 2]), np.array([1, 0, 1])
    theta, loss = search.fit_theta(x, bag, y, np.ones(3))
    assert theta[0] > theta[1] >= 0 and loss < 1


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, score double")
    assert metrics.roc_auc(df).first()["auc"] == 0.875
    assert metrics.roc_auc(df.where("y = 1")).first()["auc"] is None
    x = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in x.select(metrics.nan_to_num(F.col("x"))).collect()] == [0.0, 1e6, -1e6, 0.0, 2.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2020", 0.5, 3)], "SeedId long, ts string, label double, p__cnt_o_h1 long")
    catalog.write_csv(df, str(tmp_path / "out"))
    back = catalog.read_csv_columns(spark, str(tmp_path / "out"), df.schema.simpleString()[7:-1].replace(":", " "), ["label", *catalog.count_columns(df)])
    assert [tuple(r) for r in back.collect()] == [(0.5, 3)]
    (tmp_path / "a.db").write_bytes(b"x" * 10)
    (tmp_path / "b.duckdb").write_bytes(b"x" * 20)
    assert catalog.largest_file(spark, str(tmp_path)).endswith("b.duckdb")
    (tmp_path / "log.txt").write_text("one\ntwo rank=1\n")
    assert catalog.read_lines(spark, str(tmp_path / "log.txt"), r"rank=\d").count() == 1
    assert catalog.label_column(["a", "WillGetBadge"]) == "WillGetBadge"


def test_stream(spark, tmp_path):
    from pathloom.streaming import counts

    from .conftest import SF

    spark.read.parquet(f"{SF}/events.parquet").repartition(2).write.parquet(str(tmp_path / "in"))
    q = counts.windowed(counts.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("stream_counts").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = spark.table("stream_counts").agg(F.sum("n")).first()[0]
    finally:
        q.stop()
    assert got == spark.read.parquet(f"{SF}/events.parquet").count()
