"""Pruning rules and sampling configurations."""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise(df: DataFrame) -> DataFrame:
    """Numbers coerced, strings trimmed, rows that lack one dropped."""
    typed = df.select(F.expr("try_cast(hop as int)").alias("hop"), F.trim("prefix").alias("prefix"), F.trim("feature").alias("feature"), F.expr("try_cast(cluster_id as int)").alias("cluster_id"))
    return typed.na.drop()


def meta_path(feature: Column) -> Column:
    return F.regexp_replace(feature, "__cnt_.*$", "")


def edge_of(prefix: Column, path: Column) -> Column:
    """What the path adds to the prefix; null if it does not start with it."""
    head = F.concat(prefix, F.lit("__"))
    return F.when(F.startswith(path, head), F.substr(path, F.length(prefix) + 3))


def _good(df: DataFrame, threshold: int) -> DataFrame:
    """(path, good): whether the path or any path that goes on from it reaches the threshold."""
    paths = df.select(meta_path(F.col("feature")).alias("path"), "cluster_id").groupBy("path").agg(F.max("cluster_id").alias("best"))
    hit = paths.where(F.col("best") >= threshold)
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "__"))), lambda k: F.array_join(F.slice(F.split("path", "__"), 1, k), "__"))
    ups = hit.select(F.explode(above).alias("path")).distinct().withColumn("good", F.lit(True))
    return paths.join(ups, "path", "left").select("path", F.coalesce("good", F.lit(False)).alias("good"))


def has_good(df: DataFrame, threshold: int = 1) -> DataFrame:
    return _good(df, threshold)


def decisions(df: DataFrame, threshold: int = 1) -> DataFrame:
    """(hop, prefix, edge, expand, reason) for each extension."""
    named = df.withColumn("path", meta_path(F.col("feature")))
    joined = named.join(_good(df, threshold), "path").withColumn("edge", edge_of(F.col("prefix"), F.col("path")))
    out = joined.groupBy("hop", "prefix", "edge").agg(F.bool_or("good").alias("expand"))
    return out.withColumn("reason", F.when(F.col("expand"), "good extension or descendant").otherwise("no good extension or descendant"))


def prune_rules(df: DataFrame, threshold: int = 1) -> DataFrame:
    return decisions(df, threshold).where("not expand and edge is not null")


def other_way(rel: Column) -> Column:
    """The relation read from its other end: the mark of reverse relations put on, or taken off where it is."""
    bare = F.regexp_replace(rel, "^rev_", "")
    return F.concat(F.when(rel == bare, F.lit("rev_")).otherwise(F.lit("")), bare)


def sampler_edge(prefix: Column, edge: Column) -> list[Column]:
    """(src, rel, dst) in the sampler's direction: from the table reached back to the prefix's last."""
    rel, dst = F.split(edge, "__")[0], F.split(edge, "__")[1]
    return [dst.alias("src"), other_way(rel).alias("rel"), F.element_at(F.split(prefix, "__"), -1).alias("dst")]


def pruned_config(rules: DataFrame, layers: int, fanout: int) -> DataFrame:
    """(src, rel, dst, fanout): 0 at each hop where any prefix's rule cuts the edge type; hops beyond the layers are ignored."""
    cut = rules.select("hop", *sampler_edge(F.col("prefix"), F.col("edge"))).where((F.col("hop") >= 0) & (F.col("hop") < layers))
    by = cut.groupBy("src", "rel", "dst").agg(F.collect_set("hop").alias("hops"))
    return by.select("src", "rel", "dst", F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), lambda h: F.when(F.array_contains("hops", h), 0).otherwise(fanout)).alias("fanout"))


def config_json(config: DataFrame, layers: int, fanout: int) -> str:
    rows = sorted((str((r["src"], r["rel"], r["dst"])), list(r["fanout"])) for r in config.collect())
    return json.dumps({"num_layers": layers, "base_neighbors": fanout, "neighbors": dict(rows)}, indent=2)


def config_text(edges: dict[tuple[str, str, str], list[int]], layers: int) -> str:
    """A configuration as Python text, with zeros for edge types that it does not name."""
    lines = [f"    {k!r}: {v!r}," for k, v in sorted(edges.items())]
    return "\n".join(["num_neighbors = NumNeighbors({", *lines, f"}}, default={[0] * layers!r})", ""])


def read_config(text: str) -> tuple[dict[tuple[str, str, str], list[int]], list[int] | None]:
    """Edge types' fan-outs, and the default, from any of the forms in use; nothing is executed.

    JSON with tuple keys under neighbors, JSON with "src|rel|dst" keys under values, Python text as
    config_text() writes it, or a comma list of numbers, which is a default for all edge types; @path names a file that holds one.
    """
    text = text.strip()
    if text.startswith("@"):  # a path to a file that holds one of the forms
        with open(text[1:], encoding="utf-8") as f:
            return read_config(f.read())
    if re.fullmatch(r"-?\d+(\s*,\s*-?\d+)*", text):
        return {}, [int(x) for x in text.split(",")]
    if text.startswith("{"):
        data = json.loads(text)
        if "neighbors" in data:
            return {ast.literal_eval(k): v for k, v in data["neighbors"].items()}, [data["base_neighbors"]] * data["num_layers"]
        return {tuple(k.split("|")): v for k, v in data.get("values", {}).items()}, data.get("default")
    found = {ast.literal_eval(f"({m[1]})"): ast.literal_eval(m[2]) for m in re.finditer(r"\(([^()\[\]]*)\)\s*:\s*(\[[^\]]*\])", text)}
    default = re.search(r"default\s*=\s*(\[[^\]]*\])(?:\s*\*\s*(\d+))?", text)
    return found, ast.literal_eval(default[1]) * int(default[2] or 1) if default else None


def config_tag(path: str) -> str:
    if not path:
        return "random"
    name = path.rsplit("/", 1)[-1]
    if not name.endswith((".json", ".py")):
        raise ValueError(f"{path}: neither a .json nor a .py configuration")
    return name.rsplit(".", 1)[0]


# --- ranked paths of a search ---------------------------------------------------------------------

RANKED = r"\(path=\[[\d, ]*\], hop=\d+, sort_by=\w+\) rank=\d+ \w+=-?[\d.infa]+"


def parse_ranked(lines: DataFrame, column: str = "value") -> DataFrame:
    """(rank, hop, sort_by, metric, path) from lines of a search log; others are skipped."""
    get = lambda p, k=1: F.regexp_extract(column, p, k)
    ok = lines.where(F.col(column).rlike(RANKED))
    return ok.select(
        get(r"rank=(\d+)").cast("int").alias("rank"), get(r"hop=(\d+)").cast("int").alias("hop"), get(r"sort_by=(\w+)").alias("sort_by"),
        F.expr(f"try_cast(regexp_extract({column}, 'rank=\\\\d+ \\\\w+=(-?[\\\\d.]+)', 1) as double)").alias("metric"), F.from_json(get(r"path=(\[[\d, ]*\])"), "array<int>").alias("path"),
    )


def forward_paths(ranked: DataFrame, relations: DataFrame) -> DataFrame:
    """(rank, hop, position, src, rel, dst): each path's edges from the seed outwards; logs keep the last edge first."""
    steps = ranked.select("rank", "hop", F.posexplode(F.reverse("path")).alias("position", "id"))
    return steps.join(F.broadcast(relations), "id").select("rank", "hop", "position", "src", "rel", "dst")


def merge_top(ranked: DataFrame, relations: DataFrame, layers: int, k: int, fanout: int) -> DataFrame:
    """(src, rel, dst, fanout): the first k paths of at most `layers` hops; an edge gets the fan-out at each hop where one has it."""
    kept = ranked.where(F.col("hop") <= layers).orderBy("rank").limit(k)
    edges = forward_paths(kept, relations)
    by = edges.select(F.col("dst").alias("src"), other_way(F.col("rel")).alias("rel"), F.col("src").alias("dst"), "position").groupBy("src", "rel", "dst").agg(F.collect_set("position").alias("at"))
    return by.select("src", "rel", "dst", F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), lambda h: F.when(F.array_contains("at", h), fanout).otherwise(0)).alias("fanout"))


def parse_decoded(text: str) -> list[tuple[int, int, list[tuple[str, str, str]]]]:
    """(rank, hop, forward edges) of each block of a decoded log; a block without whole edges is skipped."""
    out = []
    for block in re.split(r"\n\s*\n", text):
        head = re.search(r"rank=(\d+).*?hop=(\d+)", block)
        if not head:
            continue
        tail = block.lower().rfind("forward")
        edges = [ast.literal_eval(m) for m in re.findall(r"^\s*\d+\s+(\(.*\))\s*$", block[tail:] if tail >= 0 else block, re.MULTILINE)]
        if len(edges) == int(head[2]) and all(len(e) == 3 for e in edges):
            out.append((int(head[1]), int(head[2]), edges))
    return out
