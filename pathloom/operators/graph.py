"""The schema graph: edge types, metapaths and their names. All of it is as small as the schema."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import TableMeta

Edge = tuple[str, str, str]
Path = tuple[Edge, ...]


def edge_types(tables: dict[str, TableMeta]) -> list[Edge]:
    """Each foreign key in both directions: child to parent, and rev_ for parent to child."""
    out = []
    for t in tables.values():
        for column, parent in t.fks.items():
            out += [(t.name, f"f2p_{column}", parent), (parent, f"rev_f2p_{column}", t.name)]
    return sorted(out)


def adjacency(edges: Iterable[Edge]) -> dict[str, list[Edge]]:
    out: dict[str, list[Edge]] = {}
    for e in edges:
        out.setdefault(e[0], []).append(e)
    return out


def vocabulary(edges: Iterable[Edge]) -> dict[str, int]:
    return {t: i for i, t in enumerate(sorted({x for e in edges for x in (e[0], e[2])}))}


def is_reverse(rel: str) -> bool:
    return rel.startswith("rev_")


def base(rel: str) -> str:
    return re.sub("^rev_", "", rel)


def fk_column(rel: str) -> str:
    return re.sub("^(rev_)?f2p_", "", rel)


def is_inverse(a: Edge, b: Edge) -> bool:
    """b leads back over a's foreign key."""
    return a[0] == b[2] and a[2] == b[0] and base(a[1]) == base(b[1]) and is_reverse(a[1]) != is_reverse(b[1])


def is_backtrack(a: Edge, b: Edge) -> bool:
    """From a parent to its children and straight back. To a parent and on to its other children is a path."""
    return is_inverse(a, b) and is_reverse(a[1])


def extensions(path: Path, graph: dict[str, list[Edge]], allowed: set[str] | None = None) -> list[Edge]:
    return [e for e in graph.get(path[-1][2], []) if (allowed is None or e[2] in allowed) and not is_backtrack(path[-1], e)]


def metapaths(edges: Iterable[Edge], start: str, hops: int, strict: bool = False, by_base: bool = False) -> list[Path]:
    """All paths of at most so many hops, by node sequence, then relations.

    strict also bars an inverse in the other direction; by_base keeps one path of each base relations.
    """
    graph = adjacency(edges)
    level: list[Path] = [(e,) for e in graph.get(start, [])]
    found: list[Path] = []
    for _ in range(hops):
        found += level
        level = [(*p, e) for p in level for e in graph.get(p[-1][2], []) if not (is_inverse if strict else is_backtrack)(p[-1], e)]
    found.sort(key=lambda p: ([p[0][0], *(e[2] for e in p)], [e[1] for e in p]))
    if by_base:
        seen: dict[tuple, Path] = {}
        for p in found:
            seen.setdefault((p[0][0], *((base(e[1]), e[2]) for e in p)), p)
        found = list(seen.values())
    return found


def by_hop(paths: Iterable[Path], graph: dict[str, list[Edge]]) -> dict[int, list[tuple[Path, list[Edge]]]]:
    out: dict[int, list[tuple[Path, list[Edge]]]] = {}
    for p in paths:
        out.setdefault(len(p), []).append((p, extensions(p, graph)))
    return out


def path_name(path: Path) -> str:
    return "__".join([path[0][0], *(x for e in path for x in (e[1], e[2]))])


def feature_name(path: Path) -> str:
    return f"{path_name(path)}__cnt_{path[-1][2]}_h{len(path)}"


def forward_columns(path: Path, graph: dict[str, list[Edge]]) -> list[str]:
    """Foreign-key columns that the path's forward extensions need."""
    return sorted({fk_column(e[1]) for e in extensions(path, graph) if not is_reverse(e[1])})


def pretty(paths: Iterable[Path]) -> str:
    lines: list[str] = []
    hop = 0
    for p in sorted(paths, key=len):
        if len(p) != hop:
            hop = len(p)
            lines.append(f"hop {hop}")
        lines.append("  " + " -> ".join([p[0][0], *(e[2] for e in p)]) + "   via " + ", ".join(e[1] for e in p))
    return "\n".join(lines)


def edges_frame(spark, edges: Iterable[Edge]) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(list(edges), "src string, rel string, dst string")


def paths_frame(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """(path, hop, last_rel, last_dst): metapaths by self-joins of the edge types."""
    level = edges.where(F.col("src") == start).select(F.concat_ws("__", "src", "rel", "dst").alias("path"), F.lit(1).alias("hop"), F.col("src").alias("last_src"), F.col("rel").alias("last_rel"), F.col("dst").alias("last_dst"))
    out = level
    for hop in range(2, hops + 1):
        back = F.col("last_rel").startswith("rev_") & (F.regexp_replace("last_rel", "^rev_", "") == F.col("rel")) & (F.col("last_src") == F.col("dst"))
        level = level.join(edges, F.col("last_dst") == F.col("src")).where(~back)
        level = level.select(F.concat_ws("__", "path", "rel", "dst").alias("path"), F.lit(hop).alias("hop"), F.col("src").alias("last_src"), F.col("rel").alias("last_rel"), F.col("dst").alias("last_dst"))
        out = out.unionByName(level)
    return out
