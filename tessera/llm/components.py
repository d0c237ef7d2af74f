"""Connected components by randomised contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge list; component is its group's smallest node.

    Each round maps every node to the neighbour (or itself) that comes first in that round's random order and
    contracts the graph along the map; an expected constant fraction of the nodes goes each round, whatever the
    graph's diameter or its largest degree. Hot nodes cost nothing special: choosing is a minimum, which combines
    before the shuffle, and each join has one row per node on one side. Every round is a table in the shared folder.
    Edges with a null end and loops are ignored; repeated edges count once; no edge gives no row.
    """
    at, maps = lambda k: f"components-{k}", []
    left = cut(_simple(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), at("edges"))
    while not left.isEmpty():
        seed = F.lit(len(maps))
        ends = left.select(F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("near")) for x, y in ("uv", "vu", "uu", "vv")])).alias("e"))
        ranked = ends.select("e.node", F.struct(F.xxhash64(F.col("e.near"), seed).alias("h"), F.col("e.near").alias("near")).alias("r"))
        step = cut(ranked.groupBy("node").agg(F.min("r").alias("r")).select("node", F.col("r.near").alias("to")), at("map"))
        maps.append(step)
        moved = left.join(step.toDF("u", "u2"), "u").join(step.toDF("v", "v2"), "v")
        left = cut(_simple(moved.select(F.col("u2").alias("u"), F.col("v2").alias("v"))), at("edges"))
    if not maps:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("component")).where(F.lit(False))
    found = maps[0].withColumnRenamed("to", "end")
    for step in maps[1:]:
        found = found.join(step.toDF("end", "to"), "end", "left").select("node", F.coalesce("to", "end").alias("end"))
    found = cut(found, at("ends"))
    least = found.groupBy("end").agg(F.min("node").alias("component"))
    return found.join(least, "end").select("node", "component")


def _simple(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
