"""Connected components of an edge table, by alternating large-star /
small-star rounds (Kiveris et al., 2014) of joins and grouped minima.

Only grouped minima (combined before the shuffle) and equi-joins touch the
edges, so a node with very many neighbours is split by the adaptive skew
join instead of being gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.store import discard, materialise


def _min_of(pairs: DataFrame, key: str, other: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.min(other).alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of comparable ids -> (node, comp): the smallest id that is
    reachable, for every node with an edge to another node.  Null ends and
    self-loops are ignored; an empty input gives an empty result."""
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")) \
        .where("u is not null and v is not null and u < v").distinct()
    e = materialise(e, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour moves to the smallest known node
        both = e.select("v", "u").unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        m = _min_of(both, "v", "u").select(F.col("v"), F.least("m", "v").alias("m"))
        large = both.join(m, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")) \
            .where("v > u").distinct()
        # small star: the smaller neighbours of a node meet at the smallest
        m2 = _min_of(large, "v", "u")
        small = large.join(m2, "v")
        nxt = small.where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u")) \
            .unionByName(m2.select("v", F.col("m").alias("u"))).distinct()
        nxt = materialise(nxt, "edges")
        # a star forest is the fixed point: equal count and content hash
        mark = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        discard(e)
        e = nxt
        if before == tuple(mark):
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = e.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionByName(
        e.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())
    out._llm_path = getattr(e, "_llm_path", None)
    return out
