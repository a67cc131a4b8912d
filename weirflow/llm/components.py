"""Connected components of a link table by alternating large and small stars.

Each round turns every node's links into a star around its least neighbour, first for the larger
neighbours and then for the smaller ones; the links end as one star per component after about
log(size)^2 rounds at most and a handful in practice. Links that are stars already take no round: every
round is many small jobs, of which the driver keeps the plans, stages and tasks. A star is an aggregation, whose result is a table
of its own, and a join of the links with that. So a hub, the least node of a large component, is one row
per task in the aggregation, and in the join Spark splits its links among tasks. What a round has used
up is deleted, and no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import discard, written


#: Links to a partition, and partitions of few links.
LINKS, LEAST = 250_000, 8


def _star(links: DataFrame, larger: bool, parts: int) -> DataFrame:
    """links: (u, v) with u > v, a written table that goes; parts: partitions at most. Returns links of the same form, without repeats, as a written table."""
    if larger:  # every node points its larger neighbours to its least one, itself included
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), parts)
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # every node points its smaller neighbours, and itself, to the least of them
        least = written(links.groupBy("u").agg(F.min("v").alias("m")), parts)
        out = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = written(out.where("u > v").distinct(), parts)
    discard(least)
    discard(links)
    return out


def _state(links: DataFrame) -> tuple[int, bool]:
    """How many links there are, and whether they are stars: every u has one link, and no v is a u as well."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    nodes = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    now = nodes.agg(F.sum("ups"), F.max((F.col("ups") + F.col("downs") > 1) & (F.col("ups") > 0))).first()
    return now[0] or 0, not now[1]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links between columns a and b -> (node, root) for every node with a link, the root being its component's least node.

    Repeated links and links of a node with itself change nothing; nulls are no nodes; no links give no rows.
    """
    stars = written(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        count, done = _state(stars)
        if done:
            break
        parts = LEAST + count // LINKS
        stars = _star(_star(stars, True, parts), False, parts)
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
