"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, materialize


def _star(pairs: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """The table of least ids, and pairs that link every kept neighbour of ``u`` to the least of ``u`` and its neighbours.

    The least ids are a table of their own, so the join's exchanges hold nothing but its sides, and those of a hot ``u`` can be split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = materialize(least, "least")
    return least, pairs.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: comparable ids; loops, repeats and nulls are ignored) to (node, root): one row for each node that is not itself a root.

    The root is the least id of the component. Each round is two joins on plain aggregates, written to the
    shared folder; the driver sees two numbers a round. No links: no rows.
    """
    e = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = materialize(e, "links"), None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        first, large = _star(both, F.col("v") > F.col("u"))
        down = large.distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))
        second, small = _star(down, F.col("v") > F.col("m"))
        new = materialize(small.union(down.groupBy("u").agg(F.min("v"))).distinct(), "links")
        # the round's tables are in the new one
        discard(first, second, e)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


#: Copies of the table of components that share the naming of one component's members.
SALTS = 32


def labelled(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """``nodes`` (node, least: any type that has an order) and their ``stars`` (node, root) to (node, component): the smallest ``least`` of each component.

    Only members of components of several nodes are joined, and those of one root are dealt over SALTS tasks.
    """
    members = stars.select("node", "root").union(stars.select(F.col("root").alias("node"), "root").distinct())
    known = materialize(members.join(nodes, "node").select("node", "root", "least"), "labelled")
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    found = dealt.join(least, ["root", "salt"]).select("node", "component")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "least").alias("component"))
