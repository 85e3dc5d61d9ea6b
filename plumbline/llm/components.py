"""Connected components by distributed union-find.

Every round hooks each node to its smallest smaller neighbour, shortens the resulting chains by
pointer jumping until all point at roots, and contracts the edges to edges between roots. Rounds
end when no edge is left. Each step is a join or an aggregation with map-side combining and is
stored, so no plan grows with the rounds and a node with very many edges is an ordinary skewed
join side: the other side has each node once.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import stored


def _oriented(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b, each once; loops and edges with a null end are dropped."""
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not the smallest of its component.

    The root is the smallest node; ids may be of any type with an order.
    """
    left = stored(_oriented(edges), "edges")
    total = None
    while not left.isEmpty():
        parents = jumped(stored(left.groupBy("a").agg(F.min("b").alias("root")), "parents"))
        up = parents.select(F.col("a").alias("node"), "root")
        if total is None:
            total = up
        else:
            moved = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            total = stored(
                total.join(moved, "root", "left")
                .select("node", F.coalesce("next", "root").alias("root"))
                .unionByName(up),
                "roots",
            )
        of_a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        contracted = (
            left.join(of_a, "a")
            .join(of_b, "b", "left")
            .select(F.col("ra").alias("a"), F.coalesce("rb", "b").alias("b"))
        )
        left = stored(_oriented(contracted), "edges")
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))
    return total


def jumped(parents: DataFrame) -> DataFrame:
    """Pointers (a, root) shortened until every one points at a node without a pointer."""
    while True:
        further = parents.select(F.col("a").alias("root"), F.col("root").alias("next"))
        shorter = stored(
            parents.join(further, "root", "left").select(
                "a", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "parents",
        )
        parents = shorter.select("a", "root")
        if shorter.where("moved").isEmpty():
            return parents
