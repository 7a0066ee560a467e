"""Connected components by alternating star contractions.

Each round replaces the edge set by one that has the same components and hangs more
vertices directly below their component's smallest vertex.  Rounds grow with the
logarithm of the longest path, never with a component's size.  The hub of a star may
have any number of edges: it is joined by key, so the planner can split it, and nothing
is gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, drop


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """Written out, so that the join below sees a shuffle on either side and can split a hub's rows."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Hang every larger neighbour of ``u`` below the smallest of ``u`` and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest_neighbour(both)
    used.append(low)
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Hang ``u`` and its smaller neighbours below the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest_neighbour(down)
    used.append(low)
    moved = down.join(low, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every vertex that has an edge; ``component`` is its smallest vertex.

    Self-loops and null ends are ignored, repeated edges count once, an empty edge table
    gives an empty result.  Raises if the contraction has not settled after ``max_rounds``.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    current = cut(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(current)
    for _ in range(max_rounds):
        used = [current]
        larger = cut(_large_star(current, used))
        used.append(larger)
        following = cut(_small_star(larger, used).where("u <> v").distinct())
        new_state = _state(following)
        for done in used:
            drop(done)
        current = following
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Two numbers that change with the edge set."""
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
