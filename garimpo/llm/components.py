"""Groups of records that are linked directly or through others, by randomised contraction.

Each round every vertex hooks to the vertex with the least hash (under a fresh seed) among its neighbours and itself;
edges are relabelled to the hooks, loops dropped and duplicates removed. A constant share of the vertices vanishes in
expectation in each round, whatever the shape of the graph (chains and stars alike), so the rounds grow with the
logarithm of the number of vertices. The hooks of all rounds are then expanded backwards into the final mapping.

Scale: vertices and edges stay in distributed tables, written to the shared folder each round. Hooks are found by a
partially aggregated minimum. Relabelling joins edges to hooks on a vertex; vertices that hold many edges are joined
apart, through a broadcast of a proven number of rows, so no task receives all edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.text import single_spaced
from garimpo.operators.skew import HOT_ROWS, HOT_SHARE, hot_keys, lookup
from garimpo.session import cut


def _hook(edges: DataFrame, seed: int) -> DataFrame:
    """(v, hook, degree): for each vertex the neighbour, or itself, with the least hash."""
    order = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("v"))
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("n")))
    best = both.groupBy("v").agg(F.min(order("n")).alias("n"), F.count("*").alias("degree"))
    return best.select("v", F.least(order("v"), F.col("n"))["v"].alias("hook"), "degree")


def connected_groups(links: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """(id, groupid): every record with at least one link to another one, and the smallest id of its group.

    Links with a null end and loops are ignored; repeated and reversed links count once. Any orderable column type works
    (both ends must share it). An empty input gives an empty result. Other columns of `links` are not read.
    """
    a, b = F.col(left), F.col(right)
    usable = a.isNotNull() & b.isNotNull() & (a != b)
    first = cut(links.filter(usable).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    edges, hooks, left_over = first, [], first.count()
    for seed in range(max_rounds):
        if left_over == 0:
            break
        mapping = cut(_hook(edges, seed))
        hooks.append(mapping.select("v", "hook"))
        # Each edge counts in the degree of two vertices, so at most 2 * HOT_SHARE vertices are hot.
        hot = mapping.filter(F.col("degree") >= max(HOT_ROWS, left_over // HOT_SHARE)).select("v").collect()
        moved = _relabel(_relabel(edges, "a", mapping, hot), "b", mapping, hot)
        x, y = F.col("a"), F.col("b")
        edges = cut(moved.filter(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())
        left_over = edges.count()
    if left_over:
        raise RuntimeError(f"{left_over} edges were left after {max_rounds} rounds")
    if not hooks:
        return first.select(F.col("a").alias("id"), F.col("a").alias("groupid"))
    # Backwards: where a round's hook goes on in later rounds. The hooks of a round are the vertices of the next one.
    onward = hooks.pop()
    while hooks:
        now = hooks.pop()
        hot = hot_keys(now, "hook", now.count())
        ends = onward.select(F.col("v").alias("hook"), F.col("hook").alias("end"))
        onward = lookup(now, "hook", ends, "end", hot).select("v", F.coalesce("end", "hook").alias("hook"))
    final = cut(onward)
    least = final.groupBy("hook").agg(F.min("v").alias("groupid"))
    return lookup(final, "hook", least, "groupid", hot_keys(final, "hook", final.count())).select(F.col("v").alias("id"), "groupid")


def _relabel(edges: DataFrame, end: str, mapping: DataFrame, hot: list) -> DataFrame:
    """edges with one end replaced by its hook."""
    return lookup(edges.withColumnRenamed(end, "v"), "v", mapping, "hook", hot).drop("v").withColumnRenamed("hook", end)


def positive(verdict: Column, accepted: tuple[str, ...] = ("IDENTICAL", "LIKELY_IDENTICAL")) -> Column:
    """Whether a verdict is one of `accepted`, whatever its letter case, surrounding spaces and separators; null and blank are not."""
    form = F.regexp_replace(single_spaced(F.upper(verdict)), r"[^A-Z]+", "_")
    return F.coalesce(form.isin(*accepted), F.lit(False))
