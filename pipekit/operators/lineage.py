"""Table lineage: edges from a run log, and everything downstream of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipekit.session import cut_lineage

def lineage_edges(runs: DataFrame, target: str, sources: str, seen_at: str) -> DataFrame:
    """Distinct (source, target) pairs of a run log whose ``sources`` column is an array, with how often and
    when last they were seen.  Pairs are combined before the shuffle."""
    pairs = runs.select(
        F.explode(sources).alias("source_table"), F.col(target).alias("target_table"), F.col(seen_at).alias("_seen")
    )
    return pairs.groupBy("source_table", "target_table").agg(
        F.max("_seen").alias("last_seen"), F.count(F.lit(1)).alias("runs")
    )


def downstream(
    edges: DataFrame, start: str, source: str = "source_table", target: str = "target_table"
) -> DataFrame:
    """All tables reachable from ``start`` (itself only if an edge leads back to it); cycles are fine.

    A table with a single known source is reached exactly if that source is, so each round hangs its edges on that
    source: chains and trees shorten by half per round, and a graph takes about the logarithm of its depth in rounds, plus
    one per table of several sources on the way.  Then the edges of reached tables are spent: their targets are reached,
    and all edges into these are dropped.  No edge is ever added, so a hub costs no more than its edges.

    Only names move.  The edges that are left are written to the checkpoint folder each round, dealt by the name they
    start from, so the plan does not grow and a lost executor costs no more than a round.  Edges with a NULL name lead
    nowhere; repeated edges count once.
    """
    origin = F.lit(start)
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    known = cut_lineage(pairs.filter((F.col("a") != F.col("b")) | (F.col("b") == origin)).distinct())
    left = known.filter(F.col("b") != origin)
    frontier = known.sparkSession.range(1).select(origin.alias("a"))
    reached = frontier
    while True:
        sources = left.groupBy(F.col("b").alias("a")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("only"))
        hung = left.join(sources.filter("n = 1").select("a", "only"), "a", "left")
        hung = cut_lineage(hung.select(F.coalesce("only", "a").alias("a"), "b").filter("a <> b").distinct())
        # Edges of tables reached earlier are spent, so those of the last round's tables lead on.
        frontier = cut_lineage(hung.join(frontier, "a", "left_semi").select(F.col("b").alias("a")).distinct())
        if frontier.isEmpty():
            break
        reached = reached.unionAll(frontier)
        left = hung.join(frontier.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b")
    back = known.filter(F.col("b") == origin).join(reached, "a", "left_semi").select(F.col("b").alias("a")).distinct()
    return reached.filter(F.col("a") != origin).unionAll(back).withColumnRenamed("a", "table_name")
