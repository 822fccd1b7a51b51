"""Completeness of an entity set that was landed page by page, each page naming the next one.

Every landed page gets the page its chain starts with and its place in it, by pointer jumping: each round every page looks
where the page it looked at looks, so a chain of n pages takes about log2(n) rounds, whatever order pages were landed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipekit.session import cut_lineage


def page_chain(pages: DataFrame, page: str = "page", next_page: str = "next") -> DataFrame:
    """One row per landed page (``page``): ``start`` and ``position`` (from 0) in its chain, ``next``, and ``fault``:

    * ``cycle``: following back from the page never reaches a start (``start`` is the smallest page of the cycle that it
      hangs on or lies on, ``position`` is NULL);
    * ``gap``: its next page was not landed;
    * ``fork``: another page names the same next page (all pages but the smallest have the fault, and their next page
      follows the smallest);
    * ``second chain``: it starts a chain, and is not the smallest page that does;
    * NULL: none of these.  If several hold the first counts.

    Pages landed twice count once if they name the same next page; else the smallest next page counts.
    """
    landed = pages.select(F.col(page).alias("page"), F.col(next_page).alias("next")).filter("page IS NOT NULL")
    landed = cut_lineage(landed.groupBy("page").agg(F.min("next").alias("next")))
    links = landed.filter("next IS NOT NULL").groupBy(F.col("next").alias("page")).agg(F.min("page").alias("before"))
    linked = landed.join(links, "page", "left").join(landed.select(F.col("page").alias("next"), F.lit(True).alias("there")), "next", "left")
    forked = linked.join(links.select(F.col("page").alias("next"), F.col("before").alias("winner")), "next", "left")
    facts = cut_lineage(forked.select("page", "next", "before", "there", "winner"))

    # ``at``: how far back a page has looked; ``steps``: that many pages; ``least``: the smallest page on the way.
    looking = facts.select(
        "page", F.col("before").alias("at"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("steps"),
        F.col("page").alias("least"), F.coalesce("before", "page").alias("start"),
    )
    rounds = max(1, landed.count()).bit_length() + 1
    for _ in range(rounds):
        ahead = looking.select(
            F.col("page").alias("at"), F.col("at").alias("further"), F.col("steps").alias("more"),
            F.col("least").alias("lower"), F.col("start").alias("origin"),
        )
        joined = looking.join(ahead, "at", "left")
        looking = cut_lineage(
            joined.select(
                "page",
                F.col("further").alias("at"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                F.least("least", "lower").alias("least"),
                F.coalesce("origin", "start").alias("start"),
            )
        )
        if looking.filter("at IS NOT NULL").isEmpty():
            break
    chained = facts.join(looking, "page")
    cyclic = F.col("at").isNotNull()
    first = chained.filter(F.col("at").isNull() & F.col("before").isNull()).agg(F.min("page")).head()[0]
    fault = (
        F.when(cyclic, "cycle")
        .when(F.col("next").isNotNull() & F.col("there").isNull(), "gap")
        .when(F.col("winner") != F.col("page"), "fork")
        .when(F.col("before").isNull() & (F.col("page") != F.lit(first)), "second chain")
    )
    start = F.when(cyclic, F.col("least")).otherwise(F.col("start"))
    return chained.select("page", start.alias("start"), F.when(~cyclic, F.col("steps")).alias("position"), "next", fault.alias("fault"))
