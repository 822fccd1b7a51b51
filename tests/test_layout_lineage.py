import random

import pytest
from conftest import DATA, plan_text, rows

from pyspark.sql import functions as F

from pipekit.functions import bucket_of, interleave_bits
from pipekit.operators.layout import (
    archive_split,
    bloom_options,
    compact,
    file_count,
    file_row,
    stored_bytes,
    write_branches,
    write_layout,
    write_tiers,
    zorder_cluster,
)
from pipekit.operators.rules import QualityRule, mark_outcome
from pipekit.operators import lineage
from pipekit.operators.lineage import downstream, lineage_edges


def files(path):
    return sorted(path.rglob("*.parquet"))


def test_compaction_needs_no_shuffle_and_keeps_rows(spark, tmp_path):
    small = tmp_path / "small"
    spark.range(1000).repartition(20).write.parquet(str(small))
    assert stored_bytes(spark, str(small)) == sum(f.stat().st_size for f in files(small))
    compact(spark, str(small), str(tmp_path / "big"))
    assert len(files(small)) == 20 and len(files(tmp_path / "big")) == 1
    assert rows(spark.read.parquet(str(tmp_path / "big"))) == rows(spark.range(1000))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(512 << 20)  # the caller's session is untouched


def test_partitioned_compaction(spark, tmp_path):
    small = str(tmp_path / "small")
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, id % 4) AS p").repartition(10)
    df.write.partitionBy("p").parquet(small)
    compact(spark, small, str(tmp_path / "big"), partition_by=["p"])
    assert len(files(tmp_path / "big")) < len(files(tmp_path / "small"))
    assert rows(spark.read.parquet(str(tmp_path / "big")).select("id", "p")) == rows(df)


def test_bits_interleave(spark):
    df = spark.sql("SELECT 5 AS x, 3 AS y")  # x = 101, y = 011
    assert df.select(interleave_bits([F.col("x"), F.col("y")], 3)).head()[0] == 0b011011
    with pytest.raises(ValueError):
        interleave_bits([F.col("x")] * 4, 16)


def test_buckets(spark):
    df = spark.createDataFrame([(v,) for v in [None, -1, 10, 15, 20, 30, 99]], "v int")
    got = [r[0] for r in df.select(bucket_of(F.col("v"), [10, 20, 30])).collect()]
    assert got == [0, 0, 1, 1, 2, 3, 3]
    assert df.select(bucket_of(F.col("v"), [])).distinct().count() == 1


def test_zorder_narrows_both_columns(spark, tmp_path):
    lineitem = spark.read.parquet(f"{DATA}/lineitem.parquet")
    out = str(tmp_path / "z")
    zorder_cluster(lineitem, ["l_partkey", "l_shipdate"], 8, tie_breakers=[file_row()]).write.parquet(out)
    written = spark.read.parquet(out)
    assert written.columns == lineitem.columns
    assert written.exceptAll(lineitem).isEmpty() and written.count() == lineitem.count()
    key_range = lineitem.agg(F.max("l_partkey") - F.min("l_partkey")).head()[0]
    per_file = written.groupBy(F.col("_metadata.file_path").alias("f")).agg(
        (F.max("l_partkey") - F.min("l_partkey")).alias("r"),
        F.count(F.lit(1)).alias("n"),
    )
    spread = per_file.agg(F.avg("r"), F.count(F.lit(1))).head()
    assert spread[1] == 8 and spread[0] < 0.6 * key_range


def test_zorder_splits_exact_copies(spark, tmp_path):
    """Every row the same: one curve cell, still several files."""
    spark.range(4000).selectExpr("1 AS a", "2 AS b").coalesce(1).write.parquet(str(tmp_path / "same"))
    same = spark.read.parquet(str(tmp_path / "same"))
    clustered = zorder_cluster(same, ["a", "b"], 4, tie_breakers=[file_row()])
    sizes = [r["count"] for r in clustered.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_write_layout(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 AS p", "cast(id AS string) AS s")
    out = tmp_path / "layout"
    write_layout(df, str(out), ["p"], sort_by=["id"], bloom_columns=["s"])
    assert {f.parent.name for f in files(out)} == {"p=0", "p=1", "p=2"}
    assert all(".zstd." in f.name for f in files(out))
    back = spark.read.parquet(str(out))
    assert back.filter("s = '42'").count() == 1 and back.count() == 100
    assert "PartitionFilters: [isnotnull(p" in plan_text(back.filter("p = 1"))
    assert bloom_options(["s"], 10) == {
        "parquet.bloom.filter.enabled#s": "true",
        "parquet.bloom.filter.expected.ndv#s": "10",
    }


def test_tiers_hold_every_row_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "k int, age int")
    hot, archive = write_tiers(df, "age > 10", str(tmp_path / "tiers"))
    assert rows(spark.read.parquet(hot).select("k")) == [(1,), (3,)]
    assert rows(spark.read.parquet(archive).select("k")) == [(2,)]
    assert archive_split(df, "age > 10").filter("_tier = 'hot'").count() == 2


def test_branches_are_written_in_one_pass(spark, tmp_path):
    marked = mark_outcome(spark.range(10), [QualityRule("small", "id < 3")])
    folders = write_branches(marked, "_outcome", str(tmp_path / "b"), ["valid", "quarantined", "never"])
    assert rows(spark.read.parquet(folders["valid"]).select("id")) == [(0,), (1,), (2,)]
    assert spark.read.parquet(folders["quarantined"]).filter("_failed_rules[0] = 'small'").count() == 7
    assert spark.read.parquet(folders["never"]).count() == 0
    assert file_count(spark, str(tmp_path / "b"), 1) == stored_bytes(spark, str(tmp_path / "b"))


def test_edges_from_runs(spark):
    runs = spark.createDataFrame([("t", ["a", "b"], 1), ("t", ["a"], 5), ("u", [], 7)], "target string, sources array<string>, at int")
    assert rows(lineage_edges(runs, "target", "sources", "at")) == [("a", "t", 5, 2), ("b", "t", 1, 1)]


EDGES = "source_table string, target_table string"


def test_downstream_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y")], EDGES)
    assert rows(downstream(edges, "a")) == [("a",), ("b",), ("c",)]
    assert rows(downstream(edges, "c")) == []


def reached(edges, start):
    """By a walk."""
    found, todo = set(), [start]
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b is not None and b not in found:
                found.add(b)
                todo.append(b)
    return sorted(found)


def rounds_of(spark, monkeypatch, edges, start):
    """Rounds that a closure takes; each checkpoints its edges and its frontier."""
    calls = []
    cut = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: calls.append(1) or cut(df))
    got = sorted(r[0] for r in downstream(spark.createDataFrame(edges, EDGES), start).collect())
    assert got == reached(edges, start)
    return (len(calls) - 1) // 2 - 1  # the last round finds nothing


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(150)]
    assert rounds_of(spark, monkeypatch, chain, "n0") <= 8
    branches = chain + [(f"n{i}", f"side{i}") for i in range(150)] + [(f"n{i}", "n0") for i in range(0, 150, 7)]
    assert rounds_of(spark, monkeypatch, branches, "n0") <= 8
    loop = chain + [("n150", "n3"), ("other", "n3"), ("far", "other")]
    assert rounds_of(spark, monkeypatch, loop, "n0") <= 8 + 2


def test_downstream_equals_a_walk(spark):
    rng = random.Random(1)
    for n, m in ((5, 6), (12, 20), (30, 45)):
        edges = [(f"t{rng.randrange(n)}", f"t{rng.randrange(n)}") for _ in range(m)] + [(None, "t1"), ("t0", None)]
        got = sorted(r[0] for r in downstream(spark.createDataFrame(edges, EDGES), "t0").collect())
        assert got == reached([e for e in edges if e[0]], "t0"), edges


def test_downstream_of_a_hub_adds_no_edges(spark):
    edges = [("a", f"b{i}") for i in range(20)] + [(f"b{i}", "c") for i in range(20)] + [("c", f"d{i}") for i in range(20)]
    frame = spark.createDataFrame(edges, EDGES)
    assert downstream(frame, "a").count() == 41 and downstream(frame.limit(0), "a").count() == 0
    assert downstream(frame, "nowhere").count() == 0


def test_clustered_files_fit_a_task(spark, monkeypatch):
    from pipekit.plans import table_queries
    from pipekit.plans.registry import QUERIES

    asked = []
    monkeypatch.setattr(table_queries, "file_count", lambda *args: asked.append(args[2:]) or 3)
    clustered = QUERIES["zorder_cluster"](spark, DATA)
    assert asked == [(table_queries.SORTED_BYTES,)] and len(clustered.inputFiles()) == 3
