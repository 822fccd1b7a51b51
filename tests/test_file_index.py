"""Files by reference: bin packing, compaction, rank cuts of any type, and probes that lose nothing."""

import random
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pipekit.functions import rank_bucket
from pipekit.operators.layout import key_bits, rank_cuts, zorder_cluster
from pipekit.sinks import FileIndex
from pipekit.sinks.file_index import first_fit


@pytest.mark.parametrize("seed", range(5))
def test_first_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 200))]
    bins = first_fit(sizes, 100)
    # The same by trying every bin in turn.
    room, expected = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, free in enumerate(room) if free >= sizes[i]), len(room))
        if at == len(room):
            room.append(100)
        room[at] -= sizes[i]
        expected[i] = at
    assert bins == expected
    assert first_fit([500], 100) == [0]  # larger than a bin: alone


def index_of(spark, tmp_path, df, zones):
    made = FileIndex(spark, str(tmp_path / "index"), df.schema, zones)
    made.start_from(df)
    return made


def test_compaction_rewrites_small_files_only(spark, tmp_path):
    big = spark.range(40_000).selectExpr("id AS k", "cast(id * 7919 % 1000 AS string) AS s").coalesce(1)
    index = index_of(spark, tmp_path, big, ["k"])
    (large,) = index.files().collect()
    for i in range(3):
        index.append(spark.range(i * 10, i * 10 + 10).selectExpr("id AS k", "'small' AS s").repartition(4, "k"))
    before = {r.path for r in index.files().collect()}
    content = rows(index.read())
    done = index.compact(target_bytes=large.bytes)
    after = {r.path for r in index.files().collect()}
    assert large.path in after and after & before == {large.path}
    assert done.files_before == len(before) and done.files_after == len(after) == 2 and done.small_after == 1
    assert done.bytes_rewritten == done.bytes_total - large.bytes
    assert rows(index.read()) == content
    again = index.compact(target_bytes=large.bytes)  # a single small file has no partner
    assert again.bytes_rewritten == 0 and {r.path for r in index.files().collect()} == after


def test_zones_and_probes(spark, tmp_path):
    frame = spark.range(2000).selectExpr("id AS k", "concat('name', lpad(id * 7919 % 2000, 4, '0')) AS s", "if(id % 10 = 0, NULL, id) AS n")
    index = index_of(spark, tmp_path, frame.repartition(8, "k"), ["s", "n"])
    wanted = {"s": (F.lit("name0100"), F.lit("name0199"))}
    before = index.probe(wanted).head()
    assert (before.files, before.rows, before.files_read) == (8, 2000, 8)
    index.cluster(["s", "n"], 8)
    after = index.probe(wanted).head()
    assert after.rows == 2000 and 0 < after.rows_read < 1200
    got = index.between(wanted)
    assert rows(got.select("s")) == rows(frame.filter("s BETWEEN 'name0100' AND 'name0199'").select("s"))
    assert rows(index.read()) == rows(frame)
    none = {"s": (F.lit("zzz"), F.lit("zzzz"))}
    assert index.probe(none).head().files_read == 0 and index.between(none).count() == 0
    both = {"s": wanted["s"], "n": (F.lit(0), F.lit(100))}
    assert index.between(both).count() == frame.filter("s BETWEEN 'name0100' AND 'name0199' AND n BETWEEN 0 AND 100").count()


def test_files_without_values_and_empty_datasets(spark, tmp_path):
    empty = index_of(spark, tmp_path, spark.createDataFrame([], "k long, s string"), ["s"])
    assert empty.read().count() == 0 and empty.probe({"s": (F.lit("a"), F.lit("b"))}).head().files_read == 0
    assert empty.compact(1000).bytes_rewritten == 0
    empty.append(spark.createDataFrame([(1, None)], "k long, s string"))
    assert empty.files().head().low_0 is None and empty.between({"s": (F.lit("a"), F.lit("b"))}).count() == 0
    assert rows(empty.read()) == [(1, None)]


@pytest.mark.parametrize(
    "kind, value",
    [
        ("string", lambda i: f"v{i:05d}"),
        ("int", lambda i: i),
        ("double", lambda i: i / 7),
        ("date", lambda i: datetime(2024, 1, 1).date().replace(year=1500 + i % 900)),
        ("timestamp", lambda i: datetime(1990 + i % 40, 1 + i % 12, 1 + i % 28)),
        ("boolean", lambda i: i % 2 == 0),
    ],
)
def test_rank_cuts_of_any_type(spark, kind, value):
    rng = random.Random(1)
    values = [value(rng.randrange(20_000)) for _ in range(3000)] + [None] * 5
    frame = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    cuts = rank_cuts(frame, ["x"], 8)["x"]
    numbered = frame.select("x", rank_bucket(F.col("x"), cuts, 3).alias("b")).collect()
    assert all(r.b == 0 for r in numbered if r.x is None) and all(0 <= r.b < 8 for r in numbered)
    in_order = sorted((r for r in numbered if r.x is not None), key=lambda r: r.x)
    assert [r.b for r in in_order] == sorted(r.b for r in in_order)
    if kind not in ("boolean",):
        sizes = [sum(r.b == b for r in in_order) for b in range(8)]
        assert max(sizes) < 2.2 * len(in_order) / 8


def test_rank_bucket_is_the_number_of_cuts_at_or_below(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 7, 100, 255):
        points = sorted(rng.sample(range(1000), n))
        cuts = F.array(*[F.lit(p) for p in points]).cast("array<int>")
        got = spark.range(1000).select("id", rank_bucket(F.col("id").cast("int"), cuts, 8).alias("b")).collect()
        assert all(r.b == sum(p <= r.id for p in points) for r in got)


def test_bits_follow_the_files():
    assert key_bits(2, 1) == 4 and key_bits(2, 1024) == 7 and key_bits(1, 1024) == 14 and 62 // 5 >= key_bits(5, 1 << 60)


def test_a_string_column_clusters(spark):
    frame = spark.range(1000).selectExpr("concat('n', id * 37 % 1000) AS s", "id AS k")
    assert rows(zorder_cluster(frame, ["s", "k"], 4)) == rows(frame)


def test_listing_and_compaction_sort_no_rows(spark, tmp_path, monkeypatch):
    index = index_of(spark, tmp_path, spark.range(300).selectExpr("id AS k", "string(id % 7) AS s").repartition(3, "k"), ["k", "s"])
    index.append(spark.range(300, 400).selectExpr("id AS k", "string(id) AS s").repartition(12, "k"))
    plan = index._listed(f"{index.root}/data")._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    monkeypatch.setattr("pipekit.sinks.file_index.FILES_PER_GROUP", 4)  # bins of several groups are numbered through
    content, size = rows(index.read()), index.files().agg({"bytes": "max"}).head()[0]
    before = {r.path for r in index.files().collect()}
    done = index.compact(target_bytes=4 * size, small_share=1.0)
    new = [r for r in index.files().collect() if r.path not in before]
    assert rows(index.read()) == content and 0 < len(new) < 15 and not any("bin=" in r.path for r in new)
    assert done.files_after == len(new) + done.files_before - sum(r not in {f.path for f in index.files().collect()} for r in before)


def test_compact_files_in_several_parts(spark, monkeypatch):
    from pipekit.plans import table_queries
    from pipekit.plans.registry import QUERIES

    monkeypatch.setattr(table_queries, "PART_BYTES", 100_000)  # three parts
    found = QUERIES["compact_files"](spark, "/root/testdata/sf0.01").head().asDict()
    assert found.pop("row_count") == 30_000 and found.pop("key_sum") > 0
    assert (found.pop("files_before"), found.pop("small_before")) == (13, 12) and all(found.values())
