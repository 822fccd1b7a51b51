"""Merge-on-read: batches cost what they hold, reads equal a model, folds and replays change nothing."""

import random
from pathlib import Path

import pytest
from conftest import plan_text, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipekit.operators.layout import stored_bytes
from pipekit.operators.merge import MergeRule, upsert
from pipekit.sinks import ChangeLogTable

TABLE = "k int, v int"
CHANGE = "k int, v int, at int, op string, other string"
SCHEMA = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.IntegerType())])
ORDER = [T.StructField("at", T.IntegerType())]


@pytest.fixture
def table(spark, tmp_path):
    made = ChangeLogTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], ORDER, "op = 'D'", buckets=4)
    made.start_from(spark.createDataFrame([(i, i) for i in range(20)], TABLE))
    return made


def change(spark, *some):
    return spark.createDataFrame([(*c, "x") for c in some], CHANGE)


def model(start, batches):
    """The newest change per key wins, batches in order; NULL keys add rows."""
    best, loose = {k: ((None, -1), v, False) for k, v in start}, []
    for n, batch in enumerate(batches):
        for k, v, at, op in batch:
            if k is None:
                loose += [] if op == "D" else [v]
            elif k not in best or (-1 if at is None else at, n) >= (-1 if best[k][0][0] is None else best[k][0][0], best[k][0][1]):
                best[k] = ((at, n), v, op == "D")
    return sorted([(k, v) for k, (_, v, gone) in best.items() if not gone]) + sorted((None, v) for v in loose)


def found(table):
    got = [tuple(r) for r in table.read().collect()]
    return sorted(r for r in got if r[0] is not None) + sorted((r for r in got if r[0] is None), key=str)


def test_reads_equal_the_model_through_folds_and_replays(spark, table):
    rng = random.Random(1)
    batches = []
    for n in range(7):
        keys = rng.sample(range(30), 9)
        batch = [(k, 100 * n + k, rng.choice([None, 1, 2, 3, 4]), rng.choice("UUD")) for k in keys] + [(None, n, 1, rng.choice("UD"))]
        batches.append(batch)
        table.apply(change(spark, *batch), n)
        expected = model([(i, i) for i in range(20)], batches)
        assert found(table) == expected
        if n % 2:
            table.fold(rng.choice([0.0, 0.3, 5.0]))
            assert found(table) == expected
        table.apply(change(spark, *batch), n)  # a replay after a crash, also after a fold
        assert found(table) == expected
    assert table.fold(0.0) and found(table) == expected and table.fold(0.0) == []


def test_a_late_older_change_counts_for_nothing(spark, table):
    table.apply(change(spark, (1, 11, 5, "U"), (2, 0, 5, "D"), (99, 9, 5, "U")), 0)
    table.fold(0.0)
    table.apply(change(spark, (1, 10, 4, "U"), (2, 20, 4, "U"), (99, 0, 4, "D")), 1)
    got = dict(found(table))
    assert got[1] == 11 and 2 not in got and got[99] == 9
    table.fold(0.0)
    assert dict(found(table)) == got


def test_newest_of_a_batch_wins(spark, table):
    table.apply(change(spark, (1, 11, 5, "U"), (1, 12, 6, "U"), (1, 10, None, "D")), 0)
    assert dict(found(table))[1] == 12


def test_equals_a_merge(spark, table):
    changes = change(spark, *[(k, -k, 1, "D" if k % 5 == 0 else "U") for k in range(10, 30)])
    table.apply(changes, 0)
    rule = MergeRule(["k"], "true", delete_condition="source.op = 'D'", insert_condition="op <> 'D'", ignore=["at", "op", "other"])
    merged = upsert(spark.createDataFrame([(i, i) for i in range(20)], TABLE), changes, rule)
    assert rows(table.read()) == rows(merged)


def test_statistics(spark, table):
    table.apply(change(spark, (1, 11, 5, "U"), (2, 0, 5, "D"), (50, 5, 5, "U"), (51, 5, 5, "D"), (None, 1, 1, "U")), 0)
    assert table.statistics(0).head().asDict() == {"rows_updated": 1, "rows_inserted": 2, "rows_deleted": 1, "rows_ignored": 1}
    table.apply(change(spark, (1, 1, 4, "U"), (2, 2, 6, "U"), (50, 0, 6, "D")), 1)
    assert table.statistics(1).head().asDict() == {"rows_updated": 0, "rows_inserted": 1, "rows_deleted": 1, "rows_ignored": 1}
    assert sum(table.statistics(7).head()) == 0
    table.fold(0.0)
    with pytest.raises(ValueError, match="folded"):
        table.statistics(1)


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    big = ChangeLogTable(spark, str(tmp_path / "big"), SCHEMA, ["k"], ORDER, "op = 'D'", buckets=16)
    big.start_from(spark.range(200_000).selectExpr("cast(id AS int) AS k", "cast(id * 7919 AS int) AS v"))
    before = {p: p.stat().st_mtime_ns for p in Path(big.root, "base").rglob("*.parquet")}
    few = change(spark, (5, 1, 1, "U"), (6, 1, 1, "U"))
    assert "FileScan" not in plan_text(big.changes(few, 0))  # no base, no log
    big.apply(few, 0)
    assert {p: p.stat().st_mtime_ns for p in Path(big.root, "base").rglob("*.parquet")} == before
    assert stored_bytes(spark, f"{big.root}/log") < stored_bytes(spark, f"{big.root}/base") / 50
    text = plan_text(big.read())
    assert text.count("SortMergeJoin") == 0 and "BroadcastHashJoin" in text  # the base is not shuffled for a small log
    folded = big.fold(0.0)
    assert 1 <= len(folded) <= 2  # only the buckets of the two keys
    new = {p for p in Path(big.root, "base").rglob("*.parquet")} - set(before)
    assert {int(p.parent.name.split("=")[1]) for p in new} == set(folded)
    assert big.read().count() == 200_000


def test_folded_batches_are_not_opened(spark, table):
    table.apply(change(spark, *[(k, 1, 1, "U") for k in range(20)]), 0)
    table.fold(0.0)
    table.apply(change(spark, (3, 2, 2, "U")), 1)
    state = table.state()
    files = table._pending(state).select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("batch=1" in r.f for r in files)


def test_without_an_order_the_later_batch_wins(spark, tmp_path):
    plain = ChangeLogTable(spark, str(tmp_path / "p"), SCHEMA, ["k"], delete_when="op = 'D'", buckets=2)
    plain.start_from(spark.createDataFrame([(1, 1), (2, 2)], TABLE))
    plain.apply(change(spark, (1, 0, 9, "D"), (3, 3, 9, "U")), 0)
    plain.fold(0.0)
    plain.apply(change(spark, (1, 5, 1, "U")), 1)
    assert found(plain) == [(1, 5), (2, 2), (3, 3)]
    with pytest.raises(Exception, match="several changes"):
        plain.apply(change(spark, (1, 5, 1, "U"), (1, 6, 2, "U")), 2)


def test_empty_tables_and_batches(spark, tmp_path):
    nothing = ChangeLogTable(spark, str(tmp_path / "e"), SCHEMA, ["k"], ORDER, buckets=2)
    nothing.start_from(spark.createDataFrame([], TABLE))
    assert found(nothing) == [] and nothing.fold() == []
    nothing.apply(spark.createDataFrame([], CHANGE), 0)
    assert found(nothing) == []
    nothing.apply(change(spark, (1, 1, 1, "U")), 1)
    assert found(nothing) == [(1, 1)] and nothing.fold(0.5) and found(nothing) == [(1, 1)]


def test_reserved_names(spark, tmp_path):
    with pytest.raises(ValueError, match="bucket"):
        ChangeLogTable(spark, str(tmp_path), T.StructType([T.StructField("bucket", T.IntegerType())]), ["bucket"])


def test_stream(spark, table, tmp_path):
    source = str(tmp_path / "in")
    change(spark, (1, 11, 1, "U")).write.parquet(source)
    stream = spark.readStream.schema(CHANGE).parquet(source)
    table.run(stream, str(tmp_path / "progress"))
    table.fold(0.0)
    change(spark, (1, 12, 2, "U"), (2, 0, 2, "D")).write.mode("append").parquet(source)
    table.run(stream, str(tmp_path / "progress"))
    got = dict(found(table))
    assert got[1] == 12 and 2 not in got
