import pytest
from conftest import DATA, plan_text, rows

from pyspark.sql import functions as F

from pipekit.operators.clean import Cleaner, DropNulls, StandardizeText, chain
from pipekit.operators.enrich import Enricher, Lookup, hot_keys, lookup_join


def test_drop_nulls_also_drops_nan(nulls_nan):
    assert nulls_nan.transform(DropNulls(["x"])).count() == 2
    assert nulls_nan.transform(DropNulls(["b"])).count() == 2
    assert nulls_nan.transform(DropNulls(["b", "x"])).count() == 1


def test_trim_removes_spaces_only(spark):
    df = spark.createDataFrame([("  a ",), (" \tb ",), (None,)], "s string")
    assert [r.s for r in df.transform(StandardizeText(["s"])).collect()] == ["a", "\tb", None]


def test_unknown_text_operation():
    with pytest.raises(ValueError, match="title"):
        StandardizeText(["s"], "title")


def test_rules_run_in_order(spark):
    df = spark.createDataFrame([(" Ab ",), (None,)], "s string")
    cleaner = Cleaner([DropNulls(["s"])]).add(StandardizeText(["s"], "trim")).add(StandardizeText(["s"], "upper"))
    assert rows(chain(df, [cleaner])) == [("AB",)]


@pytest.fixture
def fact(spark):
    return spark.createDataFrame([(1, "x"), (2, "y"), (9, "z"), (None, "n")], "k int, v string")


@pytest.fixture
def dup_lookup(spark):
    return spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "nobody")], "k int, name string")


def test_lookup_multiplies_by_default(fact, dup_lookup):
    joined = lookup_join(fact, dup_lookup, "k", ["name"])
    assert rows(joined) == [(None, "n", None), (1, "x", "a"), (1, "x", "b"), (2, "y", "c"), (9, "z", None)]


def test_lookup_first_and_error(fact, dup_lookup):
    assert lookup_join(fact, dup_lookup, "k", ["name"], "first").filter("k = 1").head().name == "a"
    with pytest.raises(Exception, match="duplicate lookup key"):
        lookup_join(fact, dup_lookup, "k", ["name"], "error").collect()
    with pytest.raises(ValueError, match="on_duplicate"):
        lookup_join(fact, dup_lookup, "k", ["name"], "whatever")


def test_name_clash_is_found_at_plan_time(fact, dup_lookup):
    with pytest.raises(ValueError, match="already present"):
        lookup_join(fact, dup_lookup.withColumnRenamed("name", "v"), "k", ["v"])


def test_enricher_uses_tables_and_order(spark, fact, dup_lookup):
    dup_lookup.filter("name <> 'b'").createOrReplaceTempView("names")
    ages = spark.createDataFrame([("a", 30)], "name string, age int")
    enricher = Enricher().add("names", Lookup("names", "k", ["name"])).add("ages", Lookup(ages, "name", ["age"]))
    assert rows(enricher(fact).select("k", "name", "age").filter("age is not null")) == [(1, "a", 30)]


def test_hot_keys_are_few(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert hot_keys(df, "k") == [-1]
    assert hot_keys(df.filter("k >= 0"), "k") == []
    assert hot_keys(df.limit(0), "k") == []


@pytest.mark.parametrize("hot", [True, False])
def test_split_join_equals_plain_join(spark, hot):
    key = F.when(F.col("id") % 3 == 0, F.lit(7 if hot else None)).otherwise(F.col("id"))
    df = spark.range(3000).select(F.col("id").alias("row"), key.cast("bigint").alias("k"))
    lookup = spark.range(0, 3000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    plain = lookup_join(df, lookup, "k", ["twice"], "first")
    split = lookup_join(df, lookup, "k", ["twice"], "first", split_hot_keys=True)
    assert split.count() == 3000
    assert plain.select("row", "k", "twice").exceptAll(split.select("row", "k", "twice")).isEmpty()


def test_lookup_reads_only_what_it_joins(spark):
    customer = spark.read.parquet(f"{DATA}/customer.parquet").withColumnRenamed("c_custkey", "o_custkey")
    orders = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey")
    text = plan_text(lookup_join(orders, customer, "o_custkey", ["c_name"]))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in text
