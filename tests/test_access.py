import pytest
from conftest import DATA, plan_text, rows

from pyspark.sql import functions as F

from pipekit.operators.access import (
    RowPolicy,
    classify_columns,
    entitled,
    filter_by_level,
    mask_columns,
    route_rows,
    secure,
)


@pytest.fixture
def docs(spark):
    data = [(1, "public", "emea"), (2, "secret", "apac"), (3, "internal", "emea"), (4, None, "emea"), (5, "odd", None)]
    return spark.createDataFrame(data, "id int, access_level string, region string")


def test_levels(docs):
    order = ["public", "internal", "secret"]
    assert rows(filter_by_level(docs, "access_level", "internal", order).select("id")) == [(1,), (3,)]
    assert filter_by_level(docs, "access_level", "secret", order).count() == 3  # unknown levels are for nobody
    with pytest.raises(ValueError, match="root"):
        filter_by_level(docs, "access_level", "root", order)


def test_level_filter_is_pushed_down(spark):
    customer = spark.read.parquet(f"{DATA}/customer.parquet")
    assert "PushedFilters: [In(c_mktsegment" in plan_text(filter_by_level(customer, "c_mktsegment", "b", ["a", "b", "c"]))


def test_policies(docs):
    policies = [
        RowPolicy("emea", "region = 'emea'", frozenset({"ann", "emea_team"})),
        RowPolicy("own", "id = 2", frozenset({"ann"})),
    ]
    assert rows(secure(docs, policies, "ann").select("id")) == [(1,), (2,), (3,), (4,)]
    assert rows(secure(docs, policies, "bob", groups=["emea_team"]).select("id")) == [(1,), (3,), (4,)]
    assert secure(docs, policies, "nobody").count() == 0
    assert secure(docs, [], "ann").count() == 0


def test_entitlements_do_not_multiply_rows(spark, docs):
    grants = spark.createDataFrame([("ann", "emea"), ("ann", "emea"), ("bob", "apac")], "user string, region string")
    assert entitled(docs, grants, ["region"], user="ann").count() == 3
    assert entitled(docs, grants, ["region"], user="eve").count() == 0


def test_masks(spark):
    df = spark.createDataFrame([("Ab1-x", "4111222233334444", "me", 7)], "a string, b string, c string, d int")
    row = mask_columns(df, {"a": "chars", "b": "tail", "c": "hash", "d": "null"}).head()
    assert row.a == "Xxn-x" and row.b == "*" * 12 + "4444" and len(row.c) == 64 and row.d is None
    assert mask_columns(df, {"d": "null"}).schema["d"].dataType.simpleString() == "int"
    assert mask_columns(df, {"c": lambda c: F.lit("?")}).head().c == "?"
    with pytest.raises(ValueError, match="blur"):
        mask_columns(df, {"a": "blur"})


def test_classification(spark):
    df = spark.createDataFrame([("me@x.org", "1"), ("you@y.com", None), ("nobody", "2")], "contact string, n string")
    tags = {(r.column_name, r.tag): r for r in classify_columns(df, ["contact", "n"], min_rate=0.5).collect()}
    assert tags[("contact", "email")].tagged and tags[("contact", "email")].hits == 2
    assert not tags[("contact", "url")].tagged and tags[("n", "email")].seen == 2


def test_routes_are_tried_in_order(docs):
    routed = route_rows(docs, {"mine": "id < 3", "emea": "region = 'emea'"}, default="rest")
    assert [r._route for r in routed.orderBy("id").collect()] == ["mine", "mine", "emea", "emea", "rest"]
    assert route_rows(docs, {}).select("_route").distinct().head()[0] == "default"
