"""Tables without rows are known to be empty when a query is planned; baskets are made once."""

from pyspark.sql import functions as F

from test_basket import frame
from tillwater.operators import closed, recommend
from tillwater.plans import baskets
from tillwater.session import known_empty, stored
from tillwater.sources.testdata import Tables

RULES = "user_id string, antecedent array<string>, consequent array<string>, support double, confidence double, lift double"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_known_empty(spark):
    table = stored(spark.range(3))
    assert known_empty(table) is table
    none = known_empty(stored(spark.range(3).filter("id > 5")))
    assert none.schema == table.schema and optimized(none).startswith("LocalRelation <empty>")


def test_no_rules_make_signals_without_joins(spark):
    history = spark.createDataFrame([("u", "c", "p")], "user_id string, customer_id string, product_id string")
    products = spark.createDataFrame([("u", "p", "Name")], "user_id string, product_id string, name string")
    for rows in ([], [("u", ["p"], ["q"], 0.5, 0.5, 1.0)]):
        found = recommend.basket_signals(history, spark.createDataFrame(rows, RULES), products)
        assert ("Join" in optimized(found)) == bool(rows)
        assert found.columns == ["user_id", "customer_id", "product_id", "basket", "antecedent_names"] and found.count() == 0


def test_recommendations_of_parts_plan_no_rules(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(recommend, "recommend", lambda customers, products, history, rules, *w: seen.append(rules))
    baskets.recommendations_parts(Tables(spark, "/root/testdata/sf0.001"))
    assert optimized(seen[0]).startswith("LocalRelation <empty>")


def test_baskets_are_made_once_and_not_kept_without_frequent_items(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    tx = frame(spark, {"u": ["ab", "ab", "abc"], "v": ["a", "b"]}).repartition(1)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    counted = tx.select("user_id", "order_id", "items").mapInArrow(count, "user_id string, order_id string, items array<string>")
    kept = []
    monkeypatch.setattr(closed, "stored", lambda df: kept.append(df.columns) or stored(df))
    found = closed.generators(counted.select(*[F.col(c) for c in counted.columns]), 0.0, 2)
    assert {(r["user_id"], tuple(r["items"])): tuple(r["closed"]) for r in found.collect()} == {("u", ("a",)): ("a", "b"), ("u", ("b",)): ("a", "b")}
    assert made.value == 5
    kept.clear()
    none = closed.generators(counted, 0.0, 9)
    assert none.count() == 0 and closed.rules(none).count() == 0 and none.schema.names == found.schema.names
    assert not any("basket" in c for c in kept)
