"""Stored runs: ledger, published tables, notification store, name index."""

import random

import pytest
from pyspark.sql import functions as F

from test_basket import frame
from tillwater.operators import basket
from tillwater.sources.ledger import NameIndex, NotificationStore, Published, RunLedger


def rows(df, *columns):
    return sorted(df.select(*columns).collect(), key=str)


def test_ledger(spark, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "l"))
    assert ledger.runs().count() == 0
    make = lambda *r: spark.createDataFrame(r, "user_id string, customer_id int, x double")
    ledger.record("churn", "a", "2026-01-01", make(("u", 1, 0.1), ("u", 2, 0.2), ("v", 1, 0.3)))
    ledger.record("churn", "b", "2026-01-05", make(("u", 1, 0.9)))
    ledger.record("clv", "a", "2026-01-09", spark.createDataFrame([("u", "z")], "user_id string, y string"))
    assert [tuple(r) for r in rows(ledger.runs("churn"), "user_id", "rows", "run")] == [("u", 1, "b"), ("u", 2, "a"), ("v", 1, "a")]
    # A tenant that the later run did not cover keeps its earlier results.
    assert [tuple(r) for r in rows(ledger.latest("churn"), "user_id", "customer_id", "x")] == [("u", 1, 0.9), ("v", 1, 0.3)]
    ledger.record("churn", "b", "2026-01-05", make(("u", 7, 0.5)))  # a run that is repeated replaces itself
    assert [r["customer_id"] for r in rows(ledger.latest("churn").filter("user_id = 'u'"), "customer_id")] == [7]
    assert ledger.history("churn").count() == 4 and ledger.latest("clv").first()["y"] == "z"


def test_published(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(r, "user_id string, x int")
    table = Published(spark, str(tmp_path / "t"), make().schema)
    assert table.read().count() == 0
    table.replace(make(("1", 1), ("02", 2), ("c/d", 3)))
    # The new rows derive from the table they replace; a recomputed tenant without rows goes.
    table.replace(table.read().filter("user_id = '02'").withColumn("x", F.col("x") + 5), make(("02", 0), ("c/d", 0)).select("user_id"))
    assert [tuple(r) for r in rows(table.read(), "user_id", "x")] == [("02", 7), ("1", 1)]
    # A version without its pointer is not seen.
    make(("1", 99)).write.partitionBy("user_id").parquet(str(tmp_path / "t/rows/version=n99999999"))
    assert [tuple(r) for r in rows(table.read(), "user_id", "x")] == [("02", 7), ("1", 1)]


def test_notification_store(spark, tmp_path):
    schema = "user_id string, type string, priority string, title string, message string, related_date date, related_metric string"
    rnd = random.Random(4)
    store, kept = NotificationStore(spark, str(tmp_path / "n"), 4), set()
    assert store.read().count() == 0
    for run in range(3):
        batch = [(rnd.choice("uv"), "risk", "low", rnd.choice("ABC"), "m", None, rnd.choice([None, "x"])) for _ in range(8)]
        df = spark.createDataFrame(batch, schema)
        want = {(b[0], b[3], b[6]) for b in batch} - kept
        for _ in range(2):  # the same run again
            created, skipped = store.insert(df, f"r{run}", "2026-01-01")
            assert {(r["user_id"], r["title"], r["related_metric"]) for r in created.collect()} == want
            assert (skipped.agg(F.sum("times")).first()[0] or 0) == len(batch) - len(want)
        kept |= want
        assert store.read().count() == len(kept)


def test_name_index(spark, tmp_path):
    rnd = random.Random(6)
    names = [(u, i, "".join(rnd.choice("abAB é") for _ in range(rnd.randint(0, 12)))) for u in "uv" for i in range(150)] + [("u", 999, None)]
    df = spark.createDataFrame(names, "user_id string, customer_id int, name string")
    index = NameIndex(spark, str(tmp_path / "i"), 8)
    index.build(df)
    for term in ("aba", "ABAB", "b a", "aaaaa", "é a", "zzz", "abababab"):
        want = sorted((u, c) for u, c, n in names if n and term.lower() in n.lower())
        assert sorted(tuple(r) for r in index.search(f"{term}").select("user_id", "customer_id").collect()) == want or term != term.strip()
    plan = index.search("aba")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "piece" in plan.split("PushedFilters")[1]
    with pytest.raises(ValueError):
        index.search(" ab ")


def test_summary_of_tenants_without_baskets(spark):
    tx = frame(spark, {"u": ["ab", "a"]})
    sets = basket.frequent_itemsets(tx)
    out = basket.summary(tx, sets, basket.association_rules(sets), spark.createDataFrame([("u",), ("w",)], "user_id string"))
    got = {r["user_id"]: r for r in out.collect()}
    assert got["w"]["transactions"] == got["w"]["rules"] == got["w"]["products"] == 0 and got["w"]["max_lift"] == 0.0
    assert got["u"]["transactions"] == 2
