"""The isolation forest against a plain walk through its trees, and planted outliers."""

import random

from pyspark.sql import functions as F

from kgloom.operators import anomalies
from kgloom.operators.graph import Graph
from kgloom.sources import tables


def plain_scores(forest, rows, size):
    out = {}
    for i, x in rows.items():
        total = 0.0
        for t in forest:
            at = 0
            while t.feature[at] >= 0:
                at = 2 * at + 1 + (x[t.feature[at]] >= t.split[at])
            total += t.length[at]
        out[i] = 2 ** (-total / len(forest) / anomalies.mean_path(size))
    return out


def test_planted_outliers(spark):
    rng = random.Random(1)
    rows = {f"n{i:03d}": (rng.gauss(10, 1), rng.gauss(5, 1), 3.0) for i in range(400)} | {"far": (40.0, 5.0, 3.0), "odd": (10.0, -30.0, 3.0), "both": (-20.0, 30.0, 9.0)}
    df = spark.createDataFrame([(i, *x) for i, x in rows.items()] + [("null", None, 5.0, 3.0)], "id string, a double, b double, c double").withColumn("score", F.lit("clash"))
    got = {r["id"]: r["score"] for r in anomalies.isolation_scores(df, ["a", "b", "c"], trees=60, sample=256).collect()}
    clean = df.fillna(0.0, ["a"])
    want = plain_scores(anomalies.isolation_forest(clean, ["a", "b", "c"], 60, 256), rows | {"null": (0.0, 5.0, 3.0)}, 256)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in got)
    assert set(sorted(got, key=got.get)[-4:]) == {"far", "odd", "both", "null"}
    assert got == {r["id"]: r["score"] for r in anomalies.isolation_scores(df.repartition(7), ["a", "b", "c"], trees=60, sample=256).collect()}
    assert anomalies.isolation_scores(df.limit(0), ["a", "b"]).count() == 0
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "id string, a double")
    assert len({r["score"] for r in anomalies.isolation_scores(same, ["a"]).collect()}) == 1


def test_graph_anomalies(spark, sf):
    """A hub planted in the test graph comes first."""
    g = tables.graph(spark, sf)
    hub = g.nodes.where("type <> 'region'").select(F.lit("hub").alias("src"), F.col("id").alias("dst"), F.lit(9.0).alias("weight"), F.lit("ODD").alias("relationship_type"))
    more = Graph(g.nodes.unionByName(spark.createDataFrame([("hub", "Hub", "concept", 1.0)], "id string, label string, type string, size double")), g.edges.unionByName(hub))
    found = anomalies.anomalies(more, trees=30)
    assert found.count() == g.nodes.count() + 1 and found.orderBy(F.desc("score"), "id").first()["id"] == "hub"


def test_equal_rows_go_down_once(spark, monkeypatch):
    """Rows equal in all columns meet the trees as one row, and keep their own score; NaN and null are numbers too."""
    rows = [(f"n{i:04}", float(i % 5), None if i % 5 == 2 else float("nan") if i % 5 == 4 else 1.0) for i in range(1000)]
    table = spark.createDataFrame(rows, "id string, a double, b double")
    met, lengths = spark.sparkContext.accumulator(0), anomalies._lengths

    def watched(forest):
        inner = lengths(forest)
        count = F.udf(lambda x: met.add(1) or x, "array<double>")
        return lambda x: inner(count(x))

    monkeypatch.setattr(anomalies, "_lengths", watched)
    got = anomalies.isolation_scores(table, ["a", "b"], trees=20, sample=64).collect()
    assert len(got) == 1000 and len({r["id"] for r in got}) == 1000 and met.value == 5
    assert len({(r["a"], r["score"]) for r in got}) == 5
