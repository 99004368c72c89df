"""Packed vectors, score differences, observed counts and the manifest's totals."""

import math

import duckdb
import numpy as np
import pytest
from loomgraph.operators import joins, metrics, vectors
from loomgraph.plans import QUERIES
from loomgraph.sources import readers
from pyspark.sql import functions as F


def test_pack_and_unpack_are_numpys_half_precision(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=int(rng.integers(0, 9))) * 10.0 ** int(rng.integers(-9, 5))).tolist(), k) for k in range(200)] + [(900, None, 1), (901, [1e9, -1e9, 65504.0, 2.0**-25, None], 2), (902, [], 3)]
    table = spark.createDataFrame(rows, "id long, v array<double>, other long").repartition(3)
    packed = vectors.pack(table, "v")
    assert packed.columns == ["id", "other", "packed", "width"]
    for r in packed.collect():
        v = rows[r["id"]][1] if r["id"] < 900 else dict((a, b) for a, b, _ in rows)[r["id"]]
        if v is None:
            assert r["packed"] is None and r["width"] is None
            continue
        with np.errstate(over="ignore"):
            want = np.array([math.nan if x is None else x for x in v], dtype=np.float64).astype("<f2")
        assert bytes(r["packed"]) == want.tobytes() and r["width"] == len(v)
    again = {r["id"]: r["vector"] for r in vectors.unpack(packed.where("id <> 901")).collect()}
    for k, v, _ in rows:
        if k != 901:
            assert again[k] == (None if v is None else np.array(v).astype("<f2").astype(float).tolist())
    assert vectors.unpack(vectors.pack(table.where("false"), "v")).count() == 0
    sliced = vectors.pack(table.orderBy("id").limit(7).coalesce(1), "v")
    assert [r["width"] for r in sliced.orderBy("id").collect()] == [len(v) for _, v, _ in rows[:7]]


def test_score_differences(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.25, 0.5), (2, None, None), (3, None, 0.1), (3, 0.1, 0.1)], "sample_id long, a double, b double")
    assert {r["sample_id"]: r["max_abs_diff"] for r in vectors.score_differences(rows, "a", "b").collect()} == {1: 0.25, 2: 0.0, 3: math.inf}


def test_counts_come_with_the_rows_in_one_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "CASE WHEN id % 10 < 3 THEN 'a' WHEN id % 10 = 5 THEN 'odd' WHEN id % 10 = 6 THEN 'b' END AS reason").write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    rows, seen = metrics.observed_counts(table, ("a", "b", "none"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    rows.where("reason IS NULL").write.parquet(f"{tmp_path}/out")
    grouped = {r["reason"]: r["n"] for r in metrics.reason_counts(table).collect()}
    assert seen.get == {"a": grouped["a"], "b": grouped["b"], "none": 0, "other": grouped["odd"], "kept": grouped[None], "all": 1000}


def test_totals_of_a_manifest(spark):
    lines = spark.createDataFrame([(1, 5, 2, True, 0.1, "x"), (2, 3, 0, False, 0.3, "x"), (3, 1, 1, True, 0.2, "y")], "sample_id long, num_candidates long, num_positive long, has_positive boolean, max_abs_diff double, split string")
    assert [tuple(r) for r in metrics.manifest_totals(lines).collect()] == [(3, 9, 3, 2, 0.3)]
    assert {r["split"]: r["candidates"] for r in metrics.manifest_totals(lines.drop("max_abs_diff"), "split").collect()} == {"x": 8, "y": 1}


def test_positions_need_partners(spark):
    left, right = (spark.createDataFrame([(k, k * f) for k in ids], "id long, v long") for ids, f in (((1, 2), 10), ((2, 1), 100)))
    got = {tuple(r) for r in joins.checked_positions(left.withColumnRenamed("v", "w"), right).collect()}
    assert got == {(1, 10, 100), (2, 20, 200)}
    with pytest.raises(ValueError, match="without a partner"):
        joins.checked_positions(left, right.where("id = 1"))


def test_dataset_descriptors():
    assert readers.dataset_info({"train": "a.json"}, {"prompt": "q"}) == {"train": {"file_name": "a.json", "columns": {"prompt": "q"}}}


def test_whole_gold_triples_are_counted_once(spark):
    rows = spark.createDataFrame([(1, "a", "r", "b"), (1, "a", "r", "b"), (1, "a", "", "b"), (1, "c", "r", "d"), (2, "", "r", "d")], "sample_id long, head string, relation string, tail string")
    assert [tuple(r) for r in metrics.distinct_gold(rows).collect()] == [(1, 2)]
    assert spark.range(1).select(metrics.rescaled(F.lit(-1.5)).alias("x")).first()["x"] == 0


def test_all_scores_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=4 if k % 6 else 5).tolist()) for k in range(20)] + [(20, None), (21, [1.0, None, 2.0, 3.0]), (22, []), (23, [math.inf, 0.0, 0.0, 1.0])]
    table = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {(r["q"], r["item"]): r["score"] for r in vectors.all_scores(table.where("id % 2 = 0"), table, "id", "v").collect()}
    assert len(got) == 12 * 24
    for (a, b), s in got.items():
        x, y = dict(rows)[a], dict(rows)[b]
        if x is None or y is None or None in x or None in y or len(x) != len(y):
            assert s is None
        else:
            want = sum(p * q for p, q in zip(x, y, strict=True))
            assert s == pytest.approx(want) or math.isnan(s) and math.isnan(want)


def test_packed_vectors_are_made_in_single_precision_and_counted_by_id(spark, tmp_path):
    whole = [-0.9, -0.8, -0.6, -0.4, -0.3, -0.2, -0.1, 0.7, 0.9]  # tenfold whole in single precision only
    rows = [(k, [0.25, x, 0.5]) for k, x in enumerate(whole)] + [(90, [0.31, 0.2]), (90, [-0.5]), (None, [1.5, 2.5]), (91, [0.05, 0.01]), (92, []), (93, None), (94, [3e9, -0.3]), (95, [math.inf, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["h20_packed"](spark, str(tmp_path)).select("vec_id", "width", "weighted", "most").collect()]
    want = con.execute(f"SELECT vec_id, width, weighted, most FROM ({QUERIES['h20_packed'].sql})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == len(whole) + 4
