"""Attention over passages: gradient and features against plain forms, held-out accuracy, odd tables."""

import collections
import zlib

import numpy as np
import pytest
from loomgraph.llm import quality
from pyspark.sql import functions as F

DDL = "doc_id long, text string, label string, score double, x string"


def made(n=240):
    """Plain prose, and texts in which one passage of several is junk."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8)))) for _ in range(300)]
    out = []
    for k in range(n):
        t = [str(w) for w in rng.choice(words, int(rng.integers(60, 500)))]
        bad = k % 5 == 0
        if bad:
            at = int(rng.integers(0, len(t)))
            t[at:at] = [str(rng.choice(words)) + " ###" for _ in range(50)] if k % 2 else [str(rng.choice(words))] * 60
        out.append((k, " ".join(t), 0 if bad else 1))
    return out


def test_features_of_passages():
    texts = ["", "one two two Three! # 4", " ".join(f"w{k}" for k in range(quality.PASSAGE + 2)), " \n "]
    raw = [t.encode() for t in texts]
    x, begin = quality.passages(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    assert begin.tolist() == [0, 1, 2, 4, 5] and x.shape == (5, quality.FEATURES)
    assert not x[0].any() and not x[4].any()
    w = texts[1].split()
    seen = collections.Counter("".join(w).encode())
    size = sum(seen.values())
    assert x[1, :256] ** 2 == pytest.approx([seen[b] / size for b in range(256)], abs=1e-6)
    assert (x[1, 256:512] ** 2).sum() == pytest.approx(sum(len(t) - 1 for t in w) / size, abs=1e-5)
    lower, capital, digit, symbol = (sum(f(c) for c in "".join(w)) / size for f in (str.islower, str.isupper, str.isdigit, lambda c: c in "!#"))
    sizes = np.array([len(t) for t in w])
    assert x[1, 512:] == pytest.approx([lower, capital, digit, symbol, np.log1p(6), sizes.mean(), sizes.std(), 5 / 6, 1 / 6, 2 / 6, 1 / 6], abs=1e-5)
    assert x[3, 512 + 4] == pytest.approx(np.log1p(2))


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    begin, y, weight = np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])
    x = rng.normal(size=(9, 6))
    shapes = {"w": (6, 4), "b": 4, "v": (4, 3), "v0": 3, "u": (4, 3), "u0": 3, "gate": 3, "c": 4, "c0": 1}
    model = quality.QualityModel(parts={k: rng.normal(size=s) for k, s in shapes.items()})
    _, slope = model.gradient(x, begin, y, weight)
    for k, p in model.parts.items():
        for at in np.ndindex(p.shape):
            kept, found = p[at], []
            for step in (1e-5, -1e-5):
                p[at] = kept + step
                found.append(model.gradient(x, begin, y, weight)[0])
            p[at] = kept
            assert slope[k][at] == pytest.approx((found[0] - found[1]) / 2e-5, rel=1e-4, abs=1e-8)
    f = model.forward(x, begin)
    one = np.exp((f["t"] * f["g"])[1:4] @ model.parts["gate"])
    assert f["a"][1:4] == pytest.approx(one / one.sum()) and f["z"][1] == pytest.approx((one / one.sum()) @ f["h"][1:4])


def test_held_out_accuracy_and_attention(spark):
    rows = made()
    docs = spark.createDataFrame([(k, t, "a", 1.0, "b") for k, t, _ in rows], DDL).repartition(3)
    labels = spark.createDataFrame([(k, y, 1) for k, _, y in rows] + [(None, 1, 1), (9999, None, 1), (5, 7, 0)], "doc_id long, quality int, text int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([got[k]["predicted"] == y for k, y in held]) > 0.95
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and r["n_passages"] == -(-len(rows[k][1].split()) // quality.PASSAGE) for k, r in got.items())
    again = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(1), quality.train(docs.repartition(5), labels)).collect()}
    assert all(again[k] == pytest.approx(r["score"], abs=1e-6) for k, r in got.items())


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows = made(120)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.train(docs, labels), quality.train(docs, other)
    # only the share of each label outside the fold and its texts count
    assert all((one.parts[k] == two.parts[k]).all() for k in one.parts)


def test_odd_tables(spark):
    rows = made(100)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    model = quality.train(docs, labels)
    long = "word " * 300_000 + "ende " * 150_000
    odd = spark.createDataFrame([(1, None, "x", 0.5, "y"), (2, "", None, None, None), (3, " \n", None, None, None), (None, "no id", None, None, None), (4, long, None, None, None), (5, "same", None, None, None), (5, "same", None, None, None), (6, "x" * 3_000_000, None, None, None)], DDL)
    got = quality.score(odd, model).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["score"] == by[2]["score"] == by[3]["score"] and by[1]["n_passages"] == 1 and by[4]["n_passages"] == -(-450_000 // quality.PASSAGE)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    none = spark.createDataFrame([], DDL)
    assert quality.score(none, model).count() == 0
    assert quality.train(none, labels).constant is not None
    assert quality.train(docs, labels.where("false")).constant == 0.5
    ones = quality.train(docs, labels.where("quality = 1"))
    assert {(r["score"], r["predicted"]) for r in quality.score(odd, ones).collect()} == {(1.0, 1)}
