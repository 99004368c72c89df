"""Periodic runs against their definition, on random texts over few words, very long texts and odd tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from loomgraph.llm import periodic, queries
from pyspark.sql import functions as F

from tests.llm.test_operators import twins

DDL = "doc_id long, text string, runs string, n_words string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(w, least=12):
    """Every stretch that a lag can't extend, with its smallest period."""
    out, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e > i and e + q - i >= max(least, 2 * q) and smallest_period(w[i : e + q]) == q:
                out.add((i, e + q - i, q))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def looped(key, w):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def texts():
    rng = np.random.default_rng(3)
    a, b = twins(11)
    out = [None, "", " \t\n\x0b ", "one", "x " * 11, "x " * 12, "x y " * 6, "ab " * 5000, f"{a} {b} " * 8, " ".join([a] * 7 + [b] * 7), "é ü ñ  " * 9]
    out += [" ".join(rng.choice(list("abc")[: int(rng.integers(1, 4))], int(rng.integers(10, 120)))) for _ in range(60)]
    out += [" ".join((list(rng.choice(list("abcdefgh"), 40)) * 3)[: int(rng.integers(80, 120))] + list(rng.choice(list("pqrstuvwxyz"), 60))) for _ in range(20)]
    unit = [f"u{k}" for k in range(700)]
    out.append(" ".join(f"w{k}" for k in rng.integers(0, 900, 3000)) + " " + " ".join(unit * 3))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    made = [(k, t, "mine", "too") for k, t in enumerate(texts())]
    return spark.createDataFrame([*made, made[6], (None, "z " * 20, None, None)], DDL).repartition(3)


def test_runs_of_random_texts(docs):
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == docs.count()
    for r, t in zip(sorted((r for r in got if r["doc_id"] is not None), key=lambda r: r["doc_id"]), sorted([(k, t) for k, t in enumerate(texts())] + [(6, texts()[6])], key=lambda x: x[0]), strict=True):
        w = words_of(t[1])
        want = brute(w)
        assert (r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) == (t[0], len(w), want)
        assert r["collapsed"] == (None if t[1] is None else collapsed(w, want))
    assert [tuple(x) for x in next(r for r in got if r["doc_id"] is None)["runs"]] == [(0, 20, 1)]


def test_other_least_lengths(docs):
    few = docs.where("doc_id between 11 and 40")
    for least in (2, 5, 20):
        got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.periodic_runs(few, least=least).collect()}
        assert got == {k: brute(words_of(texts()[k]), least) for k in got}
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, least=1)


def test_lag_counts_do_not_depend_on_the_threshold(monkeypatch):
    rng = np.random.default_rng(8)
    h = np.concatenate([rng.integers(0, 5, 400), rng.integers(0, 3, 3), np.zeros(0), rng.integers(0, 200, 900)]).astype(np.uint64)
    first = np.array([0, 400, 403, 403, 1303])
    results = []
    for bound in (0.0, 20.0, 1e9):
        monkeypatch.setattr(periodic, "heavy_from", lambda n, b=bound: b)
        results.append([r.tolist() for r in periodic.slice_runs(h, first, 3)])
    assert results[0] == results[1] == results[2] and any(results[0])
    word = rng.integers(0, 4, 300)
    want = [int((word[: 300 - q] == word[q:]).sum()) for q in range(151)]
    assert periodic.heavy_counts(word, np.unique(word)).tolist() == want


def test_a_text_longer_than_a_slice(spark):
    rng = np.random.default_rng(9)
    head = [f"word{k}" for k in rng.zipf(1.5, 300_000) % 50_000]
    unit = [f"u{k}" for k in range(40_000)]
    w = head + unit * 3 + ["tail"]
    got = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(w)), (2, "short")], "doc_id long, text string")).collect()
    long = next(r for r in got if r["doc_id"] == 1)
    assert len(" ".join(w)) > 2 << 20 and (300_000, 120_000, 40_000) in {tuple(x) for x in long["runs"]}
    assert all(x["length"] >= max(12, 2 * x["period"]) and w[x["start"] : x["start"] + x["length"] - x["period"]] == w[x["start"] + x["period"] : x["start"] + x["length"]] for x in long["runs"])


def test_loops_and_query(spark, docs, tmp_path):
    own = docs.where("doc_id is not null").select("doc_id", "text").unionByName(spark.range(1000, 1200).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, int(30 + id % 50)), x -> concat('t', x)))").alias("text")))
    own.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in own.collect()]
    got = sorted(map(tuple, queries.queries()["op12_periodic_runs"](spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)
    want = []
    for k, t in rows:
        w = looped(k, words_of(t))
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        same = collapsed(w, runs)
        want.append((k, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(same.encode()).hexdigest()))
        assert periodic.runs_digest([{"start": s, "length": n, "period": q} for s, n, q in runs]) == want[-1][6]
    assert got == sorted(want, key=str) and sum(r[1] > 0 for r in want if r[0] >= 1000) > 10


def test_empty_table(spark):
    none = spark.createDataFrame([], DDL)
    assert periodic.periodic_runs(none).count() == 0 and periodic.periodic_runs(periodic.looped_texts(none)).count() == 0
