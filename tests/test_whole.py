"""Queries over all rows of a sample: the Spark form against the registered SQL with its id cut taken out."""

import hashlib
import math
import os
import re
import string
from collections import Counter
from types import SimpleNamespace

import duckdb
import pytest
from loomgraph.functions import text
from loomgraph.plans import QUERIES
from loomgraph.sources.views import TABLES, with_views
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def oracle(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def uncut(name: str, *cuts: str) -> str:
    sql = QUERIES[name].sql
    for cut in cuts:
        sql = sql.replace(cut, "")
    return sql


def by_key(rows: list, *keys: str) -> dict:
    out = {tuple(r[k] for k in keys): {c: x for c, x in r.items() if c not in keys} for r in rows}
    assert len(out) == len(rows)
    return out


def found(spark, data_dir, name: str) -> list:
    return [r.asDict() for r in QUERIES[name](spark, data_dir).collect()]


def wanted(oracle, sql: str) -> list:
    rows = oracle.execute(sql)
    names = [c[0] for c in rows.description]
    return [dict(zip(names, r, strict=True)) for r in rows.fetchall()]


@pytest.mark.parametrize("name", ["m6_touch_bce", "m7_coverage"])
def test_losses_take_all_triples(spark, data_dir, oracle, name):
    got, want = by_key(found(spark, data_dir, name), "sample_id"), by_key(wanted(oracle, uncut(name, " WHERE triple_id < 400")), "sample_id")
    assert got.keys() == want.keys()
    assert all(got[k]["loss"] == pytest.approx(want[k]["loss"], abs=2e-5) for k in want)


@pytest.fixture(scope="module")
def long_sample(spark):
    """One sample of 450 triples; the answers are touched late only, Z by none."""
    rows = [(1, k, f"h{k % 7}", "r", "X" if k % 50 == 49 and k > 400 else "Y" if k == 430 else f"t{k}", (k % 13 - 6) / 3) for k in range(450)]
    edges = spark.createDataFrame(rows, "sample_id long, triple_id int, head string, relation string, tail string, logit double")
    answers = spark.createDataFrame([(1, "X"), (1, "Y"), (1, "Z")], "sample_id long, answer string")
    return rows, SimpleNamespace(edges=edges, answers=answers)


def test_losses_see_answers_touched_late(long_sample):
    rows, v = long_sample
    softplus = lambda x: math.log1p(math.exp(-abs(x))) + max(x, 0)
    best = {a: max(r[5] for r in rows if r[4] == a) for a in ("X", "Y")}
    got = QUERIES["m7_coverage"].build(v).first()
    assert got["loss"] == pytest.approx(sum(softplus(-x) for x in best.values()), abs=2e-5)
    y = [r[4] in best for r in rows]
    w = min((len(y) - sum(y)) / sum(y), 50)
    mean = sum(w * softplus(-r[5]) if t else softplus(r[5]) for r, t in zip(rows, y, strict=True)) / len(y)
    assert QUERIES["m6_touch_bce"].build(v).first()["loss"] == pytest.approx(mean * 1.2, abs=2e-5)


def test_listwise_ranks_all_triples(spark, data_dir, oracle):
    got, want = by_key(found(spark, data_dir, "m8_listwise"), "sample_id"), by_key(wanted(oracle, uncut("m8_listwise", " WHERE triple_id < 400", " WHERE triple_id < 60")), "sample_id")
    assert got.keys() == want.keys()
    assert all(got[k]["loss"] == pytest.approx(want[k]["loss"], abs=2e-4) for k in want)


def test_pairwise_loss_takes_the_selected_examples(spark, data_dir, oracle):
    logit = {(r["sample_id"], r["triple_id"]): r["logit"] for r in wanted(oracle, with_views("SELECT sample_id, triple_id, logit FROM kg_edge"))}
    sides: dict = {}
    for r in wanted(oracle, QUERIES["f6_pairwise"].sql):
        sides.setdefault(r["sample_id"], {"pos": [], "neg": []})[r["side"]].append(logit[r["sample_id"], r["triple_id"]])
    want = {k: sum(math.log1p(math.exp(n - p)) for p in s["pos"] for n in s["neg"]) / (len(s["pos"]) * len(s["neg"])) for k, s in sides.items() if s["pos"] and s["neg"]}
    got = {r["sample_id"]: r["loss"] for r in found(spark, data_dir, "m9_pairwise")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-5) for k in want)


@pytest.mark.parametrize(
    ("name", "cut", "keys"),
    [
        ("b4_normalised_triples", " WHERE triple_id < 20", ("sample_id", "triple_id")),
        ("b8_selected_rest", " WHERE triple_id < 100", ("sample_id",)),
        ("b12_candidates", "triple_id < 50 AND ", ("sample_id", "idx")),
        ("c14_same_relation", " WHERE triple_id < 100", ("sample_id", "triple_id")),
    ],
)
def test_all_edges_are_taken(spark, data_dir, oracle, name, cut, keys):
    assert by_key(found(spark, data_dir, name), *keys) == by_key(wanted(oracle, uncut(name, cut)), *keys)


def test_prefix_states_of_whole_gold_paths(spark, data_dir, oracle):
    place: dict = {}
    for r in wanted(oracle, with_views("SELECT * FROM kg_edge ORDER BY sample_id, triple_id")):
        own = place.setdefault(r["sample_id"], {})
        own.setdefault((r["head"], r["relation"], r["tail"]), len(own) + 1)
    paths: dict = {}
    for r in wanted(oracle, with_views("SELECT * FROM gold_path ORDER BY sample_id, path, place")):
        paths.setdefault((r["sample_id"], r["path"]), []).append(place[r["sample_id"]][r["head"], r["relation"], r["tail"]])
    want = {(s, ",".join(map(str, ids[:n])), str(ids[n]) if n < len(ids) else "STOP", 1 if n < len(ids) else 2) for (s, _), ids in paths.items() for n in range(len(ids) + 1)}
    got = [(r["sample_id"], r["state"], r["action"], r["copies"]) for r in found(spark, data_dir, "f7_prefix_states")]
    assert len(got) == len(want) and set(got) == want


def test_vector_search_takes_all_stated_queries_and_all_rows(spark, data_dir, oracle):
    rows = {r["vec_id"]: r["embedding"] for r in wanted(oracle, "SELECT vec_id, embedding FROM embeddings")}
    got = by_key(found(spark, data_dir, "h20_vectors"), "q", "item")
    assert got.keys() == {(q, i) for q in rows if q % 20 == 0 for i in rows}
    assert all(r["score"] == pytest.approx(sum(float(x) * float(y) for x, y in zip(rows[q], rows[i], strict=True)), abs=2e-5) for (q, i), r in got.items())


def test_vector_search_broadcasts_nothing(spark, data_dir):
    plan = QUERIES["h20_vectors"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan


def normal(s: str) -> str:
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def md5(s: str) -> str:
    return hashlib.md5(s.encode()).hexdigest()


def test_every_document_is_normalised(spark, data_dir, oracle):
    want = Counter((r["doc_id"], None if r["text"] is None else md5(normal(r["text"]))) for r in wanted(oracle, "SELECT doc_id, text FROM documents"))
    assert Counter((r["doc_id"], r["normal"]) for r in found(spark, data_dir, "h1_normalise")) == want


def test_every_turn_is_stripped(spark, data_dir, oracle):
    plain = lambda s: re.sub(r"<think>.*?</think>", "", s, flags=re.DOTALL).strip()
    want = Counter((r["conv_id"], r["turn"], md5(plain("<think>a\nb</think> " + r["text"]))) for r in wanted(oracle, "SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL"))
    got = Counter((r["conv_id"], r["turn"], r["h"]) for r in found(spark, data_dir, "h7_strip"))
    assert want <= got and all(h == md5("") for _, _, h in (got - want))


def test_texts_of_any_language(spark):
    texts = ["café a theé éa", "“The” ’a’ ań ä", "ΑΣ ΣA a² a_ the中文 a 中", "x the　y z\x85", "\x1c a\x1d​b﻿", "İstanbul THE İ", " x \u0085", "line\r\nthe ", "", " 　 ", "\U0001f600a \U0001d400n the\U0001f600"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", text.normalize(F.col("t")).alias("n"), text.strip(F.col("t")).alias("s"), text.strip_tagged(F.concat(F.lit("<think> </think>"), "t")).alias("g"))
    got = {r["k"]: (r["n"], r["s"], r["g"]) for r in rows.collect()}
    assert [got[k] for k in range(len(texts))] == [(normal(t), t.strip(), t.strip()) for t in texts]
