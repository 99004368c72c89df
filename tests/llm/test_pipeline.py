"""The pipeline on the smallest tables, each stage against its operator's decisions."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from loomgraph.llm import blocks, decontaminate, jaccard, queries
from loomgraph.llm.queries import op4_compaction


def test_stages(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after, _ = blocks.stored(stage(spark, docs, data_dir), name)
        if name == "packing":
            assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert after.columns == names and 0 < after.count() <= docs.count()
        if name == "near copies":
            found = jaccard.jaccard_components(docs)
            assert after.count() == found.where("doc_id = component_id").count()
        if name == "decontamination":
            bench = spark.read.parquet(f"{data_dir}/benchmark.parquet")
            assert decontaminate.find_matches(after, bench).where("n_hit > 0").count() == 0
        docs = after


def test_registry():
    assert len(corpus_pipeline.STAGES) == 5 and sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_compaction_query(spark, data_dir):
    assert op4_compaction(spark, data_dir).count() == spark.read.parquet(f"{data_dir}/documents.parquet").count()


def _odd(spark, data_dir):
    """Documents with nulls, repeats, ties, copies, empty and very long texts, and columns named like those that stages use."""
    known = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text", "lang").collect()][:60]
    rng = random.Random(4)
    words = [w for _, t, _ in known[:5] for w in (t or "").split()]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [*known, known[3], known[3], (known[4][0], known[5][1], known[4][2]), (None, known[6][1], "en"), (None, None, None), (9001, None, "en"), (9002, "", "en"), (9003, " \t", None), (9004, "1 2 3 4", "en"), (9005, long, "en"), (9006, long, "en"), (9007, "ok", "en"), (None, "tiny note", None), (None, "tiny note", None)]
    names = "doc_id long, text string, lang string, _class long, class string, component long, score double, part string, place int, block int, _id int, spans array<int>"
    return spark.createDataFrame([(*r, 7, "c", 1, 0.5, None, 2, None, k, [k]) for k, r in enumerate(rows)], names)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, data_dir, name, stage):
    docs = _odd(spark, data_dir)
    docs, _ = blocks.stored(docs.repartition(3), "odd")
    key = lambda r: (r["_id"], r["doc_id"], r["text"])
    before = Counter(key(r) for r in docs.collect())
    empty = stage(spark, docs.where("false"), data_dir)
    assert empty.count() == 0
    after = stage(spark, docs, data_dir)
    if name == "packing":
        got = [(r["doc_id"], r["piece"], r["start"], r["length"]) for r in after.collect()]
        assert sum(1 for r in got if r[1] == 0) == sum(before.values()) and all(0 < r[3] <= 4096 for r in got)
        return
    assert after.columns == docs.columns and empty.columns == docs.columns
    left = Counter(key(r) for r in after.collect())
    assert not left - before
    texts = {t for _, _, t in before}
    if name == "language":
        assert all(t is not None and any(c.isalpha() for c in t) for _, _, t in left)
        assert {t for _, _, t in left} == {t for t in texts if t and any(c.isalpha() for c in t)}
    if name == "near copies":
        assert len([1 for _, _, t in left if t is None]) == 2 and len([1 for _, d, _ in left if d in (9002, 9003)]) == 2
        assert Counter(t for _, _, t in left if t and t.strip()).most_common(1)[0][1] == 1 and 9006 not in {d for _, d, _ in left}
    if name in ("toxicity", "decontamination"):
        gone = {t for _, _, t in before - left}
        assert not gone & {t for _, _, t in left} and None not in gone and "" not in gone and "ok" not in gone
