"""Rows kept a component where ids repeat or are missing."""

from collections import Counter

from loomgraph.llm import jaccard


def test_one_row_of_a_component_stays(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(12)) for x in "abcd")
    rows = [(1, a), (2, a), (None, a), (3, b), (3, b), (3, b), (4, c), (1, c), (None, d), (None, d), (5, a), (5, "e"), (6, ""), (6, ""), (None, None)]
    docs = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter([(1, a), (3, b), (1, c), (None, d), (5, "e"), (6, ""), (6, ""), (None, None)])


def test_distinct_ids_keep_the_smallest(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(12)) for x in "ab")
    docs = spark.createDataFrame([(3, a), (2, a), (7, b), (1, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in jaccard.keep_one(docs).collect()) == [(1, ""), (2, a), (7, b)]
