"""Joins of retrieval results, labels, evidence and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.scores import LABELS

KEY = "sample_id"
TRIPLE = ["head", "relation", "tail"]


def beside(rows: DataFrame, table: DataFrame, *on: str) -> DataFrame:
    """rows with the other columns of the one row of table that has their sample and columns ``on``; null where there is none."""
    keys = [KEY, *on]
    return rows.join(table, keys, "left").select(*rows.columns, *[c for c in table.columns if c not in keys])


def _occurrence(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("occurrence", F.row_number().over(W.partitionBy(KEY, *TRIPLE).orderBy(order)))


def align(results: DataFrame, raw: DataFrame, order: str = "rank", raw_order: str = "triple_id", strict: bool = True) -> DataFrame:
    """results with raw_index: the k-th occurrence of a triple meets its k-th raw occurrence.

    Where there is none, reading raw_index is an error; if not strict, it is null.
    """
    left = _occurrence(results, order)
    right = _occurrence(raw.select(KEY, *TRIPLE, raw_order), raw_order).withColumnRenamed(raw_order, "raw_index")
    out = left.join(right, [KEY, *TRIPLE, "occurrence"], "left")
    if not strict:
        return out
    said = F.raise_error(F.concat(F.lit("no raw triple for "), F.to_json(F.struct(KEY, *TRIPLE, "occurrence"))))
    return out.withColumn("raw_index", F.when(F.col("raw_index").isNull(), said.cast("long")).otherwise(F.col("raw_index")).cast(raw.schema[raw_order].dataType))


def alignment_counts(results: DataFrame, raw: DataFrame) -> DataFrame:
    """(sample_id, raw_duplicates, conflicts, candidates): raw occurrences beyond the first, and the raw occurrences that each result leaves unused at its turn."""
    same = raw.groupBy(KEY, *TRIPLE).agg(F.count(F.lit(1)).alias("n"))
    duplicates = same.groupBy(KEY).agg(F.sum(F.col("n") - 1).alias("raw_duplicates"))
    taken = results.groupBy(KEY, *TRIPLE).agg(F.count(F.lit(1)).alias("k")).join(same, [KEY, *TRIPLE], "left")
    # n - 1, n - 2, ... for the 1st, 2nd, ... of k results
    left = F.col("k") * F.col("n") - F.col("k") * (F.col("k") + 1) / 2
    found = taken.groupBy(KEY).agg(F.sum(left).cast("long").alias("conflicts"), F.sum("k").alias("candidates"))
    return found.join(duplicates, KEY, "left")


def label_flags(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """candidates with is_direct, is_bridge, is_weak.

    A label without a kind counts for nothing, unless it is a triple alone
    (boolean column bare, where labels have one): that is a bridge.
    """
    known = labels.where(F.col("head").isNotNull() & F.col("relation").isNotNull() & F.col("tail").isNotNull())
    if "bare" in labels.columns:
        known = known.withColumn("label", F.when(F.col("bare"), "bridge").otherwise(F.col("label")))
    kinds = dict(zip(LABELS, ("is_direct", "is_bridge", "is_weak"), strict=True))
    found = known.where(F.col("label").isin(*kinds)).groupBy(KEY, *TRIPLE).agg(*[F.max(F.col("label") == k).alias(c) for k, c in kinds.items()])
    out = beside(candidates, found, *TRIPLE)
    return out.select(*candidates.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in kinds.values()])


def resolve_ids(gold: DataFrame, inference: DataFrame) -> DataFrame:
    """gold (gold_id, inner_id, question) with resolved and method.

    By id, then inner id, then question text where one inference row has it, or
    where the inner id is among those; else the reason is the method.
    """
    ids = inference.select(F.col("id").alias("_i"))
    questions = inference.where(F.col("question") != "").groupBy("question").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_q"))
    by_id = ids.withColumnRenamed("_i", "_by_id")
    by_inner = ids.withColumnRenamed("_i", "_by_inner")
    out = gold.join(by_id, gold.gold_id == F.col("_by_id"), "left").join(by_inner, F.col("inner_id") == F.col("_by_inner"), "left").join(questions, "question", "left")
    method = (
        F.when(F.col("_by_id").isNotNull(), "sample_id").when(F.col("_by_inner").isNotNull(), "inner_id").when(F.col("_n") == 1, "question")
        .when(F.col("_n") > 1, F.concat(F.lit("ambiguous_question_match:"), F.col("_n").cast("string"))).otherwise("missing_inference_sample")
    )
    resolved = F.coalesce("_by_id", "_by_inner", F.when(F.col("_n") == 1, F.col("_q")))
    return out.select("gold_id", "inner_id", "question", resolved.alias("resolved"), method.alias("method"))


def map_paths(paths: DataFrame, candidates: DataFrame) -> DataFrame:
    """(sample_id, path, indices): the n-th use of a triple within a path takes its n-th smallest idx; null if any misses."""
    use = W.partitionBy(KEY, "path", *TRIPLE).orderBy("place")
    left = paths.withColumn("occurrence", F.row_number().over(use))
    found = left.join(_occurrence(candidates.select(KEY, *TRIPLE, "idx"), "idx"), [KEY, *TRIPLE, "occurrence"], "left")
    rows = found.groupBy(KEY, "path").agg(F.bool_and(F.col("idx").isNotNull()).alias("ok"), F.sort_array(F.collect_list(F.struct("place", "idx"))).alias("p"))
    return rows.select(KEY, "path", F.when(F.col("ok"), F.transform("p", lambda s: s["idx"])).alias("indices"))


def prepend_missing(targets: DataFrame, scored: DataFrame) -> DataFrame:
    """scored (sample_id, triple, rank) with absent targets put before it one by one, so the last comes first; place from 0."""
    missing = targets.join(scored, [KEY, *TRIPLE], "left_anti").select(KEY, *TRIPLE, F.lit(0).alias("group"), (-F.col("place")).alias("o"))
    both = missing.unionByName(scored.select(KEY, *TRIPLE, F.lit(1).alias("group"), F.col("rank").alias("o")))
    return both.select(KEY, *TRIPLE, (F.col("group") == 0).alias("added"), (F.row_number().over(W.partitionBy(KEY).orderBy("group", "o", *TRIPLE)) - 1).cast("int").alias("place"))


def attach_retrieval(samples: DataFrame, triples: DataFrame, mode: str = "strict") -> DataFrame:
    """samples with triples; a sample without any gets a placeholder, is dropped or raises: baseline, gt, strict."""
    if mode not in ("baseline", "gt", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    out = samples.join(triples, KEY, "inner" if mode == "gt" else "left")
    if mode == "strict":
        return out.withColumn("head", F.when(F.col("head").isNull(), F.raise_error(F.concat(F.lit("no retrieval result for "), F.col(KEY).cast("string"))).cast("string")).otherwise(F.col("head")))
    return out.fillna("", TRIPLE)


def evidence(selected: DataFrame, candidates: DataFrame, default: float = 1.0) -> DataFrame:
    """Selected triples, once each and in order, with the greatest score among equal candidates.

    A candidate without a score counts with its original_rank, without that
    with its position, where there are such columns.
    """
    given = [F.col(c).cast("double") for c in ("score", "original_rank", "position") if c in candidates.columns]
    best = candidates.groupBy(KEY, *TRIPLE).agg(F.max(F.coalesce(*given)).alias("score"))
    chosen = selected.groupBy(KEY, *TRIPLE).agg(F.min("place").alias("place"))
    return chosen.join(best, [KEY, *TRIPLE], "left").withColumn("score", F.coalesce("score", F.lit(default)))


def first_match(keys: DataFrame, original: DataFrame, order: str = "rank") -> DataFrame:
    """keys (sample_id, triple) with the first original row of the same triple."""
    rest = [c for c in original.columns if c not in (KEY, *TRIPLE)]
    return keys.join(original.groupBy(KEY, *TRIPLE).agg(F.min_by(F.struct(*rest), order).alias("first")), [KEY, *TRIPLE], "left").select(*keys.columns, "first.*")


def touches_answer(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """candidates with touch: 1 where head or tail is an answer."""
    a = answers.select(KEY, "answer").distinct()
    out = candidates
    for end in ("head", "tail"):
        out = beside(out, a.select(KEY, F.col("answer").alias(end), F.lit(1.0).alias(f"_{end}")).hint("shuffle_hash"), end)  # a sample has few answers
    return out.select(*candidates.columns, F.coalesce("_head", "_tail", F.lit(0.0)).alias("touch"))


def exclude(rows: DataFrame, excluded: DataFrame, column: str, fallback: str | None = None) -> DataFrame:
    """Rows whose id (or, where it is empty, the fallback's) is not excluded."""
    own = F.coalesce(F.nullif(F.col(column), F.lit("")), F.col(fallback)) if fallback else F.col(column)
    return rows.withColumn("_id", own).join(excluded.select(F.col("id").alias("_id")), "_id", "left_anti").drop("_id")


def union_predictions(runs: list[DataFrame]) -> DataFrame:
    """(id, prediction): answer lines of all runs for the ids of the first, once each and in order."""
    out = runs[0].select("id", F.col("prediction").alias("p0"))
    for k, run in enumerate(runs[1:], 1):
        out = out.join(run.select("id", F.col("prediction").alias(f"p{k}")), "id", "left")
    lines = F.flatten(F.array(*[F.filter(F.split(F.coalesce(f"p{k}", F.lit("")), "\n"), lambda x: F.startswith(F.lower(F.trim(x)), F.lit("ans:"))) for k in range(len(runs))]))
    return out.select("id", F.array_join(F.array_distinct(lines), "\n").alias("prediction"))


def checked_positions(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Inner join by id that raises unless every row of both sides has its partner: what a join by position asserts."""
    a, b = left.select(key), right.select(key)
    odd = a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))
    if not odd.isEmpty():
        raise ValueError(f"rows without a partner, such as {odd.first()[0]!r}")
    return left.join(right, key)


def assembled(samples: DataFrame, scores: DataFrame, embedded: DataFrame, skip_no_path: bool = True) -> DataFrame:
    """samples (sample_id, n_entities, q_entity_ids, a_entity, a_entity_ids) that can be trained on.

    Those without an embedding are left out, and (skip_no_path: not in tests) those without a path:
    max_path_length of scores null or 0. Answers are listed once; topic_one_hot has [other, topic] of every
    entity. A sample without scores is an error.
    """
    lost = samples.join(scores.select(KEY), KEY, "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"no triple scores of {lost.first()[KEY]!r}")
    out = samples.join(embedded.select(KEY).distinct(), KEY, "left_semi").join(scores.select(KEY, "max_path_length"), KEY)
    out = out.where(F.coalesce("max_path_length", F.lit(0)) != 0) if skip_no_path else out
    topic = lambda i: F.array_contains("q_entity_ids", i).cast("double")
    places = F.when(F.col("n_entities") > 0, F.sequence(F.lit(0), F.col("n_entities") - 1)).otherwise(F.array().cast("array<int>"))
    hot = F.transform(places, lambda i: F.array(1.0 - topic(i), topic(i)))
    return out.withColumns({"a_entity": F.array_distinct("a_entity"), "a_entity_ids": F.array_distinct("a_entity_ids"), "topic_one_hot": hot})
