"""Ranking, deduplication, budgets, injection and selection, per sample; every order names its tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.containment import contained
from loomgraph.sources.storage import laid

KEY = "sample_id"
TRIPLE = ["head", "relation", "tail"]


def rank_by_score(rows: DataFrame, score: str = "score", tie: str = "triple_id", name: str = "rank") -> DataFrame:
    """0-based position by descending score."""
    order = W.partitionBy(KEY).orderBy(F.col(score).desc(), F.col(tie))
    return rows.withColumn(name, (F.row_number().over(order) - 1).cast("int"))


def best_by_score(rows: DataFrame, k: int, score: str = "score", tie: str = "triple_id", name: str = "rank") -> DataFrame:
    """The k first of rank_by_score; a number alone is compared with k, so that each task cuts its rows to the k best of a sample before they are dealt."""
    order = W.partitionBy(KEY).orderBy(F.col(score).desc(), F.col(tie))
    best = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return best.withColumn(name, (F.col("_n") - 1).cast("int")).drop("_n")


def rank_share(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """1 - rank / (n - 1); 1 where a sample has one row."""
    n = F.count(F.lit(1)).over(W.partitionBy(KEY))
    return rows.withColumn("rank_norm", F.when(n == 1, 1.0).otherwise(1.0 - F.col(rank) / (n - 1)))


def top_distinct(rows: DataFrame, k: int, score: str = "score", tie: str = "triple_id") -> DataFrame:
    """The best row of each distinct triple, then the k best of each sample; rank from 0.

    The best row of a triple is an aggregate with map-side combine, so that the
    window sees distinct triples only.
    """
    best = rows.groupBy(KEY, *TRIPLE).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (KEY, *TRIPLE)]), F.struct(F.col(score), -F.col(tie))).alias("_r"))
    best = best.select(KEY, *TRIPLE, "_r.*")
    return rank_by_score(best, score, tie).where(F.col("rank") < k)


def first_distinct(rows: DataFrame, k: int, order: str = "triple_id") -> DataFrame:
    """The first k distinct triples in the given order, with idx from 1."""
    first = rows.groupBy(KEY, *TRIPLE).agg(F.min(order).alias(order))
    return first.withColumn("idx", F.row_number().over(W.partitionBy(KEY).orderBy(order)).cast("int")).where(F.col("idx") <= k)


def drop_same_ends(rows: DataFrame, rank: str = "rank", within: tuple[str, ...] = ()) -> DataFrame:
    """The first triple of each unordered pair of ends, of a sample or of each of its lists."""
    kept = F.struct(*[c for c in rows.columns if c not in (KEY, *within)])
    return rows.groupBy(KEY, *within, F.least("head", "tail").alias("_a"), F.greatest("head", "tail").alias("_b")).agg(F.min_by(kept, rank).alias("_r")).select(KEY, *within, "_r.*")


def prefix_budget(path_triples: DataFrame, k: int) -> DataFrame:
    """(sample_id, path, reason): the paths of (sample_id, path, head, relation, tail) that are kept within k distinct triples.

    All paths if their union fits; else paths in order, empty and oversized ones
    skipped, up to the first that would overflow.
    """
    triples = path_triples.select(KEY, "path", *TRIPLE).distinct()
    size = F.count(F.lit(1)).over(W.partitionBy(KEY, "path"))
    triples = triples.withColumn("size", size)
    total = triples.select(KEY, *TRIPLE).distinct().groupBy(KEY).agg(F.count(F.lit(1)).alias("total"))
    # a triple counts with the first of the paths that are not oversized
    fitting = triples.where(F.col("size") <= k)
    firsts = fitting.groupBy(KEY, *TRIPLE).agg(F.min("path").alias("path")).groupBy(KEY, "path").agg(F.count(F.lit(1)).alias("new"))
    steps = fitting.select(KEY, "path").distinct().join(firsts, [KEY, "path"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    running = W.partitionBy(KEY).orderBy("path").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = steps.withColumn("union", F.sum("new").over(running)).where(F.col("union") <= k).join(total, KEY)
    within = triples.select(KEY, "path").distinct().join(total.where(F.col("total") <= k), KEY).select(KEY, "path", F.lit("all_paths_within_budget").alias("reason"))
    return within.unionByName(steps.where(F.col("total") > k).select(KEY, "path", F.lit("prefix_paths_within_budget").alias("reason")))


def inject_gold(candidates: DataFrame, gold: DataFrame, from_back: bool = False) -> DataFrame:
    """Candidates (sample_id, idx, triple) with missing gold triples written over the first (or last) slots without gold.

    ok is false, and nothing is replaced, where a sample has too few slots.
    """
    gold = gold.select(KEY, *TRIPLE).distinct()
    missing = gold.join(candidates, [KEY, *TRIPLE], "left_anti").withColumn("n", F.row_number().over(W.partitionBy(KEY).orderBy(*TRIPLE)))
    slot = F.col("idx").desc() if from_back else F.col("idx")
    free = candidates.join(gold, [KEY, *TRIPLE], "left_anti").select(KEY, "idx", F.row_number().over(W.partitionBy(KEY).orderBy(slot)).alias("n"))
    need = missing.groupBy(KEY).agg(F.max("n").alias("need")).join(free.groupBy(KEY).agg(F.max("n").alias("have")), KEY, "left")
    bad = need.where(F.col("need") > F.coalesce("have", F.lit(0))).select(KEY, F.lit(False).alias("ok"))
    swaps = missing.join(free, [KEY, "n"]).select(KEY, "idx", *[F.col(c).alias(f"new_{c}") for c in TRIPLE])
    out = candidates.join(swaps, [KEY, "idx"], "left").join(bad, KEY, "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    replaced = F.col("ok") & F.col("new_head").isNotNull()
    return out.select(KEY, "idx", *[F.when(replaced, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in TRIPLE], replaced.alias("injected"), "ok")


def pairwise_examples(rows: DataFrame, max_pos: int = 32, max_neg: int = 32, min_topic_distance: int = 1, hard_top_k: int = 50, hard_share: float = 0.1, mid: tuple[int, int] | None = (49, 249), keep: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, triple_id, side, place), and columns to keep, of the positives and hard negatives for pairwise learning.

    rows: sample_id, triple_id (0-based position), label, is_bridge,
    topic_distance (least of the four), rank_norm. Positives are label 1 and
    bridges near a topic, topped up by the best-ranked bridges where they are
    few; negatives are label 0 in the middle band first, then at the top.
    """
    own = W.partitionBy(KEY)
    n, bridges = F.count(F.lit(1)).over(own), F.sum(F.col("is_bridge").cast("int")).over(own)
    near = (F.col("label") == 1.0) | (F.col("is_bridge") & (F.col("topic_distance") <= min_topic_distance))
    rows = rows.withColumn("near", near).withColumn("n", n).withColumn("bridges", bridges)
    rows = rows.withColumn("few", F.sum(F.col("near").cast("int")).over(own) < F.least("bridges", F.lit(max_pos)))
    place = F.row_number().over(own.orderBy(F.col("rank_norm").desc(), "triple_id"))
    bridge_place = F.row_number().over(W.partitionBy(KEY, "is_bridge").orderBy(F.col("rank_norm").desc(), "triple_id"))
    rows = rows.withColumn("place", place).withColumn("bridge_place", bridge_place)
    positive = F.col("near") | (F.col("few") & F.col("is_bridge") & (F.col("bridge_place") <= max_pos))
    hard = F.least(F.lit(hard_top_k), F.greatest(F.lit(1), F.floor(F.col("n") * hard_share)))
    top = F.col("place") <= hard
    inside = F.lit(False)
    if mid:
        low, high = (F.least(F.lit(m), F.col("n") - 1) for m in mid)
        inside = F.col("triple_id").between(low, high)
    # both sides are numbered in one pass over the rows
    negative = (F.col("label") == 0.0) & (inside | top)
    rows = rows.withColumns({"_pos": F.coalesce(positive, F.lit(False)), "_neg": F.coalesce(negative, F.lit(False)), "band": F.when(inside, 0).otherwise(1)})
    rows = rows.withColumn("_pos_place", F.row_number().over(W.partitionBy(KEY, "_pos").orderBy("triple_id"))).withColumn("_neg_place", F.row_number().over(W.partitionBy(KEY, "_neg").orderBy("band", "triple_id")))
    side = lambda name, most: F.struct(F.lit(name).alias("side"), F.col(f"_{name}_place").alias("place"), (F.col(f"_{name}") & (F.col(f"_{name}_place") <= most)).alias("taken"))
    taken = F.filter(F.array(side("pos", max_pos), side("neg", max_neg)), lambda s: s["taken"])
    return rows.where("_pos or _neg").select(KEY, "triple_id", *keep, F.explode(taken).alias("s")).select(KEY, "triple_id", "s.side", "s.place", *keep)


def prefix_states(trajectories: DataFrame, stop_copies: int = 1) -> DataFrame:
    """(sample_id, state, action, copies): every prefix of gold_path_indices, equal states pooled, with their next actions.

    Actions are triple ids in ascending order, then STOP; STOP is written stop_copies times.
    """
    g = F.col("gold_path_indices")
    steps = trajectories.select(KEY, g, F.explode(F.sequence(F.lit(0), F.size(g))).alias("n"))
    state = F.slice("gold_path_indices", F.lit(1), F.col("n"))
    action = F.when(F.col("n") < F.size(g), F.get(g, F.col("n")).cast("string")).otherwise(F.lit("STOP"))
    pooled = steps.select(KEY, F.array_join(F.transform(state, lambda x: x.cast("string")), ",").alias("state"), action.alias("action")).distinct()
    return pooled.withColumn("copies", F.when(F.col("action") == "STOP", stop_copies).otherwise(1))


def first_over(rows: DataFrame, value: str, budget: float, order: str = "step") -> DataFrame:
    """(sample_id, first_over): the first step at which the running sum passes the budget; null if none does."""
    running = F.sum(value).over(W.partitionBy(KEY).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_sum", running).groupBy(KEY).agg(F.min(F.when(F.col("_sum") > budget, F.col(order))).alias("first_over"))


def rebuilt_scores(selected: DataFrame, pool: DataFrame, k: int = 200) -> DataFrame:
    """(sample_id, rank, triple, hop, score): selected triples first, then the pool, deduplicated and cut at k.

    Selected: max(1 - .001 rank, .9); pool: its own score, else max(.5 - .001 rank, 0); hop 1 where the pool lacks the triple.
    """
    chosen = selected.groupBy(KEY, *TRIPLE).agg(F.min("place").alias("place")).withColumn("group", F.lit(0))
    first = pool.groupBy(KEY, *TRIPLE).agg(F.min_by(F.struct("hop", "score"), "place").alias("own"), F.min("place").alias("place"))
    rest = first.join(chosen, [KEY, *TRIPLE], "left_anti").select(KEY, *TRIPLE, "place", F.lit(1).alias("group"))
    rows = chosen.select(KEY, *TRIPLE, "place", "group").unionByName(rest).withColumn("rank", (F.row_number().over(W.partitionBy(KEY).orderBy("group", "place")) - 1).cast("int")).where(F.col("rank") < k)
    rows = rows.join(first.select(KEY, *TRIPLE, "own"), [KEY, *TRIPLE], "left")
    score = F.when(F.col("group") == 0, F.greatest(1.0 - F.col("rank") * 0.001, F.lit(0.9))).otherwise(F.coalesce("own.score", F.greatest(0.5 - 0.001 * F.col("rank"), F.lit(0.0))))
    return rows.select(KEY, "rank", *TRIPLE, F.when(F.col("own").isNull(), 1).otherwise(F.col("own.hop")).alias("hop"), score.alias("score"))


def rollout_union(rollouts: DataFrame) -> DataFrame:
    """(sample_id, idx, place): triple ids over all rollouts, each at its first place by (rollout, step)."""
    first = rollouts.groupBy(KEY, "idx").agg(F.min(F.struct("rollout", "step")).alias("at"))
    return first.select(KEY, "idx", F.row_number().over(W.partitionBy(KEY).orderBy("at")).cast("int").alias("place"))


def merge_group(rows: DataFrame, side: str = "head", order: str = "rank") -> DataFrame:
    """Triples merged over equal (relation, tail), or (head, relation): ``[a,b]`` in order; place is the first member's."""
    keys = [c for c in TRIPLE if c != side]
    merged = rows.groupBy(KEY, *keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(side).alias("v")))).alias("m"))
    text = F.concat(F.lit("["), F.array_join(F.transform("m", lambda s: s["v"]), ","), F.lit("]"))
    return merged.select(KEY, text.alias(side), *keys, F.get("m", F.lit(0))["o"].alias("place")).select(KEY, *TRIPLE, "place")


def seeded_sample(rows: DataFrame, k: int, seed: int, tie: str = "triple_id", without: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """k rows of each sample by the order of a hash of seed and row; without: drops triples whose end holds an answer. parts: rows lie by sample in so many."""
    if without is not None:
        ends = rows.select(KEY, F.explode(F.array("head", "tail")).alias("text")).distinct().withColumn("id", F.col("text"))
        held = contained(ends, without.select(KEY, F.col("answer").alias("pattern")), [KEY], pairs=False)
        held = laid(held.repartition(parts, KEY), KEY, parts)[0] if parts else held
        for end in ("head", "tail"):
            rows = rows.join(held.select(KEY, F.col("id").alias(end)).hint("shuffle_hash"), [KEY, end], "left_anti")  # few ends hold an answer
    order = W.partitionBy(KEY).orderBy(F.xxhash64(F.lit(seed), *TRIPLE), tie)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def frequent(rows: DataFrame, value: str, k: int, order: str = "triple_id") -> DataFrame:
    """The k most frequent values of each sample; ties by first appearance."""
    counts = rows.groupBy(KEY, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(KEY).orderBy(F.col("n").desc(), "first")).cast("int")).where(F.col("place") <= k)


def limit_in_order(rows: DataFrame, n: int | None, *order: str | Column) -> DataFrame:
    return rows if n is None else rows.orderBy(*order).limit(n)
