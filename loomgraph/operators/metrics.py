"""Retrieval, answer and rollout metrics. Ordered folds are higher-order functions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.functions.scores import f1 as f1_of

KEY = "sample_id"
TRIPLE = ["head", "relation", "tail"]
CUTOFFS = (50, 100, 200, 400)


def mean_or(value: Column, default: float | None = 0.0) -> Column:
    """Mean of what is there; default (None: null) without rows."""
    return F.avg(value) if default is None else F.coalesce(F.avg(value), F.lit(default))


# retrieval


def triple_recall(ranked: DataFrame, targets: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(sample_id, k, recall): share of a sample's distinct target triples ranked below k; samples without targets are left out."""
    best = ranked.groupBy(KEY, *TRIPLE).agg(F.min("rank").alias("rank"))
    found = targets.select(KEY, *TRIPLE).distinct().join(best, [KEY, *TRIPLE], "left")
    return found.groupBy(KEY).agg(*[F.avg(F.when(F.col("rank") < k, 1.0).otherwise(0.0)).alias(str(k)) for k in cutoffs]).unpivot(KEY, [str(k) for k in cutoffs], "k", "recall").withColumn("k", F.col("k").cast("int"))


def answer_recall(ranked: DataFrame, answers: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(sample_id, k, recall): share of a sample's answers that are an end of a triple ranked below k."""
    ends = ranked.select(KEY, "rank", F.explode(F.array("head", "tail")).alias("answer")).groupBy(KEY, "answer").agg(F.min("rank").alias("rank"))
    found = answers.select(KEY, "answer").distinct().join(ends, [KEY, "answer"], "left")
    return found.groupBy(KEY).agg(*[F.avg(F.when(F.col("rank") < k, 1.0).otherwise(0.0)).alias(str(k)) for k in cutoffs]).unpivot(KEY, [str(k) for k in cutoffs], "k", "recall").withColumn("k", F.col("k").cast("int"))


def recall_table(ranked: DataFrame, answers: DataFrame, shortest: DataFrame, relevant: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(k, ans_recall, shortest_path_triple_recall, relevant_triple_recall): means over the samples with a truth, to 3 places."""
    parts = [("ans_recall", answer_recall(ranked, answers, cutoffs)), ("shortest_path_triple_recall", triple_recall(ranked, shortest, cutoffs)), ("relevant_triple_recall", triple_recall(ranked, relevant, cutoffs))]
    out = None
    for name, rows in parts:
        mean = rows.groupBy("k").agg(F.round(F.avg("recall"), 3).alias(name))
        out = mean if out is None else out.join(mean, "k", "full")
    return out


def full_coverage(ranked: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """(sample_id, full_cov): whether every answer is an end of a triple ranked below k."""
    return answer_recall(ranked, answers, (k,)).select(KEY, F.when(F.col("recall") == 1.0, 1.0).otherwise(0.0).alias("full_cov"))


def rerank_totals(rows: DataFrame) -> DataFrame:
    """(sample_id, positives, shorts): what rerank_metrics needs to know of all rows (sample_id, label, is_shortest), whatever ranks them."""
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    return rows.groupBy(KEY).agg(n(F.col("label") > 0).alias("positives"), n(F.col("is_shortest")).alias("shorts"))


def rerank_metrics(rows: DataFrame, answers: DataFrame, cutoffs: tuple[int, ...] = (50, 100, 200), totals: DataFrame | None = None) -> DataFrame:
    """(k, positive_recall, shortest_recall, mean_label, answer_recall, full_cov) over rows (sample_id, triple, rank, label, is_shortest).

    The rows are read once, for all cutoffs and the ends below the greatest of them: at most two a rank. A sample without rows reaches
    none of its answers, one without answers counts for triples only. totals: of all rows, where these are only those below the greatest cutoff.
    """
    label, short, most = F.col("label") > 0, F.col("is_shortest"), max(cutoffs)
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    sums = [F.struct(n((F.col("rank") < k) & label).alias("positives"), n((F.col("rank") < k) & short).alias("shorts"), F.avg(F.when(F.col("rank") < k, F.col("label"))).alias("mean_label")) for k in cutoffs]
    ends = F.collect_list(F.when(F.col("rank") < most, F.struct("rank", "head", "tail")))
    all_ = [] if totals is not None else [n(label).alias("positives"), n(short).alias("shorts")]
    per = rows.groupBy(KEY).agg(*[c.alias(f"_{i}") for i, c in enumerate(sums)], ends.alias("_ends"), *all_)
    if totals is not None:
        per = per.join(totals.withColumnRenamed(KEY, "_of"), F.col(KEY).eqNullSafe(F.col("_of"))).drop("_of")
    known = answers.groupBy(KEY).agg(F.collect_set(F.struct("answer")).alias("_answers"))  # a null answer is one, which nothing reaches

    def reached(k: int) -> Column:
        below = F.filter("_ends", lambda e: e["rank"] < k)
        nodes = F.concat(F.transform(below, lambda e: e["head"]), F.transform(below, lambda e: e["tail"]))
        hits = F.array_intersect(F.transform("_answers", lambda a: a["answer"]), F.filter(nodes, F.isnotnull))
        return F.when(F.size("_answers") > 0, F.coalesce(F.size(hits), F.lit(0)) / F.size("_answers"))

    both = per.withColumn("_there", F.lit(1)).join(known, KEY, "full")
    share = lambda i, c: F.try_divide(F.col(f"_{i}")[c], F.col(c))
    means = [F.struct(F.lit(k).alias("k"), share(i, "positives").alias("positive_recall"), share(i, "shorts").alias("shortest_recall"), F.col(f"_{i}")["mean_label"].alias("mean_label"), reached(k).alias("recall")) for i, k in enumerate(cutoffs)]
    each = both.select("_there", F.explode(F.array(*means)).alias("m")).select("_there", "m.*")
    full = F.when(F.col("recall").isNotNull(), F.when(F.col("recall") == 1.0, 1.0).otherwise(0.0))
    out = each.groupBy("k").agg(F.count("_there").alias("_n"), *[mean_or(F.col(c)).alias(c) for c in ("positive_recall", "shortest_recall", "mean_label")], F.avg("recall").alias("answer_recall"), F.avg(full).alias("full_cov"))
    return out.where("_n > 0").drop("_n")


def _mixed(beta: float) -> Column:
    return beta * F.col("answer_recall") + (1 - beta) * F.col("full_cov")


#: Metric of a checkpoint by its mode.
TARGET_METRICS: dict[str, Callable[[float], Column]] = {
    "answer_recall": lambda beta: F.col("answer_recall"),
    "full_cov": lambda beta: F.col("full_cov"),
    "mix": _mixed,
}


def target_metric(metrics: DataFrame, mode: str = "answer_recall", k: int = 200, beta: float = 0.5) -> DataFrame:
    """The one value that picks a checkpoint; a missing metric falls back to answer recall, then positive recall."""
    if mode not in TARGET_METRICS:
        raise ValueError(f"unknown metric {mode!r}")
    return metrics.where(F.col("k") == k).select("k", F.coalesce(TARGET_METRICS[mode](beta), "answer_recall", "positive_recall").alias("target"))


def relevant_statistics(labels: DataFrame) -> DataFrame:
    """Median, mean and greatest number of relevant triples a sample, cut to integers."""
    n = labels.groupBy(KEY).agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("n"))
    return n.agg(F.percentile("n", F.lit(0.5)).cast("int").alias("median_relevant"), F.avg("n").cast("int").alias("mean_relevant"), F.max("n").cast("int").alias("max_relevant"))


def manifest(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """A line a sample: candidates, positives, rows of label 1, whether any is positive, answers."""
    per = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("num_candidates"), F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("num_positive"), F.sum(F.when(F.col("label") == 1.0, 1).otherwise(0)).alias("num_shortest"))
    n = answers.where(text.strip(F.col("answer")) != "").groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    return per.join(n, KEY, "left").select(KEY, "num_candidates", "num_positive", "num_shortest", (F.col("num_positive") > 0).alias("has_positive"), F.greatest(F.lit(1), F.coalesce("_n", F.lit(0))).alias("num_answers"))


def manifest_totals(lines: DataFrame, *by: str) -> DataFrame:
    """Totals of the lines of a manifest, of all or by columns: samples, candidates, positives, samples with positives, and the greatest score difference."""
    diff = [F.max("max_abs_diff").alias("max_abs_diff")] if "max_abs_diff" in lines.columns else []
    return lines.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.sum("num_candidates").alias("candidates"), F.sum("num_positive").alias("positives"), F.count_if("has_positive").alias("with_positives"), *diff)


def answer_count(answers: Column) -> Column:
    return F.greatest(F.lit(1), F.size(text.ensure_list(answers)))


def support_recall(selected: Column, support: Column) -> Column:
    n = F.size(F.array_distinct(support))
    return F.when(n > 0, F.size(F.array_intersect(selected, support)) / n).otherwise(0.0)


def answer_hits(entities: Column, answers: Column) -> Column:
    """Answers, in order, that are among the selected entities."""
    return F.filter(answers, lambda a: F.array_contains(entities, a))


def distinct_gold(path_triples: DataFrame) -> DataFrame:
    """(sample_id, n): distinct complete triples over all paths."""
    whole = path_triples.where((F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != ""))
    return whole.groupBy(KEY).agg(F.count_distinct(*TRIPLE).alias("n"))


# answers


def _prepared(lines: Column) -> Column:
    """Lines, longest first and stable, with what the matches compare."""
    keyed = F.transform(lines, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), text.normalize(x).alias("whole"), text.normalize(text.after_marker(x)).alias("after")))
    return F.array_sort(keyed)


def greedy_matches(lines: Column, answers: Column, double_check: Column) -> Column:
    """Number of answers that take a line each: answers in order, each the first line left that matches."""
    norm = F.transform(answers, text.normalize)
    start = F.struct(_prepared(lines).alias("left"), F.lit(0).alias("matched"))

    def step(state: Column, a: Column) -> Column:
        hits = F.transform(state["left"], lambda p: F.contains(p["whole"], a) | (double_check & (F.contains(a, p["after"]) | F.contains(a, p["whole"]))))
        at = F.array_position(hits, F.lit(True)).cast("int")
        return F.struct(F.filter(state["left"], lambda p, i: i + 1 != at).alias("left"), (state["matched"] + F.when(at > 0, 1).otherwise(0)).alias("matched"))

    return F.aggregate(norm, start, step, lambda s: s["matched"])


def _line_hits(line: Column, answers: Column, double_check: Column) -> Column:
    whole, after = text.normalize(line), text.normalize(text.after_marker(line))
    return F.exists(answers, lambda a: F.contains(whole, text.normalize(a)) | (double_check & F.contains(text.normalize(a), after)))


def score_predictions(rows: DataFrame) -> DataFrame:
    """rows (id, question, ground_truth, prediction) with lines, answers, matches, precision, recall, f1, hits and flags."""
    out = rows.withColumn("lines", text.answer_lines(F.col("prediction"))).withColumn("answers", text.order_answers(F.col("ground_truth"), F.col("question"))).withColumn("double_check", text.needs_double_check(F.col("question")))
    out = out.withColumn("matched", greedy_matches(F.col("lines"), F.col("answers"), F.col("double_check")))
    n, m = F.size("lines"), F.size("answers")
    out = out.withColumn("precision", F.when(n > 0, F.col("matched") / n).otherwise(0.0)).withColumn("recall", F.when(m > 0, F.col("matched") / m).otherwise(0.0)).withColumn("f1", f1_of(F.col("precision"), F.col("recall")))
    hit = F.when(n > 0, _line_hits(F.get("lines", F.lit(0)), F.col("answers"), F.col("double_check"))).otherwise(False)
    return out.select(
        "*", hit.cast("int").alias("hit"), F.exists("lines", lambda x: _line_hits(x, F.col("answers"), F.col("double_check"))).cast("int").alias("hit_any"),
        n.alias("num_predictions"), m.alias("num_gold"), (F.col("f1") == 1.0).cast("double").alias("exact_match"), (F.col("recall") == 0.0).cast("double").alias("totally_wrong"),
        text.no_answer(F.col("prediction")).alias("no_answer"),
    )


def report(scored: DataFrame) -> DataFrame:
    """One row: macro means in percent, micro precision, recall and F1 of the sums (null without predictions), share without answer."""
    p, r = F.try_divide(F.sum("matched"), F.sum("num_predictions")), F.try_divide(F.sum("matched"), F.sum("num_gold"))
    macro = [(100 * F.avg(c)).alias(f"macro_{c}") for c in ("hit", "hit_any", "f1", "precision", "recall", "exact_match", "totally_wrong")]
    return scored.agg(*macro, p.alias("micro_precision"), r.alias("micro_recall"), F.count(F.lit(1)).alias("n"), F.avg(F.col("no_answer").cast("double")).alias("no_answer_share")).withColumn("micro_f1", F.try_divide(2 * F.col("micro_precision") * F.col("micro_recall"), F.col("micro_precision") + F.col("micro_recall")))


def select_samples(rows: DataFrame, hops: int = -1, subset: bool = False, bad: bool = False) -> DataFrame:
    """rows (max_path_length, a_entity_in_graph): 3 hops means 3 or more, other positive numbers exactly that; answerable or not."""
    if subset and bad:
        raise ValueError("subset and bad exclude each other")
    if hops > 0:
        rows = rows.where(F.col("max_path_length") >= 3 if hops == 3 else F.col("max_path_length") == hops)
    has = F.size(F.coalesce("a_entity_in_graph", F.array().cast("array<string>"))) > 0
    return rows.where(has) if subset else rows.where(~has) if bad else rows


def legacy_hit(prediction: Column, answers: Column, double_check: Column) -> Column:
    """Any ``ans:`` line against any answer; without ``ans:`` the raw text, and its lines in the other direction."""
    by_line = F.exists(text.answer_lines(prediction), lambda x: _line_hits(x, answers, double_check))
    raw = text.normalize(prediction)
    whole = F.exists(answers, lambda a: F.contains(raw, text.normalize(a)) | (double_check & F.exists(F.split(prediction, "\n"), lambda x: F.contains(text.normalize(a), text.normalize(x)))))
    return F.when(F.contains(prediction, F.lit("ans:")), by_line).otherwise(whole).cast("int")


def legacy_f1(prediction: Column, answers: Column, double_check: Column) -> tuple[Column, Column, Column]:
    """f1, precision, recall of answers found anywhere in the text; precision counts all its lines."""
    raw = text.normalize(prediction)
    start = F.struct(F.transform(text.answer_lines(prediction), lambda x: text.normalize(text.after_marker(x))).alias("left"), F.lit(0).alias("matched"))

    def step(state: Column, a: Column) -> Column:
        at = F.when(double_check & ~F.contains(raw, a), F.array_position(F.transform(state["left"], lambda p: F.contains(a, p)), F.lit(True)).cast("int")).otherwise(0)
        hit = F.contains(raw, a) | (at > 0)
        return F.struct(F.filter(state["left"], lambda p, i: i + 1 != at).alias("left"), (state["matched"] + hit.cast("int")).alias("matched"))

    matched = F.aggregate(F.transform(answers, text.normalize), start, step, lambda s: s["matched"])
    p, r = matched / F.size(F.split(prediction, "\n")), F.when(F.size(answers) > 0, matched / F.size(answers)).otherwise(0.0)
    return f1_of(p, r), p, r


def legacy_accuracy(prediction: Column, answers: Column) -> Column:
    raw = text.normalize(prediction)
    return F.when(F.size(answers) > 0, F.size(F.filter(answers, lambda a: F.contains(raw, text.normalize(a)))) / F.size(answers)).otherwise(0.0)


def hallucination(lines: Column, answers: Column, double_check: Column, answerable: Column, without: Column, entities: Column) -> Column:
    """Struct of score and counters of one sample.

    Answerable: 1 for a line that takes an answer, -1 else, 0 without an
    answer. Unanswerable: 1 for none, -1 for a line in the subgraph, -1.5
    outside. The sum is divided by the lines.
    """
    prepared = F.transform(lines, lambda x: F.struct(text.normalize(x).alias("whole"), text.normalize(text.after_marker(x)).alias("after"), text.in_subgraph(x, entities).alias("inside")))
    names = ("g_c", "g_w", "g_c_in_graph", "g_c_out_graph", "g_w_in_graph", "g_w_out_graph", "b_in_graph", "b_out_graph_c", "b_out_graph_w")
    start = F.struct(F.transform(answers, text.normalize).alias("left"), *[F.lit(0).alias(n) for n in names])

    def step(state: Column, p: Column) -> Column:
        hits = F.transform(state["left"], lambda a: F.contains(p["whole"], a) | (double_check & (F.contains(a, p["after"]) | F.contains(a, p["whole"]))))
        at = F.when(answerable | ~p["inside"], F.array_position(hits, F.lit(True)).cast("int")).otherwise(0)
        hit, inside = at > 0, p["inside"]
        flags = {
            "g_c": answerable & hit, "g_w": answerable & ~hit, "g_c_in_graph": answerable & hit & inside, "g_c_out_graph": answerable & hit & ~inside, "g_w_in_graph": answerable & ~hit & inside,
            "g_w_out_graph": answerable & ~hit & ~inside, "b_in_graph": ~answerable & inside, "b_out_graph_c": ~answerable & ~inside & hit, "b_out_graph_w": ~answerable & ~inside & ~hit,
        }
        return F.struct(F.filter(state["left"], lambda a, i: i + 1 != at).alias("left"), *[(state[n] + flags[n].cast("int")).alias(n) for n in names])

    def finish(s: Column) -> Column:
        total = F.when(answerable, s["g_c"] - s["g_w"]).otherwise(-1.0 * s["b_in_graph"] - 1.5 * (s["b_out_graph_c"] + s["b_out_graph_w"]))
        score = F.when(without, F.when(answerable, 0.0).otherwise(1.0)).otherwise(F.coalesce(F.try_divide(total, F.size(lines)), F.lit(0.0)))
        return F.struct(score.alias("score"), *[F.when(without, 0).otherwise(s[n]).alias(n) for n in names], (answerable & without).cast("int").alias("g_no_ans"), (~answerable & without).cast("int").alias("b_no_ans"))

    return F.aggregate(prepared, start, step, finish)


def rescaled(score: Column) -> Column:
    """Hallucination score from [-1.5, 1] to percent."""
    return (score + 1.5) / 2.5 * 100


# rollouts and logs


def by_sample(log: DataFrame) -> DataFrame:
    """log (sample_id, trajectory_id, line_no, step, f1, diagnosis, question), one row a sample; rows with neither id are ignored."""
    rows = log.withColumn(KEY, F.coalesce(F.nullif(F.col(KEY), F.lit("")), F.nullif(F.col("trajectory_id"), F.lit("")))).where(F.col(KEY).isNotNull())
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "question")))
    return rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_rollouts"), F.avg("f1").alias("mean_f1"), F.avg(F.when(F.col("f1") <= 0, 1.0).otherwise(0.0)).alias("zero_frac"),
        F.array_sort(F.collect_set("diagnosis")).alias("diagnoses"), F.array_distinct(F.transform(ordered, lambda s: s["question"])).alias("questions"), F.array_sort(F.collect_set("step")).alias("steps"),
    )


#: Rules for bad samples.
BAD_RULES: dict[str, Callable[[float, float], Column]] = {
    "all_rollouts_zero": lambda mean, share: F.col("zero_frac") == 1.0,
    "mean_f1_below": lambda mean, share: F.col("mean_f1") <= mean,
    "high_zero_frac": lambda mean, share: F.col("zero_frac") >= share,
}


def bad_samples(samples: DataFrame, rule: str, min_rollouts: int = 1, max_mean_f1: float = 0.0, min_zero_frac: float = 1.0, diagnoses: tuple[str, ...] = ()) -> DataFrame:
    """Samples that a rule finds; with diagnoses, only those that show one of them. Order: mean_f1, -n_rollouts, id."""
    if rule not in BAD_RULES:
        raise ValueError(f"unknown rule {rule!r}")
    out = samples.where((F.col("n_rollouts") >= min_rollouts) & BAD_RULES[rule](max_mean_f1, min_zero_frac))
    if diagnoses:
        out = out.where(F.arrays_overlap("diagnoses", F.array(*[F.lit(d) for d in diagnoses])))
    return out.withColumn("place", F.struct(F.col("mean_f1"), -F.col("n_rollouts"), F.col(KEY)))


def drop_reason(retrieval: Column, union_reason: Column, question: Column, triples: Column, answers: Column) -> Column:
    """Why a sample is dropped, by the first that holds; null if it is kept.

    retrieval: whether there is a result; union_reason: why gold paths can't be
    put among the candidates (null if they can); triples: their number.
    """
    return (
        F.when(~F.coalesce(retrieval, F.lit(False)), "missing_kgqa_retrieval").when(union_reason.isNotNull(), F.coalesce(F.nullif(union_reason, F.lit("")), F.lit("invalid_gold_union")))
        .when(text.safe_text(question) == "", "missing_question").when(F.coalesce(triples, F.lit(0)) == 0, "missing_triples").when(F.size(text.ensure_list(answers)) == 0, "missing_answers")
    )


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def observed_counts(rows: DataFrame, reasons: tuple[str, ...], reason: str = "reason") -> tuple[DataFrame, Observation]:
    """rows, and the numbers of each known reason, of other ones and of none, counted by whatever job first takes all rows.

    No second job reads the input. Read the observation only after such a job.
    """
    seen = Observation()
    of = F.col(reason)
    counts = [F.count_if(of == r).alias(r) for r in reasons]
    return rows.observe(seen, *counts, F.count_if(of.isNotNull() & ~of.isin(*reasons)).alias("other"), F.count_if(of.isNull()).alias("kept"), F.count(F.lit(1)).alias("all")), seen


def length_statistics(rows: DataFrame, length: str, by: str, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Least, mean, greatest and linear percentiles of a length."""
    return rows.groupBy(by).agg(F.min(length).alias("least"), F.avg(length).alias("mean"), F.max(length).alias("most"), *[F.percentile(length, F.lit(p)).alias(f"p{int(100 * p)}") for p in shares])
