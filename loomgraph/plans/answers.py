"""Answer, episode, model and prompt queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import scores, text
from loomgraph.operators import containment, episodes, graph, joins, metrics, models, prompts, ranking, rollouts, training, vectors
from loomgraph.plans.registry import query
from loomgraph.plans.retrieval import _DISTINCT, _EXAMPLES, _FIRST, _SCORED, _SOFT, KEY, TRIPLE, pairwise, soft_labelled, soft_rows
from loomgraph.sources import readers, service, storage
from loomgraph.sources.storage import checkpointed, stored
from loomgraph.sources.views import Views

_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def _norm(column: str) -> str:
    return _NORM.format(column)


# --- text


#: White space and word characters of any script, written out since the oracle's own classes are ASCII.
_BLANKS = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_BARE = "regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g')"
# adjacent articles share a separator, hence twice
_ARTICLES = "regexp_replace({0}, '(^|[^\\pL\\pN_])(a|an|the)($|[^\\pL\\pN_])', '\\1 \\3', 'g')"


@query("h1_normalise", "H1", f"SELECT doc_id, md5(trim(regexp_replace({_ARTICLES.format(_ARTICLES.format(_BARE))}, '{_BLANKS}', ' ', 'g'))) AS normal FROM documents")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("normal"))


@query("h2_h4_lines", "H2 H4 H3", "SELECT id, CASE WHEN id % 4 = 3 THEN 0 ELSE count(DISTINCT line) END::BIGINT AS n_lines, id % 4 IN (1, 3) AS none, id % 3 <> 1 AS double_check FROM qa_pred GROUP BY 1")
def _(v: Views) -> DataFrame:
    said = F.array_join(F.collect_list("line"), "\n")
    i = F.col("id")
    p = v.view("qa_pred").groupBy("id").agg(said.alias("said")).withColumn("p", F.when(i % 4 == 3, "I do not know").otherwise(F.concat("said", F.when(i % 4 == 1, "\nAns: Not available").when(i % 4 == 2, "\nANS: X\nans: None").otherwise(""))))
    asked = F.when(i % 3 == 0, "WHEN was it ordered").when(i % 3 == 1, "who ordered it").otherwise("In which Year was it")
    return p.select("id", F.size(text.answer_lines(F.col("p"))).cast("long").alias("n_lines"), text.no_answer(F.col("p")).alias("none"), text.needs_double_check(asked).alias("double_check"))


@query("h5_years", "H5 G1 G2", "WITH x AS (SELECT o_orderkey AS id, unnest([o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus]) AS x, unnest([1, 2, 3]) AS i FROM orders) SELECT id, string_agg(CASE WHEN regexp_matches(x, '^[0-9]+-') THEN split_part(x, '-', 1) ELSE x END, ';' ORDER BY length(x) DESC, i) AS years, string_agg(x, ';' ORDER BY length(x) DESC, i) AS kept FROM x GROUP BY 1")
def _(v: Views) -> DataFrame:
    given = F.array("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", "o_orderstatus")
    asked, other = (text.order_answers(given, F.lit(q)) for q in ("When was it ordered?", "who ordered it"))
    return v.table("orders").select(F.col("o_orderkey").alias("id"), F.array_join(asked, ";").alias("years"), F.array_join(other, ";").alias("kept"))


@query("h6_paths", "H6", "SELECT sample_id, path, max(CASE WHEN place = 0 THEN head END) AS first, max(CASE WHEN place = 1 THEN tail END) AS last, count(*) AS n FROM gold_path GROUP BY 1, 2 HAVING count(*) = 2")
def _(v: Views) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("place", *TRIPLE)))
    rows = v.view("gold_path").groupBy(KEY, "path").agg(ordered.alias("p")).where("size(p) = 2")
    shown = F.concat(F.lit("x <PATH>"), F.concat_ws(" -> ", F.get("p", F.lit(0))["head"], F.get("p", F.lit(0))["relation"], F.get("p", F.lit(0))["tail"], F.get("p", F.lit(1))["relation"], F.get("p", F.lit(1))["tail"]), F.lit("</PATH> y"))
    parsed = rows.withColumn("t", text.reasoning_triples(shown, "<PATH>", "</PATH>"))
    return parsed.select(KEY, "path", F.get("t", F.lit(0))["head"].alias("first"), F.element_at("t", -1)["tail"].alias("last"), F.size("t").cast("long").alias("n"))


@query("h7_strip", "H7", "SELECT conv_id, turn, md5(trim(text)) AS h FROM conversations")
def _(v: Views) -> DataFrame:
    return v.table("conversations").select("conv_id", "turn", F.md5(text.strip_tagged(F.concat(F.lit("<think>a\nb</think> "), "text"))).alias("h"))


@query("h13_format", "H13", "SELECT id, CASE WHEN count(DISTINCT line) = 1 THEN 1.0 WHEN count(DISTINCT line) <= 5 THEN 0.8 ELSE 0.4 END::DOUBLE AS reward FROM qa_pred GROUP BY 1")
def _(v: Views) -> DataFrame:
    p = v.view("qa_pred").groupBy("id").agg(F.array_join(F.collect_list("line"), "\n").alias("p"))
    return p.select("id", text.format_reward(F.col("p"), text.answer_lines(F.col("p"))).alias("reward"))


@query("h14_limits", "H14", "SELECT c_custkey AS id, CAST(floor(least(greatest(1.25 * (c_custkey % 60), 22), 40)) AS INT) AS soft, CAST(greatest(floor(least(greatest(1.8 * (c_custkey % 60), 40), 95)), floor(least(greatest(1.25 * (c_custkey % 60), 22), 40))) AS INT) AS hard FROM customer")
def _(v: Views) -> DataFrame:
    soft, hard = scores.triple_limits(F.lit("webqsp"), (F.col("c_custkey") % 60).cast("int"), F.lit(40), F.lit(95))
    return v.table("customer").select(F.col("c_custkey").alias("id"), soft.alias("soft"), hard.alias("hard"))


@query("h16_fusion", "H16 M12", f"WITH {_SCORED} SELECT sample_id, triple_id, round(0.4 * score + 0.6 / (1 + exp(-logit / 2)), 6) AS fused, round(1 / (1 + exp(-(logit + 0.5 * (logit / 2)))), 6) AS summed FROM scored")
def _(v: Views) -> DataFrame:
    second = F.col("logit") / 2
    return v.scored.select(KEY, "triple_id", F.round(scores.fuse(F.col("score"), second, 0.4, 0.6), 6).alias("fused"), F.round(scores.fuse_logits(F.col("logit"), second, 0.5), 6).alias("summed"))


@query("h17_facets", "H17 E7 E8", "WITH e AS (SELECT sample_id, head AS n FROM gold_path WHERE sample_id % 4 <> 0 OR place = 1 UNION SELECT sample_id, tail FROM gold_path WHERE sample_id % 4 <> 0 OR place = 1) SELECT a.sample_id, count(*) AS n_answers, count(e.n) AS n_hits, round(count(e.n) / count(*), 6)::DOUBLE AS support, concat_ws(',', CASE WHEN a.sample_id % 4 <> 0 THEN 'f1' END, CASE WHEN count(*) = count(e.n) THEN 'f2' END) AS facets FROM kg_answer a LEFT JOIN e ON e.sample_id = a.sample_id AND e.n = a.answer WHERE EXISTS (SELECT 1 FROM e x WHERE x.sample_id = a.sample_id) GROUP BY 1")
def _(v: Views) -> DataFrame:
    # a quarter of the samples selects nothing at its topic
    e = v.view("gold_path").where("sample_id % 4 != 0 or place = 1").groupBy(KEY).agg(F.array_distinct(F.flatten(F.collect_list(F.array("head", "tail")))).alias("e"))
    rows = v.answers.groupBy(KEY).agg(F.sort_array(F.collect_list("answer")).alias("a")).join(e, KEY).join(v.topics, KEY)
    hits = metrics.answer_hits(F.col("e"), F.col("a"))
    facets = episodes.covered_facets(F.col("e"), F.col("node"), F.col("a"), F.array(F.lit("f1"), F.lit("f2")))
    return rows.select(KEY, F.size("a").cast("long").alias("n_answers"), F.size(hits).cast("long").alias("n_hits"), F.round(metrics.support_recall(F.col("e"), F.col("a")), 6).alias("support"), F.array_join(facets, ",").alias("facets"))


@query("h19_cache_keys", "H19 A19", "SELECT c_custkey AS id, sha256('{\"c_custkey\":' || CAST(c_custkey AS VARCHAR) || ',\"c_name\":\"' || c_name || '\"}') AS key FROM customer")
def _(v: Views) -> DataFrame:
    return v.table("customer").select(F.col("c_custkey").alias("id"), scores.payload_key("c_name", "c_custkey").alias("key"))


@query("h22_answers", "H22 A21", "SELECT sample_id, string_agg('ans: ' || answer, chr(10) ORDER BY answer) AS shown FROM kg_answer GROUP BY 1")
def _(v: Views) -> DataFrame:
    rows = v.answers.groupBy(KEY).agg(F.sort_array(F.collect_list("answer")).alias("a"))
    return rows.select(KEY, text.render_answers(text.prefer_original(F.col("a"), F.array(F.lit("x")))).alias("shown"))


# --- metrics


@query("e1_answer_recall", "E1", f"WITH {_DISTINCT}, k AS (SELECT unnest([50, 100, 200, 400]) AS k), e AS (SELECT sample_id, n, min(rank) AS rank FROM (SELECT sample_id, head AS n, rank FROM top WHERE rank < 500 UNION ALL SELECT sample_id, tail, rank FROM top WHERE rank < 500) GROUP BY 1, 2) SELECT a.sample_id, CAST(k.k AS INT) AS k, round(avg(CASE WHEN e.rank < k.k THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall FROM kg_answer a CROSS JOIN k LEFT JOIN e ON e.sample_id = a.sample_id AND e.n = a.answer GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return metrics.answer_recall(ranking.top_distinct(v.scored, 500), v.answers).select(KEY, "k", F.round("recall", 6).alias("recall"))


@query("e2_recall_table", "E2 E20", f"""WITH {_DISTINCT}, k AS (SELECT unnest([50, 100, 200, 400]) AS k), e AS (SELECT sample_id, n, min(rank) AS rank FROM (SELECT sample_id, head AS n, rank FROM top UNION ALL SELECT sample_id, tail, rank FROM top) GROUP BY 1, 2), a AS (SELECT k.k, a.sample_id, avg(CASE WHEN e.rank < k.k THEN 1.0 ELSE 0.0 END) AS r FROM kg_answer a CROSS JOIN k LEFT JOIN e ON e.sample_id = a.sample_id AND e.n = a.answer GROUP BY 1, 2),
s AS (SELECT k.k, g.sample_id, avg(CASE WHEN t.rank < k.k THEN 1.0 ELSE 0.0 END) AS r FROM (SELECT DISTINCT sample_id, head, relation, tail FROM gold_path) g CROSS JOIN k LEFT JOIN top t USING (sample_id, head, relation, tail) GROUP BY 1, 2), r AS (SELECT k.k, g.sample_id, avg(CASE WHEN t.rank < k.k THEN 1.0 ELSE 0.0 END) AS r FROM (SELECT DISTINCT sample_id, head, relation, tail FROM gold_label) g CROSS JOIN k LEFT JOIN top t USING (sample_id, head, relation, tail) GROUP BY 1, 2)
SELECT CAST(k.k AS INT) AS k, (SELECT round(avg(r), 3) FROM a WHERE a.k = k.k)::DOUBLE AS ans_recall, (SELECT round(avg(r), 3) FROM s WHERE s.k = k.k)::DOUBLE AS shortest_path_triple_recall, (SELECT round(avg(r), 3) FROM r WHERE r.k = k.k)::DOUBLE AS relevant_triple_recall FROM k""")
def _(v: Views) -> DataFrame:
    ranked = ranking.top_distinct(v.scored, 1 << 30)
    return metrics.recall_table(ranked, v.answers, v.view("gold_path"), v.view("gold_label"))


_RERANK = f"""WITH {_SOFT}, sp AS (SELECT DISTINCT sample_id, head, relation, tail FROM gold_path), x AS (SELECT soft.*, sp.head IS NOT NULL AS short, row_number() OVER (PARTITION BY soft.sample_id ORDER BY logit DESC, triple_id) - 1 AS rank FROM soft LEFT JOIN sp USING (sample_id, head, relation, tail)), k AS (SELECT unnest([50, 100, 200]) AS k),
p AS (SELECT k.k, sample_id, sum(CASE WHEN rank < k.k AND label > 0 THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN label > 0 THEN 1.0 ELSE 0 END), 0) AS pr, sum(CASE WHEN rank < k.k AND short THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN short THEN 1.0 ELSE 0 END), 0) AS sr, avg(CASE WHEN rank < k.k THEN label END) AS ml FROM x CROSS JOIN k GROUP BY 1, 2),
e AS (SELECT sample_id, n, min(rank) AS rank FROM (SELECT sample_id, head AS n, rank FROM x UNION ALL SELECT sample_id, tail, rank FROM x) GROUP BY 1, 2), a AS (SELECT k.k, a.sample_id, avg(CASE WHEN e.rank < k.k THEN 1.0 ELSE 0.0 END) AS r FROM kg_answer a CROSS JOIN k LEFT JOIN e ON e.sample_id = a.sample_id AND e.n = a.answer GROUP BY 1, 2),
m AS (SELECT CAST(p.k AS INT) AS k, avg(pr) AS positive_recall, avg(sr) AS shortest_recall, avg(ml) AS mean_label, (SELECT avg(r) FROM a WHERE a.k = p.k) AS answer_recall, (SELECT avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END) FROM a WHERE a.k = p.k) AS full_cov FROM p GROUP BY p.k)"""


def ranked_rows(v: Views) -> DataFrame:
    """(sample_id, triple, rank, label, is_shortest): all triples by their logit, equal ones by their texts, which is the order of their ids; a triple of a gold path is on a shortest one."""
    short = v.dealt("gold_path").select(KEY, *TRIPLE).distinct().withColumn("is_shortest", F.lit(True))
    rows = joins.beside(soft_labelled(v.loose, v.dealt("gold_label")), short.hint("shuffle_hash"), *TRIPLE)  # few triples are of a path
    place = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("logit"), *TRIPLE))
    return rows.select(KEY, *TRIPLE, (place - 1).cast("int").alias("rank"), "label", F.coalesce("is_shortest", F.lit(False)).alias("is_shortest"))


def reranked(v: Views) -> DataFrame:
    """The metrics of all triples ranked by their logit, stored: the triples are dealt by sample once, and labels, paths and answers joined where they lie."""
    with storage.in_place(v.spark):
        return checkpointed(metrics.rerank_metrics(ranked_rows(v), v.answers))


_FIVE = ("positive_recall", "shortest_recall", "mean_label", "answer_recall", "full_cov")


@query("e3_rerank_metrics", "E3", f"{_RERANK} SELECT k, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _FIVE)} FROM m")
def _(v: Views) -> DataFrame:
    return reranked(v).select("k", *[F.round(c, 6).alias(c) for c in _FIVE])


@query("e3_target_metric", "E3 U4", f"{_RERANK}, t AS (SELECT k, 'answer_recall' AS mode, answer_recall AS x FROM m UNION ALL SELECT k, 'full_cov', full_cov FROM m UNION ALL SELECT k, 'mix', 0.3 * answer_recall + 0.7 * full_cov FROM m) SELECT k, mode, round(x, 6)::DOUBLE AS target FROM t")
def _(v: Views) -> DataFrame:
    """The value that picks a checkpoint, by each rule."""
    from functools import reduce

    rows = reranked(v)
    found = [metrics.target_metric(rows, mode, k, 0.3).select("k", F.lit(mode).alias("mode"), F.round("target", 6).alias("target")) for mode in metrics.TARGET_METRICS for k in (50, 100, 200)]
    return reduce(DataFrame.unionByName, found)


@query("e4_statistics", "E4", f"WITH {_SOFT}, n AS (SELECT sample_id, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS n FROM soft GROUP BY 1) SELECT CAST(floor(quantile_cont(n, 0.5)) AS INT) AS median_relevant, CAST(floor(avg(n)) AS INT) AS mean_relevant, CAST(max(n) AS BIGINT) AS max_relevant FROM n")
def _(v: Views) -> DataFrame:
    return metrics.relevant_statistics(soft_rows(v)).withColumn("max_relevant", F.col("max_relevant").cast("long"))


_STORED = "1 / (1 + exp(-logit)) AS p, round(1 / (1 + exp(-logit)), 3) AS stored"
_LINES = f"{_SOFT}, a AS (SELECT sample_id, count(*) AS n FROM kg_answer GROUP BY 1), m AS (SELECT sample_id, count(*) AS num_candidates, sum(CASE WHEN soft.label > 0 THEN 1 ELSE 0 END)::BIGINT AS num_positive, sum(CASE WHEN soft.label = 1 THEN 1 ELSE 0 END)::BIGINT AS num_shortest, max(soft.label) > 0 AS has_positive, greatest(1, coalesce(max(a.n), 0))::BIGINT AS num_answers, max(abs(1 / (1 + exp(-logit)) - round(1 / (1 + exp(-logit)), 3))) AS diff FROM soft LEFT JOIN a USING (sample_id) GROUP BY 1)"


def cached_lines(v: Views) -> DataFrame:
    """Features of all candidates in a cache with one folder a split, and a manifest line of each sample from what the cache holds."""
    rows = soft_rows(v).select(KEY, "triple_id", "label", "logit", F.round(scores.sigmoid(F.col("logit")), 3).alias("stored"))
    split = F.when(F.col(KEY) % 10 == 0, "test").when(F.col(KEY) % 10 == 1, "val").otherwise("train")
    path = storage.new_folder(v.spark, "cache")
    readers.feature_cache(rows.withColumn("split", split), path)
    cache = v.spark.read.parquet(path)
    far = vectors.score_differences(cache.withColumn("again", scores.sigmoid(F.col("logit"))), "stored", "again")
    return metrics.manifest(cache, v.answers).join(far, KEY).join(cache.select(KEY, "split").distinct(), KEY)


@query("e5_manifest", "E5 A9 M13", f"WITH {_LINES} SELECT sample_id, num_candidates, num_positive, num_shortest, has_positive, num_answers, round(diff, 9) AS max_abs_diff FROM m")
def _(v: Views) -> DataFrame:
    return cached_lines(v).select(KEY, "num_candidates", "num_positive", "num_shortest", "has_positive", "num_answers", F.round("max_abs_diff", 9).alias("max_abs_diff"))


@query("a9_cache_totals", "A9 M4 M13", f"WITH {_LINES} SELECT CASE sample_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, count(*) AS samples, sum(num_candidates)::BIGINT AS candidates, sum(num_positive)::BIGINT AS positives, count(*) FILTER (has_positive) AS with_positives, round(max(diff), 9) AS max_abs_diff FROM m GROUP BY 1")
def _(v: Views) -> DataFrame:
    return metrics.manifest_totals(cached_lines(v), "split").withColumn("max_abs_diff", F.round("max_abs_diff", 9))


@query("e6_answer_count", "E6", "SELECT c_custkey AS id, greatest(1, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END) AS n FROM customer")
def _(v: Views) -> DataFrame:
    k = F.col("c_custkey") % 4
    lists = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("c_name", "c_mktsegment")).when(k == 2, F.array("c_name", "c_name", F.lit("x")))
    return v.table("customer").select(F.col("c_custkey").alias("id"), metrics.answer_count(lists).alias("n"))


@query("e9_distinct_gold", "E9", "SELECT sample_id, count(*) AS n FROM (SELECT DISTINCT sample_id, head, relation, CASE WHEN path % 7 = 3 THEN '' ELSE tail END AS tail FROM gold_path) WHERE tail <> '' GROUP BY 1")
def _(v: Views) -> DataFrame:
    tail = F.when(F.col("path") % 7 == 3, "").otherwise(F.col("tail"))
    return metrics.distinct_gold(v.view("gold_path").withColumn("tail", tail))


@query("c9_positions", "C9", "SELECT s.s_suppkey AS id, s.s_name AS name, t.node FROM supplier s JOIN topic t ON t.sample_id = s.s_suppkey")
def _(v: Views) -> DataFrame:
    left = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return joins.checked_positions(left, v.topics.select(F.col(KEY).alias("id"), "node"))


@query("e18_observed", "E18 B16", "WITH l AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity > 45 THEN 'large' WHEN l_tax = 0 THEN 'odd' END AS reason FROM lineitem) SELECT n.name, count(l.one) AS n FROM (SELECT unnest(['returned', 'large', 'free', 'other', 'kept', 'all']) AS name) n LEFT JOIN (SELECT CASE WHEN reason = 'odd' THEN 'other' ELSE coalesce(reason, 'kept') END AS name, 1 AS one FROM l UNION ALL SELECT 'all', 1 FROM l) l USING (name) GROUP BY 1")
def _(v: Views) -> DataFrame:
    """Reasons of lines counted while the kept ones are written."""
    reason = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_quantity") > 45, "large").when(F.col("l_tax") == 0, "odd")
    rows, seen = metrics.observed_counts(v.table("lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason")), ("returned", "large", "free"))
    rows.where("reason IS NULL").write.parquet(storage.new_folder(v.spark, "kept"))
    return v.spark.createDataFrame(list(seen.get.items()), "name string, n long")


# half precision: eleven bits from the leading one on, in steps of 2^-24 at least
_HALF = "CASE WHEN {0} = 0 THEN 0 ELSE round_even({0} / pow(2, greatest(floor(log2(abs({0}))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs({0}))), -14) - 10) END"


@query("h20_packed", "H20 A8", f"WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(list_transform(embedding, lambda y: floor(10 * y)) AS DOUBLE[]) AS f FROM embeddings), n AS (SELECT vec_id, unnest(list_transform(e, lambda y: y / sqrt(list_dot_product(e, e))) || list_transform(f, lambda y: y / sqrt(list_dot_product(f, f)))) AS y, generate_subscripts(e || f, 1) AS k FROM x WHERE list_dot_product(f, f) > 0), h AS (SELECT vec_id, k, {_HALF.format('y')} AS y FROM n) SELECT vec_id, count(*) AS width, round(sum(y * k), 6)::DOUBLE AS weighted, round(max(y), 9)::DOUBLE AS most FROM h GROUP BY 1")
def _(v: Views) -> DataFrame:
    """Two normalised vectors of each row, one after the other, packed in half precision, stored and read again."""
    # tenfold in the elements' own precision, as SQL has it: single precision takes 10 * -0.1 to -1; from 2^23 on it has no fractions
    whole = lambda y: F.when(F.abs(y) < 1 << 23, F.floor(y).cast("double")).otherwise(y.cast("double"))
    rows = v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.transform("embedding", lambda y: whole(F.lit(10).cast("float") * y)).alias("f"))
    rows = rows.where(scores.dot(F.col("f"), F.col("f")) > 0)
    both = rows.select("vec_id", F.concat(scores.l2_normalized(F.col("e")), scores.l2_normalized(F.col("f"))).alias("x"))
    path = storage.new_folder(v.spark, "packed")
    vectors.pack(both, "x").write.parquet(path)
    back = vectors.unpack(v.spark.read.parquet(path))
    place = F.sequence(F.lit(1), F.size("vector")).cast("array<double>")
    per = back.select("vec_id", F.col("width").cast("long").alias("width"), scores.dot(F.col("vector"), place).alias("weighted"), F.array_max("vector").alias("most"))
    # rows of one id count as one
    return per.groupBy("vec_id").agg(F.sum("width").alias("width"), F.round(F.sum("weighted"), 6).alias("weighted"), F.round(F.max("most"), 9).alias("most"))


@query("a19_answers", "A19 K5 S6", "WITH r AS (SELECT c_custkey AS id, c_mktsegment || c_custkey % 9 AS q FROM customer) SELECT id, q NOT LIKE '%7' AS ok, CASE WHEN q NOT LIKE '%7' THEN reverse(q) END AS answer, CASE WHEN q LIKE '%7' THEN 'down' END AS error, (SELECT count(DISTINCT q) FROM r) AS calls FROM r")
def _(v: Views) -> DataFrame:
    """A stand-in service that fails for some questions: equal questions are called once, failures are rows."""

    def ask(payload: dict) -> dict:
        if payload["q"].endswith("7"):
            raise RuntimeError("down")
        return {"answer": payload["q"][::-1]}

    question = F.concat("c_mktsegment", (F.col("c_custkey") % 9).cast("string"))
    client = service.AnswerService(v.spark, ask)
    out = client.answer(v.table("customer").select(F.col("c_custkey").alias("id"), F.to_json(F.struct(question.alias("q"))).alias("payload")))
    calls = client.log().groupBy().agg(F.count(F.lit(1)).alias("calls"))
    return out.select("id", "ok", F.get_json_object("response", "$.answer").alias("answer"), "error").crossJoin(calls)  # one row on the right


# distinct names: a line matches an answer where the normalised texts are equal
_MATCHED = f"p AS (SELECT DISTINCT id, line FROM qa_pred), j AS (SELECT g.id, g.answer, p.line FROM qa_gold g JOIN p ON p.id = g.id AND contains({_norm('p.line')}, {_norm('g.answer')})), s AS (SELECT i.id, (SELECT count(DISTINCT answer) FROM j WHERE j.id = i.id) AS matched, (SELECT count(*) FROM p WHERE p.id = i.id) AS np, (SELECT count(*) FROM qa_gold g WHERE g.id = i.id) AS ng FROM (SELECT DISTINCT id FROM p WHERE id IN (SELECT id FROM qa_gold)) i)"


@query("e10_scores", "E10 C16 C17", f"WITH {_MATCHED} SELECT id, CAST(matched AS INT) AS matched, round(matched / np, 6)::DOUBLE AS precision, round(matched / ng, 6)::DOUBLE AS recall, round(CASE WHEN matched = 0 THEN 0 ELSE 2.0 * matched / (np + ng) END, 6)::DOUBLE AS f1 FROM s")
def _(v: Views) -> DataFrame:
    return metrics.score_predictions(v.predictions).select("id", "matched", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("e11_report", "E11 B11", f"WITH {_MATCHED}, t AS (SELECT id, CASE WHEN id % 9 = 0 THEN 0 ELSE matched END AS matched, CASE WHEN id % 9 = 0 THEN 0 ELSE np END AS np, ng, id % 9 = 0 AS none FROM s WHERE id % 4 >= 2 AND id % 5 <> 0), m AS (SELECT sum(matched) / sum(np) AS p, sum(matched) / sum(ng) AS r, avg(CASE WHEN none THEN 1.0 ELSE 0.0 END) AS none, count(*) AS n, avg(CASE WHEN np > 0 THEN matched / np ELSE 0 END) AS mp, avg(matched / ng) AS mr, avg(2.0 * matched / (np + ng)) AS mf FROM t) SELECT n, round(100 * mp, 5)::DOUBLE AS macro_precision, round(100 * mr, 5)::DOUBLE AS macro_recall, round(100 * mf, 5)::DOUBLE AS macro_f1, round(p, 6)::DOUBLE AS micro_precision, round(r, 6)::DOUBLE AS micro_recall, round(2 * p * r / (p + r), 6)::DOUBLE AS micro_f1, round(none, 6)::DOUBLE AS no_answer_share, round((mf + 1.5) / 2.5 * 100, 5)::DOUBLE AS rescaled FROM m")
def _(v: Views) -> DataFrame:
    """Answerable samples of three hops or more; a ninth of them say that there is no answer."""
    rows = v.predictions.withColumn("a_entity_in_graph", F.when(F.col("id") % 5 != 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))).withColumn("max_path_length", F.col("id") % 4 + 1)
    rows = rows.withColumn("prediction", F.when(F.col("id") % 9 == 0, "ans: not available").otherwise(F.col("prediction")))
    out = metrics.report(metrics.score_predictions(metrics.select_samples(rows, hops=3, subset=True)))
    out = out.withColumn("rescaled", metrics.rescaled(F.col("macro_f1") / 100))
    return out.select("n", *[F.round(c, 5).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "rescaled")], *[F.round(c, 6).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1", "no_answer_share")])


@query("e12_hits", "E12", f"WITH {_MATCHED}, f AS (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY min(n), line) AS k FROM qa_pred GROUP BY 1, 2) SELECT s.id, CASE WHEN s.matched > 0 THEN 1 ELSE 0 END AS hit_any, CASE WHEN EXISTS (SELECT 1 FROM f JOIN j ON j.id = f.id AND j.line = f.line WHERE f.id = s.id AND f.k = 1) THEN 1 ELSE 0 END AS hit FROM s")
def _(v: Views) -> DataFrame:
    return metrics.score_predictions(v.predictions).select("id", "hit_any", "hit")


@query("e13_legacy", "E13", f"WITH {_MATCHED}, l AS (SELECT id, count(*) AS lines FROM qa_pred GROUP BY 1) SELECT s.id, CASE WHEN matched > 0 THEN 1 ELSE 0 END AS hit, round(matched / lines, 6)::DOUBLE AS precision, round(matched / ng, 6)::DOUBLE AS accuracy FROM s JOIN l USING (id)")
def _(v: Views) -> DataFrame:
    p, a, dc = F.col("prediction"), F.col("ground_truth"), F.lit(False)
    _, precision, _ = metrics.legacy_f1(p, a, dc)
    return v.predictions.select("id", metrics.legacy_hit(p, a, dc).alias("hit"), F.round(precision, 6).alias("precision"), F.round(metrics.legacy_accuracy(p, a), 6).alias("accuracy"))


@query("e14_hallucination", "E14 C18", f"WITH {_MATCHED}, g AS (SELECT id, min(answer) AS a FROM qa_gold GROUP BY 1), l AS (SELECT p.id, p.line, p.id % 3 <> 0 AS good, EXISTS (SELECT 1 FROM j WHERE j.id = p.id AND j.line = p.line) AS hit, contains(lower(p.line), lower(g.a)) OR contains(lower(g.a), trim(split_part(lower(p.line), 'ans:', 2))) AS inside FROM p JOIN g USING (id)), c AS (SELECT id, any_value(good) AS good, count(*) AS n, count(*) FILTER (good AND hit) AS g_c, count(*) FILTER (good AND NOT hit) AS g_w, count(*) FILTER (NOT good AND inside) AS b_in, count(*) FILTER (NOT good AND NOT inside AND hit) AS b_c, count(*) FILTER (NOT good AND NOT inside AND NOT hit) AS b_w FROM l GROUP BY 1) SELECT id, CAST(g_c AS INT) AS g_c, CAST(g_w AS INT) AS g_w, CAST(b_in AS INT) AS b_in_graph, CAST(b_c AS INT) AS b_out_graph_c, CAST(b_w AS INT) AS b_out_graph_w, round(CASE WHEN good THEN g_c - g_w ELSE -1.0 * b_in - 1.5 * (b_c + b_w) END / n, 6)::DOUBLE AS score FROM c")
def _(v: Views) -> DataFrame:
    rows = metrics.score_predictions(v.predictions)
    h = metrics.hallucination(F.col("lines"), F.col("answers"), F.col("double_check"), F.col("id") % 3 != 0, F.col("no_answer"), F.array(F.array_min("ground_truth")))
    return rows.withColumn("h", h).select("id", "h.g_c", "h.g_w", "h.b_in_graph", "h.b_out_graph_c", "h.b_out_graph_w", F.round("h.score", 6).alias("score"))


_LOG = "lg AS (SELECT CAST(user_id AS VARCHAR) AS sample_id, CASE WHEN event_type = 'purchase' THEN 1.0 WHEN event_type = 'error' THEN 0.0 ELSE 0.25 END AS f1 FROM events), ag AS (SELECT sample_id, count(*) AS n_rollouts, avg(f1) AS mean_f1, avg(CASE WHEN f1 <= 0 THEN 1.0 ELSE 0.0 END) AS zero_frac FROM lg GROUP BY 1)"


def _log(v: Views) -> DataFrame:
    f1 = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", 0.0).otherwise(0.25)
    return v.table("events").select(F.col("user_id").cast("string").alias(KEY), F.lit("").alias("trajectory_id"), F.col("event_id").alias("line_no"), F.floor(F.col("event_id") / 256).alias("step"), f1.alias("f1"), F.col("event_type").alias("diagnosis"), F.col("event_type").alias("question"))


@query("e16_log", "E16", f"WITH {_LOG} SELECT sample_id, n_rollouts, round(mean_f1, 6)::DOUBLE AS mean_f1, round(zero_frac, 6)::DOUBLE AS zero_frac FROM ag")
def _(v: Views) -> DataFrame:
    return metrics.by_sample(_log(v)).select(KEY, "n_rollouts", F.round("mean_f1", 6).alias("mean_f1"), F.round("zero_frac", 6).alias("zero_frac"))


@query("e17_bad_samples", "E17", f"WITH {_LOG} SELECT sample_id FROM ag WHERE n_rollouts >= 40 AND zero_frac >= 0.2")
def _(v: Views) -> DataFrame:
    return metrics.bad_samples(metrics.by_sample(_log(v)), "high_zero_frac", 40, min_zero_frac=0.2, diagnoses=("error",)).select(KEY)


@query("e19_lengths", "E19", "SELECT role, CAST(min(length(text)) AS INT) AS least, round(avg(length(text)), 5)::DOUBLE AS mean, CAST(max(length(text)) AS INT) AS most, round(quantile_cont(length(text), 0.9), 5)::DOUBLE AS p90 FROM conversations GROUP BY 1")
def _(v: Views) -> DataFrame:
    out = metrics.length_statistics(v.table("conversations").withColumn("len", F.length("text")), "len", "role")
    return out.select("role", "least", F.round("mean", 5).alias("mean"), "most", F.round("p90", 5).alias("p90"))


# --- models


def _touched(v: Views) -> DataFrame:
    return joins.touches_answer(v.edges, v.answers)


_BCE = "(1 - y) * x + (1 + (w - 1) * y) * (ln(1 + exp(-abs(x))) + greatest(-x, 0))"
_TOUCH = "tc AS (SELECT e.sample_id, e.triple_id, e.head, e.tail, e.logit AS x, CASE WHEN EXISTS (SELECT 1 FROM kg_answer a WHERE a.sample_id = e.sample_id AND (a.answer = e.head OR a.answer = e.tail)) THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM kg_edge e)"


@query("m5_soft_bce", "M5", f"WITH {_SOFT} SELECT sample_id, round(avg((1 - label) * logit + ln(1 + exp(-abs(logit))) + greatest(-logit, 0)), 5)::DOUBLE AS loss FROM soft GROUP BY 1")
def _(v: Views) -> DataFrame:
    # the usual form: x - x y + log(1 + exp(-x)) for any sign
    return models.soft_bce(soft_rows(v)).select(KEY, F.round("loss", 5).alias("loss"))


@query("m6_touch_bce", "M6", f"WITH {_TOUCH}, p AS (SELECT *, sum(y) OVER (PARTITION BY sample_id) AS pos, count(*) OVER (PARTITION BY sample_id) AS n FROM tc), q AS (SELECT sample_id, x, y, pos, CASE WHEN (n - pos) / greatest(pos, 1e-6) < 1e-6 THEN 1 ELSE least((n - pos) / greatest(pos, 1e-6), 50) END AS w FROM p), m AS (SELECT sample_id, count(*) AS m FROM kg_answer GROUP BY 1) SELECT sample_id, round(CASE WHEN max(pos) < 0.5 THEN 0 ELSE avg({_BCE}) * (1 + 0.1 * greatest(coalesce(max(m.m), 1) - 1, 0)) END, 5)::DOUBLE AS loss FROM q LEFT JOIN m USING (sample_id) GROUP BY 1")
def _(v: Views) -> DataFrame:
    return models.answer_touch_bce(_touched(v), v.answers, boost=0.1).select(KEY, F.round("loss", 5).alias("loss"))


@query("m7_coverage", "M7", f"WITH {_TOUCH}, b AS (SELECT a.sample_id, a.answer, max(x) AS x FROM kg_answer a JOIN tc ON tc.sample_id = a.sample_id AND (tc.head = a.answer OR tc.tail = a.answer) GROUP BY 1, 2), s AS (SELECT sample_id, sum(ln(1 + exp(-abs(x))) + greatest(-x, 0)) AS loss FROM b GROUP BY 1) SELECT t.sample_id, round(coalesce(s.loss, 0), 5)::DOUBLE AS loss FROM (SELECT DISTINCT sample_id FROM tc) t LEFT JOIN s USING (sample_id)")
def _(v: Views) -> DataFrame:
    return models.min_answer_coverage(_touched(v), v.answers).select(KEY, F.round("loss", 5).alias("loss"))


@query("m8_listwise", "M8", f"WITH {_TOUCH}, t AS (SELECT * FROM tc), r AS (SELECT a.sample_id, a.triple_id, a.y, 1 + sum(1 / (1 + exp(-(a.x - b.x)))) AS sr, count(*) AS n FROM t a JOIN t b USING (sample_id) GROUP BY 1, 2, 3), p AS (SELECT *, 1 / (1 + exp(-(least(20.0, n) + 0.5 - sr))) AS p, sum(y) OVER (PARTITION BY sample_id) AS pos FROM r), e AS (SELECT sample_id, max(pos) AS pos, avg(-(CASE WHEN y > 0.5 THEN least((n - pos) / greatest(pos, 1e-6), 50) ELSE 1 END) * (y * ln(greatest(p, 1e-6)) + (1 - y) * ln(greatest(1 - p, 1e-6)))) AS edge FROM p GROUP BY 1), c AS (SELECT a.sample_id, a.answer, product(1 - p.p) AS q FROM kg_answer a JOIN t ON t.sample_id = a.sample_id AND (t.head = a.answer OR t.tail = a.answer) JOIN p ON p.sample_id = t.sample_id AND p.triple_id = t.triple_id GROUP BY 1, 2), d AS (SELECT sample_id, avg(-ln(greatest(1 - q, 1e-6))) AS cover FROM c GROUP BY 1) SELECT e.sample_id, round(CASE WHEN pos < 0.5 THEN 0 ELSE edge + 0.5 * coalesce(cover, 0) END, 4)::DOUBLE AS loss FROM e LEFT JOIN d USING (sample_id)")
def _(v: Views) -> DataFrame:
    with storage.in_place(v.spark):
        rows, _ = storage.laid(joins.touches_answer(v.edges.select(KEY, "triple_id", "head", "tail", "logit"), v.answers), KEY, v.deals)
        return stored(models.listwise_surrogate(rows, v.answers, 20).select(KEY, F.round("loss", 4).alias("loss")))


@query("m9_pairwise", "M9", f"WITH {_EXAMPLES}, y AS (SELECT ex.sample_id, ex.side, soft.logit FROM ex JOIN soft USING (sample_id, triple_id)) SELECT p.sample_id, round(avg(ln(1 + exp(g.logit - p.logit))), 5)::DOUBLE AS loss FROM y p JOIN y g ON g.sample_id = p.sample_id AND g.side = 'neg' WHERE p.side = 'pos' GROUP BY 1")
def _(v: Views) -> DataFrame:
    return models.pairwise_logistic(pairwise(soft_rows(v), keep=("logit",))).select(KEY, F.round("loss", 5).alias("loss"))


@query("m2_m3_scorers", "M2 M3", None)
def _(v: Views) -> DataFrame:
    rows = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return models.score_rows(rows, "features", models.Perceptron.seeded((64, 32, 1))).select("vec_id", F.round("logit", 6).alias("logit"))


def scorer_rows(v: Views) -> DataFrame:
    """(sample_id, triple_id, triple, features, label, is_shortest): structure, stage-1 score and soft labels of every triple, stored by sample; to be called in_place()."""
    soft, name = storage.laid(soft_rows(v).select(KEY, "triple_id", *TRIPLE, "logit", "label"), KEY, v.deals)
    rows = graph.structural_features(soft).withColumn("score", scores.sigmoid(F.col("logit")))
    shares = ["score", "h_out", "t_out", "h_in", "t_in", "h_mentions", "t_mentions", "relation_count", "pair_repeats"]
    rows = rows.select(KEY, "triple_id", *TRIPLE, F.array(*[F.col(c).cast("double") for c in shares]).alias("features"), "label", F.lit(False).alias("is_shortest"))
    out, _ = storage.laid(rows, KEY, v.deals)
    storage.drop_laid(v.spark, name)
    return out


@query("m10_training", "M10", None)
def _(v: Views) -> DataFrame:
    """Three epochs of a scorer on two thirds of the samples, the checkpoint picked on the others."""
    held = F.pmod(F.crc32(F.col(KEY).cast("string")), F.lit(3)) == 0
    with storage.in_place(v.spark):
        rows = scorer_rows(v)
        trained = training.train_scorer(rows.where(~held), training.by_rerank_metric(rows.where(held), v.answers, "mix", 100), (9, 16, 1), training.Adam(rate=0.01), epochs=3, patience=2, batches=4)
    return trained.history.select("epoch", F.round("loss", 6).alias("loss"), F.round("metric", 6).alias("metric"), "best_epoch", "patient")


@query("m1_encoder", "M1", None)
def _(v: Views) -> DataFrame:
    out = models.encode_texts(v.table("benchmark").select("item_id", "text"), "text", models.hashing_encoder(16))
    return out.select("item_id", F.round(scores.dot(F.col("vec"), F.col("vec")), 6).alias("norm"))


# --- prompts


@query("k1_prompts", "K1", f"WITH {_DISTINCT}, p AS (SELECT sample_id, 'Triplets:' || chr(10) || string_agg('(' || head || ',' || relation || ',' || tail || ')', chr(10) ORDER BY rank DESC) AS t FROM top WHERE rank < 5 GROUP BY 1) SELECT t.sample_id, md5(p.t || chr(10) || chr(10) || 'Question:' || chr(10) || 'brands of ' || t.node || '?') AS user_query FROM topic t JOIN p USING (sample_id)")
def _(v: Views) -> DataFrame:
    samples = v.topics.select(KEY, F.concat(F.lit("brands of "), "node").alias("question"))
    return prompts.render(samples, ranking.top_distinct(v.scored, 500), "scored_5_rev").join(v.edges.select(KEY).distinct(), KEY, "left_semi").select(KEY, F.md5("user_query").alias("user_query"))


def evidence(v: Views) -> DataFrame:
    """The triples of gold paths, in their order, and the best scored ones, as two lists (good or not) of each sample."""
    place = F.row_number().over(W.partitionBy(KEY).orderBy("path", "place"))
    good = v.view("gold_path").select(KEY, *TRIPLE, place.alias("rank"), F.lit(1.0).alias("score"), F.lit(True).alias("good"))
    return good.unionByName(ranking.top_distinct(v.scored, 500).select(KEY, *TRIPLE, "rank", "score", F.lit(False).alias("good")))


_MODES = ("rog_8", "rog_8_rmht", "rog_6_rmht_firstq", "scored_7_firstq", "noevi", "noevi_firstq")
_SHOWN = "coalesce(string_agg('(' || head || ',' || relation || ',' || tail || ')', chr(10) ORDER BY idx), '')"


def _mode_sql(mode: str) -> str:
    """SELECT (sample_id, mode, user_query) of a mode, from ev (sample_id, good, o, triple) and q (sample_id, q)."""
    kind, *rest = mode.split("_")
    k = int(rest[0]) if kind != "noevi" else 0
    good = "" if kind == "rog" else "WHERE good = 1"  # good is 0 for path triples: they come first
    ends = "QUALIFY row_number() OVER (PARTITION BY sample_id, good, least(head, tail), greatest(head, tail) ORDER BY o) = 1" if "rmht" in mode else ""
    lines = f"SELECT sample_id, {_SHOWN} AS t FROM (SELECT sample_id, head, relation, tail, row_number() OVER (PARTITION BY sample_id ORDER BY min((good, o))) AS idx FROM (SELECT * FROM ev {good} {ends}) GROUP BY 1, 2, 3, 4 QUALIFY idx <= {k}) GROUP BY 1"
    parts = ["q", "'Triplets:' || chr(10) || coalesce(t, '')" if kind != "noevi" else "''"]
    text = " || chr(10) || chr(10) || ".join(parts if "firstq" in mode else parts[::-1]) if mode != "noevi" else "q"
    return f"SELECT q.sample_id, '{mode}' AS mode, md5({text}) AS user_query FROM q LEFT JOIN ({lines}) USING (sample_id)"


@query("k1_modes", "K1", f"WITH {_DISTINCT}, ev AS MATERIALIZED (SELECT sample_id, head, relation, tail, 0 AS good, row_number() OVER (PARTITION BY sample_id ORDER BY path, place) AS o FROM gold_path UNION ALL SELECT sample_id, head, relation, tail, 1, rank FROM top WHERE rank < 500), q AS (SELECT sample_id, 'Question:' || chr(10) || 'brands of ' || node || '?' AS q FROM topic) " + " UNION ALL ".join(map(_mode_sql, _MODES)))
def _(v: Views) -> DataFrame:
    from functools import reduce

    samples = v.topics.select(KEY, F.concat(F.lit("brands of "), "node").alias("question"))
    rows = evidence(v)
    shown = [prompts.render(samples, rows if m.startswith("rog") else rows.where("not good"), m).select(KEY, F.lit(m).alias("mode"), F.md5("user_query").alias("user_query")) for m in _MODES]
    return reduce(DataFrame.unionByName, shown)


_JSON = "'[' || coalesce(string_agg('\"' || {} || '\"', ', ' ORDER BY {}), '') || ']'"
_LINE = "idx::VARCHAR || '|' || head || '|' || relation || '|' || tail"


@query("k2_records", "K2 K3 B8", f"""WITH {_FIRST}, c AS (SELECT * FROM cand WHERE idx <= 20), s AS (SELECT * FROM c WHERE idx % 5 = sample_id % 7), r AS (SELECT c.* FROM c ANTI JOIN s USING (sample_id, idx)),
n AS (SELECT sample_id, head AS x FROM s UNION SELECT sample_id, tail FROM s UNION SELECT sample_id, node FROM topic),
a AS (SELECT sample_id, string_agg({_LINE}, chr(10) ORDER BY idx) AS lines FROM r GROUP BY 1), b AS (SELECT sample_id, {_JSON.format(_LINE, 'idx')} AS chosen FROM s GROUP BY 1), d AS (SELECT sample_id, {_JSON.format('x', 'x')} AS nodes FROM n GROUP BY 1),
u AS (SELECT c.sample_id, {{instruction}} || chr(10) || 'Candidate Triples:' || chr(10) || coalesce(any_value(lines), '(none)') || chr(10) || chr(10) || 'Question:' || chr(10) || 'which brands?' || chr(10) || chr(10) || 'state:' || chr(10) || '{{{{"selected_triples": ' || coalesce(any_value(chosen), '[]') || ', "current_nodes": ' || any_value(nodes) || '}}}}' || chr(10) || chr(10) || 'Action Rules:' || chr(10) || '- Do not repeat triples' || chr(10) || '- ' || {{rule}} AS body FROM c LEFT JOIN a USING (sample_id) LEFT JOIN b USING (sample_id) JOIN d USING (sample_id) GROUP BY 1)
SELECT sample_id, md5(body) AS user_content, md5({{system}} || body || '{{{{"action":"STOP"}}}}') AS record, 4::INT AS n_turns FROM u""".format(**{k: "'" + x.replace("'", "''") + "'" for k, x in (("instruction", prompts.AGENT_INSTRUCTION), ("rule", prompts.STOP_RULE), ("system", prompts.AGENT_SYSTEM))}))
def _(v: Views) -> DataFrame:
    rows = ranking.first_distinct(v.edges, 20).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("idx", *TRIPLE))).alias("c"))
    rows = rows.join(v.topics.groupBy(KEY).agg(F.collect_list("node").alias("topics")), KEY)
    chosen = F.filter(F.transform("c", lambda c: c["idx"]), lambda i: i % 5 == F.col(KEY) % 7)
    shown = prompts.selection_prompt(F.lit("which brands"), F.col("c"), chosen, F.col("topics"))
    stop = F.to_json(F.struct(F.lit("STOP").alias("action")))
    out = rows.withColumn("m", prompts.messages(prompts.AGENT_SYSTEM, shown, stop, prompts.AGENT_INSTRUCTION))
    out = out.withColumn("chat", prompts.conversation(F.get("m", F.lit(1))["content"], prompts.AGENT_SYSTEM, ("example", "STOP")))
    return out.select(KEY, F.md5(F.get("m", F.lit(1))["content"]).alias("user_content"), F.md5(F.array_join(F.transform("m", lambda m: m["content"]), "")).alias("record"), F.size("chat").alias("n_turns"))


@query("k4_generation", "K4 K5 K6 U3 A20", None)
def _(v: Views) -> DataFrame:
    samples = v.topics.select(KEY, F.concat(F.lit("brands of "), "node").alias("question"))
    shown = prompts.render(samples, ranking.top_distinct(v.scored, 500), "scored_3").select(KEY, "user_query")
    return prompts.generate_twice(shown, "user_query", prompts.with_retry(prompts.echo_generator)).select(KEY, "prediction")


# --- episodes


def listed(cands: DataFrame, gold: DataFrame) -> DataFrame:
    """(sample_id, candidates, support): candidates in order and the idx of those that are gold, null where none is, in one pass."""
    marked = joins.beside(cands.select(KEY, "idx", *TRIPLE), gold.select(KEY, *TRIPLE).distinct().withColumn("_gold", F.lit(True)), *TRIPLE)
    support = F.sort_array(F.collect_list(F.when(F.col("_gold"), F.col("idx"))))
    return marked.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("idx", *TRIPLE))).alias("candidates"), F.when(F.size(support) > 0, support).alias("support"))


def truths(v: Views) -> DataFrame:
    """(episode_id, candidates, topic, answers, support, soft_limit) of each user, from the sample of its number."""
    n = v.table("supplier").agg(F.count(F.lit(1)).alias("n"))
    users = v.table("events").select(F.col("user_id").alias("episode_id")).distinct().crossJoin(n).select("episode_id", (F.col("episode_id") % F.col("n") + 1).alias(KEY))  # one row on the right
    cands = ranking.first_distinct(v.edges, 100)
    lists = listed(cands, v.view("gold_path"))
    answers = v.answers.groupBy(KEY).agg(F.sort_array(F.collect_list("answer")).alias("answers"))
    out = users.join(lists, KEY, "left").join(answers, KEY, "left").join(v.topics.withColumnRenamed("node", "topic"), KEY, "left")
    return out.select("episode_id", "candidates", "topic", "answers", "support", F.lit(14).alias("soft_limit"))


_TURNS = "tn AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY turn) AS k FROM episode_turn), st AS (SELECT episode_id, min(k) AS k FROM tn WHERE kind = 'STOP' GROUP BY 1)"


@query("s1_machine", "S1 C13", None)
def _(v: Views) -> DataFrame:
    return episodes.machine_runs(v.view("episode_turn"), truths(v))


def scripted_agent(prompts_: list[str], draws: list[int]) -> list[str]:
    """A deterministic stand-in: by the number in the question it repeats itself, says nothing, names what isn't there, or takes the next candidate, four or all."""
    out = []
    for p in prompts_:
        kind = int(p.split("brands of S")[1].split("?")[0]) % 5
        first = p.split("Candidate Triples:\n")[1].split("|", 1)[0]
        chosen = p.split('"selected_triples": [')[1].split('], "current_nodes"')[0].count("|") // 3
        stop = not first.isdigit() or kind == 3 and chosen == 4
        said = {0: "[1] (the first)", 1: "no idea", 2: '{"action": "ADD_TRIPLE", "triple_id": 100000}'}.get(kind) or ("STOP" if stop else f'{{"action": "ADD_TRIPLE", "triple_id": {first}}}')
        out.append(said)
    return out


def rollout_samples(v: Views, k: int = 100) -> DataFrame:
    """(sample_id, question, candidates, topics): the first k distinct triples of each sample."""
    lists = ranking.first_distinct(v.edges, k).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("idx", *TRIPLE))).alias("candidates"))
    topics = v.topics.groupBy(KEY).agg(F.sort_array(F.collect_list("node")).alias("topics"))
    return lists.join(topics, KEY).select(KEY, F.concat(F.lit("brands of "), F.get("topics", F.lit(0))).alias("question"), "candidates", "topics")


@query("s1_rollouts", "S1 K7 H9 G6", f"""WITH {_FIRST}, n AS (SELECT sample_id, least(count(*), 100) AS n, sample_id % 5 AS kind FROM cand GROUP BY 1), r AS (SELECT unnest([0, 1]) AS rollout),
e AS (SELECT sample_id, rollout, n, kind, CASE kind WHEN 0 THEN 1 WHEN 3 THEN least(n, 4) WHEN 4 THEN least(n, 6) ELSE 0 END AS chosen FROM n CROSS JOIN r)
SELECT sample_id, rollout::INT AS rollout, array_to_string(range(1, chosen + 1), ',') AS selected, CASE kind WHEN 0 THEN 4 WHEN 3 THEN chosen + 1 WHEN 4 THEN least(n + 1, 6) ELSE 1 END::INT AS n_steps,
    CASE kind WHEN 0 THEN 'stalled_after_duplicate' WHEN 1 THEN 'parse_none' WHEN 2 THEN 'stop' WHEN 3 THEN 'stop' ELSE CASE WHEN n < 6 THEN 'stop' ELSE 'max_steps' END END AS done_reason, CASE kind WHEN 0 THEN 3 ELSE 0 END::INT AS duplicates,
    CASE WHEN rollout = 0 THEN array_to_string(range(1, chosen + 1), ',') END AS together
FROM e""")
def _(v: Views) -> DataFrame:
    """Two rollouts of every sample with the scripted agent, and what they have together beside the first."""
    found = rollouts.Rollouts(rollout_samples(v), scripted_agent, n_rollouts=2, max_steps=6, max_stalled=3).run()
    text_of = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    both = ranking.rollout_union(rollouts.selections(found)).groupBy(KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "idx"))), lambda s: s["idx"]).alias("ids"))
    out = found.join(both, KEY, "left").withColumn("together", F.when(F.col("rollout") == 0, F.coalesce(text_of(F.col("ids")), F.lit(""))))
    return out.select(KEY, "rollout", text_of(F.col("selected")).alias("selected"), "n_steps", "done_reason", "duplicates", "together")


@query("s2_stream_events", "S2 U2", None)
def _(v: Views) -> DataFrame:
    from loomgraph.streaming.episodes import episode_events

    return episode_events(v.view("episode_turn"), truths(v))


@query("s3_replay_steps", "S3 U1", None)
def _(v: Views) -> DataFrame:
    return episodes.replay_steps(v.view("episode_turn"), truths(v))


@query("s3_step_counts", "S3", f"WITH {_TURNS} SELECT tn.episode_id, count(*) AS n_steps FROM tn LEFT JOIN st USING (episode_id) WHERE st.k IS NULL OR tn.k <= st.k GROUP BY 1")
def _(v: Views) -> DataFrame:
    return episodes.replay_steps(v.view("episode_turn"), truths(v)).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_steps"))


@query("s4_stop_gate", "S4", None)
def _(v: Views) -> DataFrame:
    return episodes.replay_summaries(v.view("episode_turn"), truths(v))


# Selections among part.brand edges are stars around brands: an action is connected if its brand was chosen before, and
# components are brands with their parts, so that rewards have a closed form.
_STARS = """br AS (SELECT sample_id, head, tail AS brand, row_number() OVER (PARTITION BY sample_id ORDER BY min(triple_id)) AS idx FROM kg_edge WHERE relation = 'part.brand' GROUP BY 1, 2, 3), c AS MATERIALIZED (SELECT * FROM br WHERE idx <= 100),
ep AS (SELECT DISTINCT user_id AS episode_id, user_id % (SELECT count(*) FROM supplier) + 1 AS sample_id FROM events),
sup AS MATERIALIZED (SELECT DISTINCT c.sample_id, c.idx FROM c JOIN gold_path g ON g.sample_id = c.sample_id AND g.head = c.head AND g.relation = 'part.brand' AND g.tail = c.brand), ns AS (SELECT sample_id, count(*) AS support FROM sup GROUP BY 1),
tn AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY turn) - 1 AS step FROM episode_turn), st AS (SELECT episode_id, min(step) AS step FROM tn WHERE kind = 'STOP' GROUP BY 1),
act AS MATERIALIZED (SELECT tn.episode_id, ep.sample_id, tn.step, c.idx, c.brand, row_number() OVER (PARTITION BY tn.episode_id, c.idx ORDER BY tn.step) AS times FROM tn JOIN ep USING (episode_id) LEFT JOIN st USING (episode_id) LEFT JOIN c ON c.sample_id = ep.sample_id AND c.idx = tn.triple_id AND tn.kind = 'ADD_TRIPLE' WHERE st.step IS NULL OR tn.step < st.step),
sel AS MATERIALIZED (SELECT s.*, sup.idx IS NOT NULL AS good FROM act s LEFT JOIN sup USING (sample_id, idx) WHERE s.idx IS NOT NULL AND times = 1),
z AS (SELECT s.episode_id, s.step, s.sample_id, s.brand, s.good, p.brand AS pb, count(p.step) AS k FROM sel s LEFT JOIN sel p ON p.episode_id = s.episode_id AND p.step < s.step GROUP BY ALL),
y AS (SELECT episode_id, step, sample_id, good, coalesce(sum(k), 0) AS n, count(pb) AS b, coalesce(max(k), 0) AS m, coalesce(max(CASE WHEN pb = brand THEN k END), 0) AS own FROM z GROUP BY ALL),
x AS (SELECT y.*, CASE WHEN own = 0 THEN -1.5 ELSE (1.5 * CASE WHEN good THEN 1.0 / support ELSE 0 END + 0.2 * greatest(0, (greatest(m, own + 1) + 1) / (n + 1 + b) - (m + 1) / (n + b)) + 0.025) / log2(n + 2) - 0.05 * greatest(0, n + 1 - 14) END AS reward FROM y LEFT JOIN ns USING (sample_id)),
steps AS MATERIALIZED (SELECT act.episode_id, act.step, coalesce(x.reward, -2.0) AS reward, CASE WHEN act.idx IS NULL THEN 'invalid_action' WHEN act.times > 1 THEN 'duplicate_action' WHEN x.own = 0 THEN 'disconnected_action' WHEN x.good THEN 'support_gain' ELSE 'frontier_expand' END AS reason FROM act LEFT JOIN x ON act.times = 1 AND act.idx IS NOT NULL AND x.episode_id = act.episode_id AND x.step = act.step)"""


def star_truths(v: Views) -> DataFrame:
    """Truths whose candidates are the first part.brand edges of a sample."""
    n = v.table("supplier").agg(F.count(F.lit(1)).alias("n"))
    users = v.table("events").select(F.col("user_id").alias("episode_id")).distinct().crossJoin(n).select("episode_id", (F.col("episode_id") % F.col("n") + 1).alias(KEY))  # one row on the right
    cands = ranking.first_distinct(v.edges.where("relation = 'part.brand'"), 100)
    lists = listed(cands, v.view("gold_path"))
    answers = v.answers.groupBy(KEY).agg(F.sort_array(F.collect_list("answer")).alias("answers"))
    out = users.join(lists, KEY, "left").join(answers, KEY, "left").join(v.topics.withColumnRenamed("node", "topic"), KEY, "left")
    return out.select("episode_id", "candidates", "topic", "answers", "support", F.lit(14).alias("soft_limit"))


@query("s3_star_rewards", "S3 U1 S2", f"WITH {_STARS} SELECT episode_id, CAST(step AS INT) AS step, round(reward, 6)::DOUBLE AS reward, reason FROM steps")
def _(v: Views) -> DataFrame:
    found = episodes.replay_steps(v.view("episode_turn"), star_truths(v)).where("reason <> 'stop_action'")
    return found.select("episode_id", "step", F.round("reward", 6).alias("reward"), "reason")


@query("s4_star_gates", "S4 S3 C13", f"""WITH {_STARS}, e AS (SELECT DISTINCT episode_id, sample_id FROM tn JOIN ep USING (episode_id)), na AS (SELECT sample_id, count(*) AS answers FROM kg_answer GROUP BY 1), w AS (SELECT episode_id, brand, count(*) AS k, sum(CASE WHEN good THEN 1 ELSE 0 END) AS g FROM sel GROUP BY 1, 2),
t AS (SELECT e.episode_id, e.sample_id, coalesce(sum(k), 0) AS n, coalesce((max(k) + 1) / (sum(k) + count(brand)), 0) AS conn, coalesce(sum(g), 0) AS g, count(a.answer) AS hits FROM e LEFT JOIN w USING (episode_id) LEFT JOIN kg_answer a ON a.sample_id = e.sample_id AND a.answer = w.brand GROUP BY 1, 2),
r AS (SELECT t.*, coalesce(hits / answers, 0) AS a, coalesce(g / support, 0) AS s, answers, st.step IS NOT NULL AS stopped FROM t LEFT JOIN na USING (sample_id) LEFT JOIN ns USING (sample_id) LEFT JOIN st USING (episode_id)),
o AS (SELECT *, (hits >= 1 OR a >= 1) AND n >= 2 AND conn >= 0.6 AS allowed FROM r)
SELECT episode_id, CAST(n AS INT) AS n_selected, round(coalesce((SELECT sum(reward) FROM steps WHERE steps.episode_id = o.episode_id), 0), 6)::DOUBLE AS step_reward_sum, stopped AS stop_seen, round(CASE WHEN stopped THEN -0.3 + 0.8 * a + 0.5 * s + 0.1 * conn - CASE WHEN allowed THEN 0 ELSE 3 END - CASE WHEN answers > 0 AND a < 1 THEN 2.5 * (1 - a) ELSE 0 END ELSE 0 END, 6)::DOUBLE AS stop_reward, allowed, round(a, 6)::DOUBLE AS answer_recall, round(s, 6)::DOUBLE AS support_recall, round(conn, 6)::DOUBLE AS connectivity FROM o""")
def _(v: Views) -> DataFrame:
    found = episodes.replay_summaries(v.view("episode_turn"), star_truths(v))
    return found.select("episode_id", "n_selected", "stop_seen", "allowed", *[F.round(c, 6).alias(c) for c in ("step_reward_sum", "stop_reward", "answer_recall", "support_recall", "connectivity")])


@query("s5_final_reward", "S5", "SELECT l_orderkey AS id, l_linenumber AS n, round(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 0.8 * l_discount + 0.05 * l_tax END + 0.05 * (l_partkey % 11) / 10 + 0.05 * ((l_suppkey % 5) / 2 - 1) + 0.05 * (l_quantity / 50), 6)::DOUBLE + 0.0 AS score FROM lineitem")
def _(v: Views) -> DataFrame:
    score = episodes.final_reward(F.col("l_discount"), F.col("l_partkey") % 11 / 10, F.col("l_suppkey") % 5 / 2 - 1, F.col("l_quantity") / 50, F.col("l_tax"), F.col("l_returnflag") != "R")
    return v.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.round(score, 6).alias("score"))


@query("h12_transmission", "H12", "WITH x AS (SELECT l_orderkey AS id, l_linenumber AS n, l_linenumber > 2 AS taken, l_partkey % 3 = 0 AS told, l_discount > 0.05 AS parsed, l_quantity >= 10 AS played, l_tax <> 0 AS sent FROM lineitem) SELECT id, n, CASE WHEN taken AND NOT played THEN 'accepted_but_replay_empty' WHEN taken AND NOT sent THEN 'accepted_but_remote_empty' WHEN NOT taken AND NOT played THEN CASE WHEN parsed OR told THEN 'parsed_not_accepted' ELSE 'no_selection' END ELSE 'ok' END AS diagnosis FROM x")
def _(v: Views) -> DataFrame:
    d = episodes.transmission((F.col("l_linenumber") > 2).cast("int"), (F.col("l_partkey") % 3 == 0).cast("int"), (F.col("l_discount") > 0.05).cast("int"), (F.col("l_quantity") >= 10).cast("int"), (F.col("l_tax") != 0).cast("int"))
    return v.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), d.alias("diagnosis"))


_SAYS = """CASE WHEN kind = 'STOP' THEN '{{"action": "STOP"}}' WHEN kind = 'INVALID' THEN 'no idea' ELSE CASE form WHEN 0 THEN '{{"action": "ADD_TRIPLE", "triple_id": ' || {id} || '}}'
    WHEN 1 THEN '{{"triple_id": "' || {id} || '"}}' WHEN 2 THEN '{{"why": 1, "triple_id": ' || {id} || '.0}}' WHEN 3 THEN 'I take ' || {id} || ' now' WHEN 4 THEN '<think>{{"action": 3}} STOP</think> so: {{"action": "ADD_TRIPLE", "triple_id": ' || {id} || '}}' ELSE '{{"other": ' || {id} || '}}' END END"""


@query("h10_action_rows", "H8 H10 U1", f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY turn) AS n FROM episode_turn), y AS (SELECT *, n % 6 AS form FROM x), z AS (SELECT * FROM y WHERE kind = 'STOP' OR kind = 'ADD_TRIPLE' AND form <> 5)
SELECT episode_id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY turn) - 1 AS INT) AS place, kind AS action, CASE WHEN kind = 'ADD_TRIPLE' THEN triple_id END::BIGINT AS triple_id,
    CASE WHEN kind = 'STOP' THEN 'json_action' ELSE CASE form WHEN 3 THEN 'token_fallback' WHEN 0 THEN 'json_action_sft' WHEN 1 THEN 'json_action_sft' ELSE 'json_action_sft_fallback' END END AS source,
    md5(CASE WHEN kind = 'ADD_TRIPLE' AND form = 3 THEN triple_id::VARCHAR WHEN kind = 'ADD_TRIPLE' AND form = 4 THEN substr({_SAYS.format(id='triple_id::VARCHAR')}, 35) ELSE {_SAYS.format(id='triple_id::VARCHAR')} END) AS segment FROM z""")
def _(v: Views) -> DataFrame:
    """Every action of every dialogue as a row, by the table function."""
    from loomgraph.functions import actions

    numbered = v.view("episode_turn").withColumn("form", F.row_number().over(W.partitionBy("episode_id").orderBy("turn")) % 6)
    said = numbered.select("episode_id", "turn", F.concat(F.lit("Assistant \n"), F.expr(_SAYS.format(id="cast(triple_id AS string)")), F.lit("\nuser\nnext 7")).alias("said"))
    dialogues = said.groupBy("episode_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "said"))), lambda s: s["said"]), "\n").alias("text"))
    return actions.action_rows(dialogues, "text", 1 << 30).select("episode_id", "place", "action", "triple_id", "source", F.md5("segment").alias("segment"))


@query("c16_contained", "C16", "SELECT p.id, p.n, lower(g.answer) AS pattern FROM qa_pred p JOIN (SELECT DISTINCT id, answer FROM qa_gold) g ON g.id = p.id AND contains(lower(p.line), lower(g.answer))")
def _(v: Views) -> DataFrame:
    """Every pair of a predicted line and an answer of its question that it holds."""
    lines = v.view("qa_pred").select(F.col("id").alias("q"), F.col("n").cast("long").alias("id"), F.lower("line").alias("text"))
    found = containment.contained(lines, v.view("qa_gold").select(F.col("id").alias("q"), F.lower("answer").alias("pattern")), ["q"])
    return found.select(F.col("q").alias("id"), F.col("id").alias("n"), "pattern")


@query("c18_members", "C18", "WITH e AS (SELECT DISTINCT p_size AS k, lower(split_part(p_name, ' ', 1)) AS e FROM part WHERE p_partkey % 3 = 0), l AS (SELECT p_partkey AS id, p_size AS k, lower(p_name) AS line, lower(left(p_name, 4)) AS a FROM part) SELECT id FROM l WHERE EXISTS (SELECT 1 FROM e WHERE e.k = l.k AND (contains(l.line, e.e) OR contains(e.e, l.a)))")
def _(v: Views) -> DataFrame:
    """Part names that hold the first word of a third of the parts of their size, or begin within one."""
    parts = v.table("part")
    entities = parts.where("p_partkey % 3 = 0").select(F.col("p_size").alias("k"), F.split("p_name", " ")[0].alias("entity"))
    lines = parts.select(F.col("p_size").alias("k"), F.col("p_partkey").alias("id"), F.col("p_name").alias("line"), F.left("p_name", F.lit(4)).alias("answer"))
    return containment.fuzzy_members(lines, entities, ["k"]).select("id")


_SAID = "row_number() OVER (PARTITION BY episode_id ORDER BY turn) % 6"


@query("h8_h11_actions", "H8 H9 H10 H11", f"WITH x AS (SELECT episode_id, turn, kind, triple_id, {_SAID} AS form FROM episode_turn), y AS (SELECT *, CASE WHEN kind = 'INVALID' THEN 0 WHEN kind = 'STOP' THEN 1 WHEN form = 5 THEN 0 ELSE 1 END AS acts FROM x) SELECT episode_id, sum(acts)::BIGINT AS n_actions, count(*) FILTER (kind = 'STOP') AS n_stops, sum(CASE WHEN kind = 'ADD_TRIPLE' AND acts = 1 THEN triple_id ELSE 0 END)::BIGINT AS ids, count(*) FILTER (kind = 'STOP' OR kind = 'ADD_TRIPLE' AND form IN (0, 1)) AS strict, count(*) FILTER (kind = 'ADD_TRIPLE' AND form = 3) AS tokens, max(turn) AS history, (list(CASE WHEN kind = 'INVALID' THEN NULL WHEN kind = 'STOP' THEN 'STOP' WHEN triple_id <= 50 THEN CAST(triple_id AS VARCHAR) WHEN form IN (0, 4) THEN 'STOP' END ORDER BY turn))[-1] AS agent FROM y GROUP BY 1")
def _(v: Views) -> DataFrame:
    """A dialogue an episode, its actions in six forms: strict objects, one with another key, a token, one after a thought, an object that is no action."""
    import json

    import pyarrow as pa

    from loomgraph.functions import actions

    form = F.row_number().over(W.partitionBy("episode_id").orderBy("turn")) % 6
    rows = v.view("episode_turn").withColumn("form", form).groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("turn", "kind", "triple_id", "form"))).alias("t"))

    def said(t: dict) -> str:
        n = t["triple_id"]
        if t["kind"] != "ADD_TRIPLE":
            return json.dumps({"action": "STOP"}) if t["kind"] == "STOP" else "no idea"
        forms = ({"action": "ADD_TRIPLE", "triple_id": n}, {"triple_id": str(n)}, {"triple_id": float(n), "why": 1}, None, None, {"other": n})
        return {3: f"I take {n} now", 4: f'<think>{{"action": 3}} STOP</think> so: {json.dumps({"action": "ADD_TRIPLE", "triple_id": n})}'}.get(t["form"]) or json.dumps(forms[t["form"]])

    def run(batches):
        known = {k: (f"h{k}", "r", f"t{k}") for k in range(1, 51)}
        # the turns of a batch are objects of Python: so many dialogues at a time
        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            out = []
            for episode, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = "\n".join(f"Assistant \n{said(t)}\nuser\nnext 7" for t in turns) + "".join(f'\ntool\n{{"accepted_action_history": [{t["turn"]}]}}' for t in turns)
                trace, _ = actions.action_trace(actions.solution_text(text, "assistant"), 1 << 30)
                chosen = actions.agent_action(said(turns[-1]), known) if turns[-1]["form"] not in (1, 2, 5) or turns[-1]["kind"] != "ADD_TRIPLE" else actions.agent_action(f"[{turns[-1]['triple_id']}] (h, r, t)", known)
                out.append((episode, len(trace), sum(p.action == "STOP" for p in trace), sum(p.action for p in trace if p.action != "STOP"), sum("fallback" not in p.source for p in trace), sum(p.source == actions.TOKEN for p in trace), actions.accepted_history(text)[0], None if chosen is None else str(chosen)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 7 + [pa.string()], strict=True)], ["episode_id", "n_actions", "n_stops", "ids", "strict", "tokens", "history", "agent"])

    return rows.mapInArrow(run, "episode_id long, n_actions long, n_stops long, ids long, strict long, tokens long, history long, agent string")
