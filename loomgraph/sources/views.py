"""Views of the star-schema tables as knowledge-graph question-answering inputs.

The same SQL text builds them in Spark and in an oracle engine; samples are
suppliers, a topic is the supplier's node, answers are brands of returned parts.
"""

from __future__ import annotations

import re
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.sources.storage import laid, stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "kg_edge": """
SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY head, relation, tail, src) - 1 AS INT) AS triple_id, head, relation, tail, logit
FROM (
  SELECT l_suppkey AS sample_id, concat('S', CAST(l_suppkey AS STRING)) AS head, 'supplier.part' AS relation, concat('P', CAST(l_partkey AS STRING)) AS tail, (l_quantity - 25.5) / 10.0 AS logit,
         concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':', CAST(CAST(l_quantity AS INT) AS STRING), ':', CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS STRING)) AS src
  FROM lineitem
  UNION ALL
  SELECT l_suppkey, concat('P', CAST(l_partkey AS STRING)), 'part.brand', p_brand, (p_size - 25.5) / 10.0, ''
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x JOIN part ON l_partkey = p_partkey
  UNION ALL
  SELECT s_suppkey, concat('S', CAST(s_suppkey AS STRING)), 'supplier.nation', n_name, 2.0, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT s_suppkey, n_name, 'nation.region', r_name, 1.0, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
) u""",
    "kg_answer": "SELECT DISTINCT l_suppkey AS sample_id, p_brand AS answer FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity = 50",
    "gold_label": """
SELECT DISTINCT l_suppkey AS sample_id, concat('S', CAST(l_suppkey AS STRING)) AS head, 'supplier.part' AS relation, concat('P', CAST(l_partkey AS STRING)) AS tail,
       CASE WHEN l_returnflag = 'R' AND l_quantity = 50 THEN 'direct_support' WHEN l_returnflag = 'A' AND l_quantity >= 49 THEN 'bridge' ELSE 'weak_support' END AS label
FROM lineitem WHERE l_quantity >= 49""",
    "topic": "SELECT s_suppkey AS sample_id, concat('S', CAST(s_suppkey AS STRING)) AS node FROM supplier",
    "qa_pred": "SELECT l_orderkey AS id, l_linenumber AS n, concat('ans: ', replace(p_name, 'cold ', 'cool ')) AS line FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3",
    "qa_gold": "SELECT DISTINCT l_orderkey AS id, replace(p_name, 'cold ', 'cool ') AS answer FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'",
    "gold_path": """
SELECT l_suppkey AS sample_id, CAST(dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS INT) AS path, place, head, relation, tail
FROM (
  SELECT DISTINCT l_suppkey, l_partkey, 0 AS place, concat('S', CAST(l_suppkey AS STRING)) AS head, 'supplier.part' AS relation, concat('P', CAST(l_partkey AS STRING)) AS tail
  FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'
  UNION ALL
  SELECT DISTINCT l_suppkey, l_partkey, 1, concat('P', CAST(l_partkey AS STRING)), 'part.brand', p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 AND l_returnflag = 'R'
) g""",
    "chain_edge": """
SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY head, tail, relation) - 1 AS INT) AS triple_id, head, relation, tail
FROM (
  SELECT a.sample_id, a.node AS head, 'next' AS relation, b.node AS tail FROM chain_node a JOIN chain_node b ON a.sample_id = b.sample_id AND b.n = a.n + 1 WHERE a.sample_id % 3 <> 2 OR a.n <> 9
  UNION ALL
  SELECT a.sample_id, a.node, 'again', b.node FROM chain_node a JOIN chain_node b ON a.sample_id = b.sample_id AND b.n = a.n + 1 WHERE a.n % 4 = a.sample_id % 4
  UNION ALL
  SELECT a.sample_id, a.node, 'back', b.node FROM chain_node a JOIN chain_node b ON a.sample_id = b.sample_id AND b.n = a.n - 3 WHERE a.n % 3 = a.sample_id % 3
  UNION ALL
  SELECT a.sample_id, a.node, 'leap', b.node FROM chain_node a JOIN chain_node b ON a.sample_id = b.sample_id AND b.n = a.n + 2 WHERE a.n % 5 = a.sample_id % 7
) u""",
    "chain_node": "SELECT CAST(floor(c_custkey / 12) AS BIGINT) AS sample_id, CAST(c_custkey % 12 AS INT) AS n, concat('C', CAST(c_custkey AS STRING)) AS node FROM customer",
    "episode_turn": """
SELECT user_id AS episode_id, event_id AS turn, CASE WHEN event_type = 'purchase' THEN 'STOP' WHEN event_type = 'error' THEN 'INVALID' ELSE 'ADD_TRIPLE' END AS kind,
       CAST(json_k AS INT) + 1 AS triple_id
FROM (SELECT user_id, event_id, event_type, get_json_object(props, '$.k') AS json_k FROM events) e""",
}


def oracle_view(name: str) -> str:
    """The view in the oracle's dialect."""
    return re.sub(r"get_json_object\(", "json_extract_string(", VIEWS[name].replace("AS STRING)", "AS VARCHAR)"))


def with_views(body: str) -> str:
    """A query with the views it names, and those they name, before it."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    names += [n for n in VIEWS if n not in names and any(re.search(rf"\b{n}\b", VIEWS[m]) for m in names)]
    names.sort(key=lambda n: any(re.search(rf"\b{m}\b", VIEWS[n]) for m in VIEWS if m != n))  # those that name no other first
    own = ", ".join(f"{n} AS ({oracle_view(n)})" for n in names)
    body = body.strip()
    if not own:
        return body
    return f"WITH RECURSIVE {own}, {body[15:].strip()}" if body.upper().startswith("WITH RECURSIVE") else f"WITH {own}, {body[5:].strip()}" if body.upper().startswith("WITH ") else f"WITH {own} {body}"


#: Lines of a part of the edges: about twice as many edges, whose sort stays well within the memory of a task.
LINES = 250_000


class Views:
    """Tables and views of one data folder as DataFrames; each is planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._made:
            used = [t for t in (*TABLES, *VIEWS) if re.search(rf"\b(FROM|JOIN)\s+{t}\b", VIEWS[name])]
            sql = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", r"\1 {\2}", VIEWS[name])
            self._made[name] = self.spark.sql(sql, **{t: self.view(t) if t in VIEWS else self.table(t) for t in used})
        return self._made[name]

    @cached_property
    def deals(self) -> int:
        """Parts that edges are dealt to by sample; it grows with the lines, so that no part does."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table("lineitem").count() // LINES))

    def dealt(self, name: str) -> DataFrame:
        """A view of samples, dealt as the edges are."""
        return self.view(name).repartition(self.deals, "sample_id")

    def _triples(self, src: bool) -> DataFrame:
        """kg_edge without numbers, dealt by sample: lines travel as numbers and become texts where they are; src, which orders equal triples, where asked for."""
        line, nations = self.table("lineitem"), self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        # both the set of pairs and its join are by part
        pairs = line.select("l_suppkey", "l_partkey").repartition(self.deals, "l_partkey").distinct().join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        own_src = {"o": "l_orderkey", "n": "l_linenumber", "q": "CAST(l_quantity AS INT)", "x": "CAST(round(l_extendedprice*100) AS BIGINT)"} if src else {}
        shapes = (
            (line, "l_suppkey", 0, {"part": "l_partkey", "logit": "(l_quantity - 25.5) / 10.0", **own_src}),
            (pairs, "l_suppkey", 1, {"part": "l_partkey", "name": "p_brand", "logit": "(p_size - 25.5) / 10.0"}),
            (nations, "s_suppkey", 2, {"name": "n_name", "logit": "2.0"}),
            (nations.join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")), "s_suppkey", 3, {"above": "n_name", "name": "r_name", "logit": "1.0"}),
        )
        kinds = {"part": "bigint", "above": "string", "name": "string", "logit": "double", **({"o": "bigint", "n": "bigint", "q": "int", "x": "bigint"} if src else {})}
        one = lambda key, kind, own: [F.expr(f"{key} AS sample_id"), F.lit(kind).alias("kind"), *[F.expr(f"CAST({own.get(c, 'NULL')} AS {t}) AS {c}") for c, t in kinds.items()]]
        rows = reduce(DataFrame.unionByName, [t.select(*one(key, kind, own)) for t, key, kind, own in shapes]).repartition(self.deals, "sample_id")
        return rows.selectExpr(
            "sample_id", "CASE kind WHEN 1 THEN concat('P', CAST(part AS STRING)) WHEN 3 THEN above ELSE concat('S', CAST(sample_id AS STRING)) END AS head",
            "CASE kind WHEN 0 THEN 'supplier.part' WHEN 1 THEN 'part.brand' WHEN 2 THEN 'supplier.nation' ELSE 'nation.region' END AS relation",
            "CASE kind WHEN 0 THEN concat('P', CAST(part AS STRING)) ELSE name END AS tail", "logit",
            *["CASE kind WHEN 0 THEN concat(CAST(o AS STRING), ':', CAST(n AS STRING), ':', CAST(q AS STRING), ':', CAST(x AS STRING)) ELSE '' END AS src"][: int(src)],
        )

    @cached_property
    def edges(self) -> DataFrame:
        """kg_edge, dealt by sample; windows and groups of a sample find it in place."""
        place = F.row_number().over(W.partitionBy("sample_id").orderBy("head", "relation", "tail", "src"))
        return self._triples(True).select("sample_id", (place - 1).cast("int").alias("triple_id"), "head", "relation", "tail", "logit")

    @cached_property
    def loose(self) -> DataFrame:
        """kg_edge without triple_id, dealt by sample, for what takes equal triples of one logit for each other: less travels."""
        return self._triples(False)

    def kept(self, *columns: str) -> DataFrame:
        """Columns of the edges, stored once for plans that read them many times."""
        return stored(self.edges.select(*columns)).repartition(self.deals, "sample_id")

    def lying(self, *columns: str) -> DataFrame:
        """Columns of the edges, stored once by sample for jobs run in_place()."""
        return laid(self.edges.select(*columns), "sample_id", self.deals)[0]

    @cached_property
    def scored(self) -> DataFrame:
        return self.edges.withColumn("score", 1 / (1 + F.exp(-F.col("logit"))))

    @cached_property
    def topics(self) -> DataFrame:
        return self.dealt("topic")

    @cached_property
    def answers(self) -> DataFrame:
        return self.dealt("kg_answer")

    @cached_property
    def predictions(self) -> DataFrame:
        """(id, question, ground_truth, prediction): lines in order, answers sorted."""
        p = self.view("qa_pred").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("prediction"))
        g = self.view("qa_gold").groupBy("id").agg(F.sort_array(F.collect_list("answer")).alias("ground_truth"))
        return p.join(g, "id").select("id", F.lit("which part was returned").alias("question"), "ground_truth", "prediction")
