"""Readers and sinks of the engine's tables. Paths are Spark paths; nothing here opens a local file."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import schema
from loomgraph.functions.text import strip
from loomgraph.sources.storage import checkpointed

#: Other names of splits.
SPLIT_NAMES = {"val": "validation"}
SPLITS = ("train", "val", "test")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def first_path(spark: SparkSession, *paths: str) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def scan_split(table: DataFrame, split: str, column: str = "split") -> DataFrame:
    """Rows of one split; ``val`` also goes by ``validation``."""
    return table.where(F.col(column).isin(split, SPLIT_NAMES.get(split, split)))


def edges_of(samples: DataFrame, graph: str = "graph") -> DataFrame:
    """(sample_id, triple_id, head, relation, tail) of nested graphs, in their order."""
    rows = samples.select(F.col("id").alias("sample_id"), F.posexplode(graph).alias("triple_id", "e"))
    return rows.select("sample_id", "triple_id", F.col("e.h").alias("head"), F.col("e.r").alias("relation"), F.col("e.t").alias("tail"))


def entity_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank lines."""
    return spark.read.text(path).select(strip(F.col("value")).alias("entity")).where("entity != ''").distinct()


def exclude_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct ids over all files; blank lines and lines that begin with # are left out."""
    return spark.read.text(paths).select(strip(F.col("value")).alias("id")).where("id != '' and not startswith(id, '#')").distinct()


def materialized(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written first if there is none."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def retrieval_results(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Results of a split; test falls back to ``retrieval_result_test``; none is an error."""
    path = first_path(spark, f"{root}/{split}", *([f"{root}/retrieval_result_test"] if split == "test" else []))
    if path is None:
        raise FileNotFoundError(f"no retrieval results of {split} in {root}")
    return spark.read.schema(schema.RETRIEVAL_RESULT).parquet(path)


def supervision(spark: SparkSession, silver: str, gold: str) -> DataFrame:
    """Silver labels, else gold, else an empty table."""
    path = first_path(spark, silver, gold)
    return spark.read.schema(schema.SUPERVISION).json(path) if path else spark.createDataFrame([], schema.SUPERVISION)


def gold_paths(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema.GOLD_PATHS).json(path)


def path_triples(gold: DataFrame) -> DataFrame:
    """(sample_id, path, place, head, relation, tail, answer_entity) of gold paths."""
    rows = gold.select("sample_id", F.posexplode("paths").alias("path", "p")).select("sample_id", "path", "p.answer_entity", F.posexplode("p.path_triplets").alias("place", "t"))
    return rows.select("sample_id", "path", "place", "t.head", "t.relation", "t.tail", "answer_entity")


def write_records(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, UTF-8."""
    rows.write.mode(mode).json(path)


def read_records(spark: SparkSession, path: str, kind: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, lines that can't be read); strict raises at such a line instead."""
    if strict:
        return spark.read.schema(kind).option("mode", "FAILFAST").json(path), spark.createDataFrame([], "line string")
    return parse_records(spark.read.text(path).select(F.col("value").alias("line")), kind)


def parse_records(lines: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    wide = f"{kind}, _bad string"
    names = T.StructType.fromDDL(kind).names
    parsed = lines.where("trim(line) != ''").withColumn("r", F.from_json("line", wide, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"r.{n}") for n in names]), parsed.where(bad).select("line")


#: Splits whose counts may be broadcast; with more of them the lines are joined by shuffling.
BROADCAST_SPLITS = 50_000


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, folder_line_no, line): lines as they lie in their files, counted from 1 in each, and through all files by name.

    Lines are counted a split of a file, where Spark reads them anyway; the sums
    before each split come from the table of splits, and a line's number is that sum and its
    place in the split. Files are read twice, in parallel, and no line is sorted.
    Empty lines count; a line longer than a split belongs to the split it begins in.
    """
    import numpy as np
    import pyarrow as pa

    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    counts = checkpointed(lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n")))
    by_file = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    within = counts.withColumn("in_file", F.coalesce(F.sum("n").over(by_file), F.lit(0)))
    files = counts.groupBy("file").agg(F.sum("n").alias("lines"))
    files = files.withColumn("in_folder", F.coalesce(F.sum("lines").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("file", "in_folder")  # a row a file
    before = within.join(files, "file").select("file", "split", "in_file", "in_folder")
    if counts.count() <= BROADCAST_SPLITS:
        before = F.broadcast(before)

    def run(batches):
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # a task reads its splits one after another, each from its first line to its last
            files, splits = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            code = files.indices.to_numpy()
            new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (splits[1:] != splits[:-1])))
            place = np.arange(batch.num_rows) - np.repeat(new, np.diff(np.append(new, batch.num_rows)))
            head = (batch.column(0)[0].as_py(), int(splits[0]))
            if head == last:
                place[: new[1] if len(new) > 1 else batch.num_rows] += seen
            last, seen = (batch.column(0)[batch.num_rows - 1].as_py(), int(splits[-1])), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], ["file", "split", "line", "place"])

    placed = lines.mapInArrow(run, "file string, split long, line string, place long")
    out = placed.join(before, ["file", "split"])
    in_file = F.col("in_file") + F.col("place") + 1
    return out.select("file", in_file.alias("line_no"), (F.col("in_folder") + in_file).alias("folder_line_no"), "line")


def log_records(spark: SparkSession, path: str, kind: str, chunk: int, first: int = 0, last: int | None = None) -> DataFrame:
    """(line_no, step, record) of a log of JSON lines, cut to the steps from first to last; a line that can't be read is an error."""
    rows = log_steps(numbered_lines(spark, path).withColumn("line_no", F.col("folder_line_no")), chunk, first, last)
    return rows.select("line_no", "step", F.from_json("line", kind, {"mode": "FAILFAST"}).alias("record"))


def log_steps(log: DataFrame, chunk: int, first: int = 0, last: int | None = None) -> DataFrame:
    """log (line_no from 1) with step = (line_no - 1) div chunk, cut to the steps from first to last."""
    out = log.withColumn("step", F.floor((F.col("line_no") - 1) / chunk).cast("int")).where(F.col("step") >= first)
    return out if last is None else out.where(F.col("step") <= last)


def resumed(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id has no output yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def shard(rows: DataFrame, key: str, shards: int, index: int) -> DataFrame:
    """Rows of shard index: keys in order, dealt in turn.

    A key's place is its place in its range of keys plus the sizes of the
    ranges before it, so only the sizes (one a partition) meet in one task. The
    ranges are written to the shared folder, since they are cut by sampling.
    """
    ranges = checkpointed(rows.select(key).distinct().repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("_range").orderBy(key)) - 1 + F.col("_before")
    own = ranges.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn("_n", place)  # as many rows as partitions
    return rows.join(own.where(F.col("_n") % shards == index).select(key), key, "left_semi")


def merged_shards(shards: list[DataFrame], key: str = "id") -> DataFrame:
    """All shards; an id in more than one is an error when the rows are read."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    guarded = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate id "), F.col(key).cast("string"))).cast("string")).otherwise(F.col(key).cast("string"))
    return out.withColumn(key, guarded.cast(out.schema[key].dataType))


def eval_subgraphs(results: DataFrame, k: int, need_answer: bool) -> DataFrame:
    """(id, question, topic_entities, triplets): the first k distinct triples of each sample; without answers only if not needed."""
    rows = results.where(F.size("a_entity_in_graph") > 0) if need_answer else results
    cleaned = F.array_distinct(F.transform("scored_triples", lambda t: F.array(strip(t["head"]), strip(t["relation"]), strip(t["tail"]))))
    return rows.select(F.col("sample_id").alias("id"), "question", F.col("q_entity_in_graph").alias("topic_entities"), F.slice(cleaned, 1, k).alias("triplets"))


def exported_results(agent: DataFrame, original: DataFrame, subgraphs: DataFrame) -> DataFrame:
    """(id, question, q_entity, a_entity, max_path_length) of agent rows (id) that a subgraph describes.

    A subgraph (key, id, question, topic_entities, answer_entities) belongs to
    a row by its key, else by its inner id (the smallest key of several); rows
    without one are left out. Its empty fields fall back to the original
    retrieval's, which comes first for entities; max_path_length falls back to 1.
    """
    kept = ["question", "topic_entities", "answer_entities"]
    by_key = subgraphs.select(F.col("key").alias("id"), F.struct(*kept).alias("_key"))
    inner = subgraphs.groupBy(F.coalesce("id", "key").alias("id")).agg(F.min_by(F.struct(*kept), "key").alias("_inner"))
    rows = agent.select("id").distinct().join(by_key, "id", "left").join(inner, "id", "left").withColumn("r", F.coalesce("_key", "_inner")).where("r is not null")
    out = rows.join(original.select(F.col("sample_id").alias("id"), F.struct("question", "q_entity", "a_entity", "max_path_length").alias("o")), "id", "left")
    none = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, c)
    question = F.coalesce(F.nullif("r.question", F.lit("")), "o.question")
    return out.select("id", question.alias("question"), F.coalesce(none(F.col("o.q_entity")), "r.topic_entities").alias("q_entity"), F.coalesce(none(F.col("o.a_entity")), "r.answer_entities").alias("a_entity"), F.coalesce(F.nullif("o.max_path_length", F.lit(0)), F.lit(1)).alias("max_path_length"))


def feature_cache(rows: DataFrame, path: str) -> None:
    """Candidate features, one folder a split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def training_view(cache: DataFrame, answers: DataFrame, split: str = "train", only_positive: bool | None = None, limit: int | None = None, extra_copies: int = 0) -> DataFrame:
    """Samples (sample_id, copy) of a cache: with positives (train only, unless said), the first limit, those of two or more answers repeated."""
    only_positive = split == "train" if only_positive is None else only_positive
    samples = cache.groupBy("sample_id").agg(F.max((F.col("label") > 0).cast("int")).alias("positive"))
    samples = samples.where("positive = 1") if only_positive else samples
    samples = samples.select("sample_id")
    samples = samples.orderBy("sample_id").limit(limit) if limit is not None else samples
    n = answers.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    copies = F.when(F.col("n") >= 2, F.lit(extra_copies)).otherwise(0)
    return samples.join(n, "sample_id", "left").select("sample_id", F.explode(F.sequence(F.lit(0), copies)).alias("copy"))


def sample_limits(raw: str | None, splits: tuple[str, ...] = SPLITS) -> dict[str, int]:
    """{"train": 10} with known splits and limits of 0 or more."""
    out = json.loads(raw) if raw else {}
    for k, v in out.items():
        if k not in splits or not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise ValueError(f"bad limit {k!r}: {v!r}")
    return out


def dataset_info(names: Mapping[str, str], columns: Mapping[str, str]) -> dict:
    """Descriptors of training files for an outside trainer: file and column roles."""
    return {name: {"file_name": path, "columns": dict(columns)} for name, path in names.items()}


@dataclass(frozen=True)
class RetrievalConfig:
    """Typed settings; unknown keys and wrong types are errors."""

    task: str = "retriever"
    dataset: str = "webqsp"
    max_k: int = 500
    rounds: int = 2
    backward_rounds: int = 2
    distance_cap: int = 6
    cutoffs: tuple[int, ...] = (50, 100, 200, 400)
    bridge_label: float = 0.7
    seed: int = 42

    @staticmethod
    def load(values: Mapping, task: str = "retriever") -> RetrievalConfig:
        known = {f.name: f for f in fields(RetrievalConfig)}
        values = {("bridge_label" if k == "silver_label" else k): v for k, v in values.items()}  # an older name
        odd = set(values) - set(known)
        if odd:
            raise ValueError(f"unknown settings {sorted(odd)}")
        if values.get("task", task) != task:
            raise ValueError(f"settings are for task {values['task']!r}")
        out = {}
        for k, v in values.items():
            default = known[k].default
            if isinstance(default, tuple):
                v = tuple(int(x) for x in v.split(",")) if isinstance(v, str) else tuple(v)
            elif isinstance(default, float) and isinstance(v, int):
                v = float(v)
            elif not isinstance(v, type(default)) or isinstance(v, bool):
                raise ValueError(f"{k} must be {type(default).__name__}")
            out[k] = v
        return RetrievalConfig(**out)
