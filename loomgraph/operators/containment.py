"""Which texts contain which patterns, key by key, by automata that scan each text once.

Patterns and texts of a key meet in one task in the order patterns, texts: the patterns of a
key become an automaton, and its texts stream past it. A key with more than ``BLOCK`` patterns
has several automata, and one with more than ``DEAL`` texts is dealt to several tasks, so what a
task holds is bounded, and no pair is looked at that doesn't match.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, DEAL, FEW = 20_000, 100_000, 4


def _finder(patterns: list[str]):
    """text -> places of the patterns in it; the empty pattern is in every text."""
    if len(patterns) <= FEW:
        return lambda text: [k for k, p in enumerate(patterns) if p in text]
    automaton = ahocorasick.Automaton()
    everywhere = [k for k, p in enumerate(patterns) if not p]
    for k, p in enumerate(patterns):
        if p:
            automaton.add_word(p, k)
    automaton.make_automaton()
    return lambda text: sorted({k for _, k in automaton.iter(text)}.union(everywhere))


def _spread(rows: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """(keys, name) of the keys with more than ``most`` rows: the number of parts they need."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias(name))


def contained(texts: DataFrame, patterns: DataFrame, keys: list[str], block: int = BLOCK, deal: int = DEAL, pairs: bool = True) -> DataFrame:
    """(keys, id, pattern) of texts (keys, id, text) and the distinct patterns (keys, pattern) in them; without pairs (keys, id) of the texts that have any.

    Null keys, texts and patterns match nothing; repeated texts give repeated rows of pairs.
    """
    patterns = patterns.select(*keys, "pattern").where(F.col("pattern").isNotNull()).distinct()
    texts = texts.select(*keys, "id", "text").where(F.col("text").isNotNull())
    many_patterns, many_texts = _spread(patterns, keys, block, "blocks"), _spread(texts, keys, deal, "deals")

    def parted(rows: DataFrame, salt: Column) -> DataFrame:
        rows = rows.join(many_patterns.hint("shuffle_hash"), keys, "left").join(many_texts.hint("shuffle_hash"), keys, "left")  # keys with many are few
        return rows.withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "deals": F.coalesce("deals", F.lit(1))}).withColumn("salt", salt)

    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    kind = texts.schema["id"].dataType.simpleString()
    p = parted(patterns, F.xxhash64("pattern")).withColumn("block", F.pmod("salt", "blocks").cast("int")).withColumn("deal", every("deals"))
    t = parted(texts, F.xxhash64("id", "text")).withColumn("deal", F.pmod("salt", "deals").cast("int")).withColumn("block", every("blocks"))
    both = p.select(*keys, "block", "deal", F.lit(0).alias("side"), F.lit(None).cast(kind).alias("id"), F.col("pattern").alias("value")).unionByName(t.select(*keys, "block", "deal", F.lit(1).alias("side"), "id", F.col("text").alias("value")))
    place = [*keys, "block", "deal"]
    n = len(place)

    def run(batches: Iterator[pa.RecordBatch]):
        now, own, find = None, [], None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            hits, found = [], []
            for k, key in enumerate(zip(*columns[:n], strict=True)):
                if key != now:
                    now, own, find = key, [], None
                if columns[n][k] == 0:
                    own.append(columns[n + 2][k])
                elif own:
                    find = find or _finder(own)
                    at = find(columns[n + 2][k])
                    hits += [k] * (len(at) if pairs else bool(at))
                    found += [own[x] for x in at] if pairs else []
            taken = batch.take(pa.array(hits, pa.int64()))
            out = [*taken.columns[: n - 2], taken.column(n + 1)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(found, pa.string())] if pairs else out, [*keys, "id", *(["pattern"] if pairs else [])])

    schema = ", ".join([f"`{c}` {both.schema[c].dataType.simpleString()}" for c in [*keys, "id"]] + (["pattern string"] if pairs else []))
    met = both.repartition(*place).sortWithinPartitions(*place, "side").mapInArrow(run, schema)
    return met if pairs else met.distinct()


def fuzzy_members(lines: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id) of lines (keys, id, line, answer) that hold an entity (keys, entity), or whose answer is part of one; lower case only."""
    low = entities.select(*keys, F.lower("entity").alias("entity")).where(F.col("entity").isNotNull()).distinct()
    held = contained(lines.select(*keys, "id", F.lower("line").alias("text")), low.withColumnRenamed("entity", "pattern"), keys, pairs=False)
    answers = lines.select(*keys, "id", F.lower("answer").alias("pattern"))
    inside = contained(low.select(*keys, F.lit(0).alias("id"), F.col("entity").alias("text")), answers, keys).select(*keys, "pattern").distinct()
    return held.unionByName(answers.join(inside, [*keys, "pattern"], "left_semi").select(*keys, "id")).distinct()
