"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions; each projection plus
an offset is cut into cells of width ``CELL``, and ``DEPTH`` cells together
are a bucket of one of ``TABLES`` tables. Vectors of equal labels that share a
bucket are compared exactly. At cosine 0.93 a pair shares a cell with
probability 0.80, a bucket with 0.80^10 = 0.11, and one of 24 tables with 0.93;
at 0.97 with 0.9999. Unrelated vectors share a bucket with about 1e-4.

Equal vectors are one class with a count. A bucket of more than ``BLOCK``
classes is cut into blocks, and each pair of blocks is a task's work of
bounded size, so a bucket that holds a third of all vectors spreads out. A
pair counts in the first table it shares, so of several buckets with the same
members only the first is compared, and a vector travels with its keys of
earlier tables only, in the element type of its column. Pairs are never listed:
a block pair gives each class its sum of links and a spanning forest.

Defined cases: vectors that are null, empty, zero, or hold a null or
non-finite component, and rows with a null label, link with nothing (their own
component, 0 links, kept); vectors of different length never link; rows that
repeat an id each count as a vector; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import blocks
from loomgraph.llm.components import components

THRESHOLD = 0.93
TABLES, DEPTH, CELL = 24, 10, 1.5
BLOCK = 512
_U = np.uint64


def _projections(dim: int, tables: int, depth: int, cell: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1_000_003 * dim + tables)
    return rng.standard_normal((dim, tables * depth)), rng.random(tables * depth) * cell


def bucket_keys(x: np.ndarray, tables: int = TABLES, depth: int = DEPTH, cell: float = CELL) -> np.ndarray:
    """64-bit bucket of each unit vector in each table."""
    a, b = _projections(x.shape[1], tables, depth, cell)
    cells = np.floor((x @ a + b) / cell).astype(np.int64).view(np.uint64).reshape(len(x), tables, depth)
    out = np.tile(np.arange(tables, dtype=np.uint64), (len(x), 1))
    for k in range(depth):
        out = blocks.mix(out * _U(0x9E3779B97F4A7C15) + cells[:, :, k])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vector_classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, class) of every row, class null where nothing links; (class, label_key, n, first_id, vector) of every class."""
    v = F.col("v")
    fine = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("class", F.when(fine, F.xxhash64("label", "v")))
    own = rows.select("vec_id", "class")
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.first(F.xxhash64("label")).alias("label_key"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.first("v").alias("v"))
    return own, classes


def link_counts(classes: DataFrame, element: np.dtype, threshold: float, tables: int, depth: int, cell: float, block: int) -> tuple[DataFrame, str]:
    """(class, links, other): links to add to a class, and links (class, other) that span what is found; and a folder that it reads.

    Components of vectors are exact in element.
    """

    def hashed(batches):
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                own = flat[at[rows][:, None] + np.arange(dim)]
                keys = bucket_keys(_unit(own), tables, depth, cell)
                x = own.astype(element)
                pick = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), batch.column(2).take(pick), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(keys.view(np.int64).tolist(), pa.list_(pa.int64()))], ["class", "label_key", "n", "x", "keys", "buckets"])

    unit, path = blocks.stored(classes.select("class", "label_key", "n", "v").mapInArrow(hashed, "class long, label_key long, n long, x binary, keys binary, buckets array<long>"), "vectors")
    entries = unit.select("class", "label_key", F.octet_length("x").alias("dim"), F.posexplode("buckets").alias("t", "bucket"))
    entries = entries.select("class", "t", F.xxhash64("label_key", "dim", "t", "bucket").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("t").alias("t"), F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("class")).alias("x")).where("m > 1")
    sizes = sizes.groupBy("m", "s", "x").agg(F.min_by("bucket", F.struct("t", "bucket")).alias("bucket")).select("bucket", "m")  # one for each set of members
    shared = entries.join(sizes, "bucket").select("class", "t", "bucket", F.ceil(F.col("m") / block).cast("int").alias("nb"))
    shared = shared.withColumn("i", F.pmod(F.xxhash64("class", "t"), F.col("nb")).cast("int"))
    cells = shared.select("class", "t", "bucket", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    cells = cells.select("class", "t", F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).alias("side"))
    placed = cells.join(unit.select("class", "n", "x", "keys"), "class").select("cell", "t", "side", "class", "n", "x", F.expr("substring(keys, 1, 8 * t)").alias("keys"))

    def compare(t, side, ids, n, x, keys):
        """One cell: sums of links and a spanning forest."""
        one = bool((side == 2).all())
        a = np.arange(len(ids)) if one else np.flatnonzero(side == 0)
        b = a if one else np.flatnonzero(side == 1)
        hit = x[a] @ x[b].T >= threshold
        if one:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        i, j = a[i], b[j]
        if t and len(i):
            new = np.ones(len(i), dtype=bool)
            for k in range(0, len(i), 1 << 16):
                new[k : k + (1 << 16)] = ~(keys[i[k : k + (1 << 16)]] == keys[j[k : k + (1 << 16)]]).any(axis=1)
            i, j = i[new], j[new]
        if not len(i):
            return None
        links = np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j, weights=n[i], minlength=len(ids))
        root = list(range(len(ids)))

        def find(u):
            while root[u] != u:
                root[u] = root[root[u]]
                u = root[u]
            return u

        out = [(int(ids[k]), int(links[k]), None) for k in np.flatnonzero(links).tolist()]
        for u, w in zip(i.tolist(), j.tolist(), strict=True):
            ru, rw = find(u), find(w)
            if ru != rw:
                root[max(ru, rw)] = min(ru, rw)
                out.append((int(ids[u]), 0, int(ids[w])))
        return out

    def run(batches):
        """Rows come in the order of cells; a cell is at most two blocks."""
        held: list[pa.RecordBatch] = []

        def work(rows: pa.Table):
            cell = rows.column("cell").to_numpy()
            cut = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
            t, side, ids, n = (rows.column(c).to_numpy() for c in ("t", "side", "class", "n"))
            x, keys = rows.column("x").to_pylist(), rows.column("keys").to_pylist()
            out = []
            for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if q - p > 1:
                    vectors = _unit(np.frombuffer(b"".join(x[p:q]), dtype=element).reshape(q - p, -1).astype(np.float64))
                    marks = np.frombuffer(b"".join(keys[p:q]), dtype=np.uint64).reshape(q - p, int(t[p]))
                    out += compare(int(t[p]), side[p:q], ids[p:q], n[p:q], vectors, marks) or []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["class", "links", "other"])

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            if rows.num_rows < 4096:
                continue
            cell = rows.column("cell").to_numpy()
            last = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
            if last:
                yield work(rows.slice(0, last).combine_chunks())
                held = rows.slice(last).to_batches()
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return placed.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(run, "class long, links long, other long"), path


def near_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, depth: int = DEPTH, cell: float = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    blocks.bound_batches(vectors.sparkSession)
    own, classes = vector_classes(vectors, id_col, vector_col, label_col)
    classes, _ = blocks.stored(classes, "classes")
    element = np.dtype("f4" if "<float>" in vectors.schema[vector_col].dataType.simpleString() else "f8")
    found, path = link_counts(classes, element, threshold, tables, depth, cell, block)
    found, _ = blocks.stored(found, "found")
    blocks.drop_path(vectors.sparkSession, path)
    parts = components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    linked = classes.select("class", "n", "first_id").join(found.groupBy("class").agg(F.sum("links").alias("links")), "class", "left").join(parts.select(F.col("node").alias("class"), "component"), "class", "left")
    linked = linked.select("class", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    info = linked.join(least, "component").select("class", "n_links", "component_id")
    out = own.join(info, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
