"""Hard negatives by inner product, searched over one-dimensional distance keys.

Vectors become integers, floor(scale * x). An inner product is a distance once every vector is augmented by
sqrt(M^2 - |x|^2), M the greatest norm, and a query by 0: |q' - x'|^2 = |q|^2 + M^2 - 2 q x.

1. *Index.* Pivots and the edges of distance cells come from a bounded sample; every
   row goes to its nearest pivot and is stored in the order of (pivot, distance),
   in chunks of at most ``CHUNK`` rows that know their least and greatest
   distance. Of rows with the same label and vector only the first ids that
   any answer can hold are stored (ties go to smaller ids), so a vector that a
   third of all rows share costs a few of them.
2. *Search.* A query scans, for a radius that doubles each round, the key
   intervals [d(q, pivot) - r, d(q, pivot) + r] it has not scanned: by the
   triangle inequality they hold every row within r. It ends when its
   k-th answer, or the end of its score window, is no further than r. Queries
   of one cell travel in packs, and a pack meets a chunk in one matrix product;
   a pair sends back at most k rows a query that are better than what is known.
3. *Mining.* Queries are the distinct (label, vector) of anchors. The first
   search finds their nearest rows of the same label; each different positive score
   then is a window of scores for a second search, over rows of other labels.

Scores are exact up to 2^53. Key intervals are widened by a millionth of
the norms, which covers rounding.

Defined cases: rows with a null id or label, a null vector, or one that holds a null or
non-finite component take no part; a shorter vector counts as padded with
zeros (an empty one as zero); rows that repeat an id and all else count once; an
anchor's own id is never its positive; anchors without positives, and
positives without negatives, give no rows; negative positive scores have no
negatives; an empty table gives an empty result; other columns are not read, whatever
their names. Ids are integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm import blocks

SCALE = 256.0
POSITIVES, NEGATIVES, LOW = 5, 5, 80
CHUNK, PACK = 512, 512
#: Bounds of what the driver fits the index on, and of what it broadcasts: sampled rows, pivots and cells.
SAMPLE, PIVOTS, CELLS = 16_384, 128, 4096
SLACK = 1e-6
SALTS = 8


def packed(x: np.ndarray) -> bytes:
    """A matrix of integers as bytes of the smallest of three types, named by the first byte."""
    top = np.abs(x).max() if x.size else 0
    kind = "h" if top < 1 << 15 else "i" if top < 1 << 31 else "d"
    return kind.encode() + np.ascontiguousarray(x.astype(f"<{kind}")).tobytes()


def unpacked(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<{chr(raw[0])}", offset=1).reshape(rows, -1).astype(np.float64)


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """vec_id, label (long), x (packed integers), norm2 and dim of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            at = np.cumsum(sizes) - sizes
            own = [x[a : a + n] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packed(v) for v in own], pa.binary()), pa.array([float(v @ v) for v in own], pa.float64()), pa.array(sizes, pa.int32())], ["vec_id", "label", "x", "norm2", "dim"])

    return rows.where(fine).mapInArrow(run, "vec_id long, label long, x binary, norm2 double, dim int")


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for k, raw in enumerate(column.to_pylist()):
        v = unpacked(raw, 1)[0] if len(raw) > 1 else ()
        out[k, : len(v)] = v
    return out


@dataclass
class Keys:
    """What turns a vector into a key: pivots, and the inner edges of the cells of each."""

    dim: int
    top: float  # M^2
    pivots: np.ndarray  # augmented
    edges: list[np.ndarray]
    first: np.ndarray  # first cell of each pivot
    unit: float  # first radius

    def distances(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """From augmented vectors to all pivots."""
        inner = x @ self.pivots[:, :-1].T + extra[:, None] * self.pivots[:, -1]
        own = (x * x).sum(axis=1) + extra**2
        return np.sqrt(np.maximum(own[:, None] + (self.pivots**2).sum(axis=1) - 2 * inner, 0))

    def augment(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance) of each row."""
        d = self.distances(x, self.augment(x))
        pivot = d.argmin(axis=1)
        own = d[np.arange(len(x)), pivot]
        cell = np.empty(len(x), dtype=np.int32)
        for p in np.unique(pivot).tolist():
            mine = pivot == p
            cell[mine] = self.first[p] + np.searchsorted(self.edges[p], own[mine], side="right")
        return cell, own


def fit_keys(x: np.ndarray, top: float, n: int, rounds: int = 6, chunk: int = CHUNK) -> Keys:
    """Pivots by Lloyd's rounds over a sample of n rows, and cells of about ``chunk`` rows, by quantiles."""
    dim = x.shape[1]
    count = int(np.clip(round((n / 32) ** 0.5), 1, min(PIVOTS, max(len(x), 1))))
    keys = Keys(dim, top, np.zeros((1, dim + 1)), [np.zeros(0)], np.zeros(1, dtype=np.int64), 1.0)
    if not len(x):
        return keys
    whole = np.column_stack([x, keys.augment(x)])
    keys.pivots = whole[np.random.default_rng(5).choice(len(x), count, replace=False)]
    for _ in range(rounds):
        near = keys.distances(x, whole[:, -1]).argmin(axis=1)
        size = np.bincount(near, minlength=count)
        total = np.zeros_like(keys.pivots)
        np.add.at(total, near, whole)
        keys.pivots = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], keys.pivots)
    d = keys.distances(x, whole[:, -1])
    near, own = d.argmin(axis=1), d.min(axis=1)
    cells = min(-(-n // chunk), CELLS - count, len(x))
    keys.edges = []
    for p in range(count):
        mine = own[near == p]
        share = max(round(cells * len(mine) / len(x)), 1)
        keys.edges.append(np.unique(np.quantile(mine, np.arange(1, share) / share)) if len(mine) and share > 1 else np.zeros(0))
    keys.first = np.concatenate(([0], np.cumsum([len(e) + 1 for e in keys.edges])))[:-1]
    keys.unit = float(np.median(own)) / 2 or max(top, 1.0) ** 0.5
    return keys


@dataclass
class Index:
    chunks: DataFrame  # cell, low, high, ids, labels, x
    keys: Keys
    cell: np.ndarray  # cells that have rows, their pivot, least and greatest distance
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build_index(rows: DataFrame, keep: int, chunk: int = CHUNK, sample: int = SAMPLE) -> Index:
    """Every row of usable_rows that an answer of fewer than keep rows can hold, stored by (pivot, distance)."""
    spark = rows.sparkSession
    order = Window.partitionBy("label", "x").orderBy("vec_id")
    first = rows.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= keep).select("vec_id", "label", "x", "norm2", "dim").dropDuplicates(["label", "x", "vec_id"])
    first, _ = blocks.stored(first, "vectors")
    size = first.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("top"), F.max("dim").alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0
    share = min(1.0, (sample + 4 * sample**0.5) / max(n, 1))
    fit_on = first.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).select("vec_id", "x")
    got = sorted((r["vec_id"], bytes(r["x"])) for r in fit_on.collect())  # about sample rows
    keys = fit_keys(_padded(pa.array([x for _, x in got], pa.binary()), dim), size["top"] or 0.0, n, chunk=chunk)

    def keyed(batches):
        for batch in batches:
            cell, own = keys.keys(_padded(batch.column(2), keys.dim))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(own), *(batch.column(k) for k in range(3))], ["cell", "d", "vec_id", "label", "x"])

    def chunked(batches):
        for batch in batches:
            cell, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
            ends = np.append(cuts[1:], len(cell)).tolist()
            parts = [(a, min(a + chunk, e)) for s, e in zip(cuts.tolist(), ends, strict=True) for a in range(s, e, chunk)]
            x = _padded(batch.column(4), keys.dim)
            ids, labels = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            columns = [pa.array([int(cell[a]) for a, _ in parts], pa.int32()), pa.array([d[a] for a, _ in parts], pa.float64()), pa.array([d[b - 1] for _, b in parts], pa.float64())]
            columns += [pa.array([v[a:b] for a, b in parts], pa.list_(pa.int64())) for v in (ids, labels)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([packed(x[a:b]) for a, b in parts], pa.binary())], ["cell", "low", "high", "ids", "labels", "x"])

    keyed_rows = first.select("vec_id", "label", "x").mapInArrow(keyed, "cell int, d double, vec_id long, label long, x binary")
    ordered = keyed_rows.repartitionByRange("cell", "d").sortWithinPartitions("cell", "d")
    chunks, _ = blocks.stored(ordered.mapInArrow(chunked, "cell int, low double, high double, ids array<long>, labels array<long>, x binary"), "chunks")
    there = sorted((r["cell"], r["low"], r["high"]) for r in chunks.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())  # at most CELLS rows
    cell = np.array([r[0] for r in there], dtype=np.int64)
    pivot = np.searchsorted(keys.first, cell, side="right") - 1
    return Index(chunks, keys, cell, pivot, np.array([r[1] for r in there], dtype=float), np.array([r[2] for r in there], dtype=float))


_BEST = "array<struct<neg:bigint,id:bigint>>"


def _packs(index: Index, radius: float, before: float):
    """Of a batch of queries: for each cell whose rows they have not all scanned, the queries that need it."""
    keys, cell, pivot, low, high = index.keys, index.cell, index.pivot, index.low, index.high

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, PACK):
                part = batch.slice(a, PACK)
                x = _padded(part.column(1), keys.dim)
                d = keys.distances(x, np.zeros(len(x)))[:, pivot]
                slack = (SLACK * (np.sqrt((x * x).sum(axis=1)) + keys.top**0.5))[:, None]
                need = (low <= d + radius + slack) & (high >= d - radius - slack)
                if before >= 0:
                    need &= ~((high <= d + before + slack) & (low >= d - before - slack))
                others = [part.column(k) for k in (0, 2, 3, 4, 5, 6)]
                for c in np.flatnonzero(need.any(axis=0)).tolist():
                    own = np.flatnonzero(need[:, c])
                    pick = pa.array(own)
                    lists = [pa.array([v.take(pick).to_pylist()], pa.list_(v.type)) for v in others]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(cell[c])], pa.int32()), *lists, pa.array([d[own, c].tolist()], pa.list_(pa.float64())), pa.array([slack[own, 0].tolist()], pa.list_(pa.float64())), pa.array([packed(x[own])], pa.binary())],
                        ["cell", "item", "own", "same", "floor", "ceiling", "bar", "d", "slack", "q"],
                    )

    return run, "cell int, item array<long>, own array<long>, same array<boolean>, floor array<long>, ceiling array<long>, bar array<long>, d array<double>, slack array<double>, q binary"


def _matches(k: int, radius: float, before: float):
    """The first k rows of a chunk for each query of a pack that scans it now."""

    def one(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        d, slack = np.array(row["d"]), np.array(row["slack"])
        now = (row["low"] <= d + radius + slack) & (row["high"] >= d - radius - slack)
        if before >= 0:
            now &= ~((row["low"] <= d + before + slack) & (row["high"] >= d - before - slack))
        use = np.flatnonzero(now)
        if not len(use):
            return None
        ids, labels = np.array(row["ids"], dtype=np.int64), np.array(row["labels"], dtype=np.int64)
        q = unpacked(row["q"], len(d))[use]
        item, own, same, floor, ceiling, bar = (np.array(row[c])[use] for c in ("item", "own", "same", "floor", "ceiling", "bar"))
        score = np.clip(np.rint(q @ unpacked(row["x"], len(ids)).T), -(2.0**62), 2.0**62).astype(np.int64)
        fine = (own[:, None] == labels) == same[:, None]
        fine &= (score >= np.maximum(floor, bar)[:, None]) & (score <= ceiling[:, None])
        if len(ids) > k:
            shown = np.where(fine, score, -(1 << 63))
            fine &= score >= np.partition(shown, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
        i, j = np.nonzero(fine)
        if not len(i):
            return None
        s = score[i, j]
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        return item[i[keep]], -s[keep], ids[j[keep]]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                found = one(batch.slice(row, 1).to_pylist()[0])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["item", "neg", "id"])

    return run, "item long, neg long, id long"


def annulus_search(index: Index, items: DataFrame, k: int) -> DataFrame:
    """items with best: the first k rows of each query by falling score, then id.

    items: item (a number of its own each), x, label, same (rows of the label, or of all others),
    norm2, floor and ceiling of scores; other columns stay.
    """
    spark, keys = items.sparkSession, index.keys
    state, path = blocks.stored(items.withColumn("best", F.lit(None).cast(_BEST)).withColumn("best", F.coalesce("best", F.array().cast(_BEST))), "searches")
    bar = F.when(F.size("best") >= k, -F.element_at("best", k)["neg"])
    bound = F.sqrt(F.greatest(F.col("norm2") + keys.top - 2 * F.coalesce(bar, F.col("floor")).cast("double"), F.lit(0.0)))
    end = F.least(bound, F.sqrt("norm2") + keys.top**0.5)
    before, radius = -1.0, keys.unit
    while len(index.cell):
        active = state if before < 0 else state.where(F.lit(before) < end)
        if before >= 0 and active.isEmpty():
            break
        asked = active.select("item", "x", "label", "same", "floor", "ceiling", F.coalesce(bar, F.col("floor")).alias("bar"))
        pack, pack_kind = _packs(index, radius, before)
        match, match_kind = _matches(k, radius, before)
        # merged: packs are many times their queries, which Spark's estimate for a broadcast doesn't know
        pairs = asked.mapInArrow(pack, pack_kind).hint("merge").join(index.chunks, "cell")
        found = pairs.mapInArrow(match, match_kind)
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("neg", "id"))).where(F.col("r") <= k)
        found = found.groupBy("item").agg(F.collect_list(F.struct("neg", "id")).alias("more"))  # k at most
        best = F.slice(F.array_sort(F.concat("best", F.coalesce("more", F.array().cast(_BEST)))), 1, k)
        after, next_path = blocks.stored(state.join(found, "item", "left").withColumn("best", best).drop("more"), "searches")
        blocks.drop_path(spark, path)
        state, path = after, next_path
        before, radius = radius, 2 * radius
    return state


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: float = SCALE, chunk: int = CHUNK, sample: int = SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    anchors: a condition on vec_id. A negative's score is from low hundredths of the positive's up to the positive's.
    """
    spark = vectors.sparkSession
    blocks.bound_batches(spark)
    label = F.col(label) if isinstance(label, str) else label
    kind = vectors.select(label.alias("l")).schema["l"].dataType.simpleString()
    label = label.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(label.isNotNull(), F.xxhash64(label))
    rows, _ = blocks.stored(usable_rows(vectors, id_col, vector_col, label, scale), "vectors")
    k = max(positives + 1, negatives)
    index = build_index(rows, k, chunk, sample)
    asking = rows.where(anchors).withColumn("item", F.xxhash64("label", "x"))
    items = asking.groupBy("item").agg(F.first("x").alias("x"), F.first("label").alias("label"), F.first("norm2").alias("norm2"))
    all_ = F.lit(1 << 62)
    near = annulus_search(index, items.withColumns({"same": F.lit(True), "floor": -all_, "ceiling": all_}), positives + 1)
    score = F.explode(F.array_distinct(F.transform("best", lambda b: -b["neg"])))
    windows = near.select("item", "x", "label", "norm2", score.alias("ceiling"))
    windows = windows.withColumn("floor", F.ceil(F.col("ceiling").cast("decimal(20,0)") * low / 100).cast("long")).where("floor <= ceiling")
    windows = windows.select(F.xxhash64("item", "ceiling").alias("item"), F.col("item").alias("of"), "x", "label", "norm2", F.lit(False).alias("same"), "floor", "ceiling")
    hard = annulus_search(index, windows, negatives)
    hard = hard.groupBy(F.col("of").alias("item")).agg(F.collect_list(F.struct("ceiling", "best")).alias("hard"))  # positives + 1 at most
    answers = near.select("item", F.col("best").alias("near")).join(hard, "item").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a vector that many anchors share is one answer for all of them
    out = asking.select(F.col("vec_id").alias("anchor_id"), "item").distinct().select("anchor_id", "item", F.pmod(F.xxhash64("anchor_id"), F.lit(SALTS)).cast("int").alias("salt")).join(answers, ["item", "salt"])
    own = F.slice(F.filter("near", lambda b: b["id"] != F.col("anchor_id")), 1, positives)
    out = out.select("anchor_id", "hard", F.explode(own).alias("p")).select("anchor_id", F.col("p")["id"].alias("positive_id"), (-F.col("p")["neg"]).alias("positive_score"), "hard")
    out = out.select("anchor_id", "positive_id", "positive_score", F.filter("hard", lambda h: h["ceiling"] == F.col("positive_score"))[0]["best"].alias("best"))
    out = out.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n")["id"].alias("negative_id"), "positive_score", (-F.col("n")["neg"]).alias("negative_score"))
