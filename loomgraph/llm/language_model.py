"""Language-model scores by deleted interpolation.

P(w | h) = l2 * c(h, w) / c(h) + l1 * c(w) / N + l0 / (V + 1), where the three
weights depend on the bucket of the context's frequency c(h) (powers of two)
and are learned by expectation-maximisation on held-out counts: one part of
the training documents (``DELETED`` of ``FOLDS``) is deleted from the counts,
and the weights are fitted to its words. The scores use all training counts.

Layout. Documents become blocks of about ``BLOCK_BYTES`` of text, stored in
the shared folder: the distinct word hashes of a block and, for each token,
its place among them. Each block sends its distinct words and bigrams with
their counts, packed and dealt by hash, to tasks that add them up and send the
sums back to each block, in the order in which they came. So a word or pair
that is everywhere costs one entry a block. Blocks are then scored with the
counts of all they hold; no table of the corpus is broadcast or collected.
EM sees a histogram of the component ratios, whose size is bounded.

Defined cases: null and empty texts are the end token alone; null ids are
scored, never learned from, and not held out; without training tokens N and V
are 0 and every token has probability 1 / (V + 1) = 1; repeated rows count as
often as they come; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import blocks
from loomgraph.llm.blocks import spread, squeeze

FOLDS, HELD_OUT, DELETED = 7, 2, 3
BLOCK_BYTES = 4 << 20
BUCKETS = 24
#: Weights (bigram, word, uniform) where nothing is held out to learn from.
PRIOR = (0.6, 0.3, 0.1)
_U = np.uint64
_END = _U(0x51ED270B4D0F1E67)
_START = _U(0x7F4A7C159E3779B9)
_RATIO = 2.0  # bins a doubling


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=_U(0))


_BLOCK = "block long, ids binary, sizes binary, parts binary, words binary, tokens binary"


def token_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents; parts: 1 trained on, 2 of these deleted for EM, 4 held out, 8 a null id."""

    def run(batches):
        held: list[tuple] = []
        size, number = 0, 0
        base = TaskContext.get().partitionId() << 24

        def flush():
            nonlocal size, number
            h = np.concatenate([x[2] for x in held])
            words, tokens = np.unique(h, return_inverse=True)
            row = [base + number, np.concatenate([x[0] for x in held]).tobytes(), squeeze(np.concatenate([x[1] for x in held]).astype(np.uint32)), np.concatenate([x[3] for x in held]).astype(np.uint8).tobytes(), squeeze(_steps(words)), squeeze(tokens.astype(np.uint32))]
            held.clear()
            size, number = 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], ["block", "ids", "sizes", "parts", "words", "tokens"])

        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            fold = np.array([zlib.crc32(b"%d" % i) % FOLDS for i in ids.tolist()], dtype=np.int64)
            part = np.where(known, np.where(fold == HELD_OUT, 4, np.where(fold == DELETED, 3, 1)), 8)
            data, offsets, _ = blocks.buffer_of(batch.column(1))
            for i, j in blocks.slices(offsets):
                _, _, first, h = blocks.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(first) + 1
                ends = np.cumsum(n) - 1
                out = np.empty(len(h) + len(n), dtype=np.uint64)
                out[ends] = _END
                inside = np.ones(len(out), dtype=bool)
                inside[ends] = False
                out[inside] = h
                held.append((ids[i:j], n, out, part[i:j]))
                size += int(offsets[j] - offsets[i]) + 16 * (j - i)
                if size >= block_bytes:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _BLOCK)


class _Block:
    """A stored block, unpacked."""

    def __init__(self, ids: bytes, sizes: bytes, parts: bytes, words: bytes, tokens: bytes):
        self.ids, self.sizes = np.frombuffer(ids, dtype=np.int64), spread(sizes, np.uint32).astype(np.int64)
        self.parts = np.frombuffer(parts, dtype=np.uint8)
        self.words, self.tokens = np.cumsum(spread(words, np.uint64)), spread(tokens, np.uint32).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.first] = len(self.words)  # the start of a document
        hashes = np.append(self.words, _START)
        self.pairs, self.pair = np.unique(blocks.mix(hashes[self.before] * _U(0x9E3779B97F4A7C15) + self.words[self.tokens]), return_inverse=True)
        part = np.repeat(self.parts, self.sizes)
        self.trained, self.deleted = (part & 1) > 0, (part & 2) > 0

    def counts(self, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(of[self.trained], minlength=n).astype(np.uint32), np.bincount(of[self.deleted], minlength=n).astype(np.uint32)


def _blocks_in(batch: pa.RecordBatch):
    for i in range(batch.num_rows):  # one at a time: a row is a block
        number, *parts = (batch.column(k)[i].as_py() for k in range(6))
        yield number, _Block(*parts)


def corpus_counts(stored: DataFrame, deal: int) -> DataFrame:
    """(block, kind, deal, c, d): corpus counts of a block's words (0) and pairs (1), all and deleted; kind 2: totals of a task."""

    def send(batches):
        for batch in batches:
            for number, b in _blocks_in(batch):
                rows = []
                for kind, keys, of in ((0, b.words, b.tokens), (1, b.pairs, b.pair)):
                    c, d = b.counts(of, len(keys))
                    to = ((keys >> _U(32)) * _U(deal)) >> _U(32)
                    cut = np.searchsorted(to, np.arange(deal + 1, dtype=np.uint64))
                    sent = keys if kind == 0 else keys >> _U(10)
                    for k in np.flatnonzero(np.diff(cut)).tolist():
                        s = slice(cut[k], cut[k + 1])
                        rows.append((k, number, kind, squeeze(_steps(sent[s])), squeeze(c[s]), squeeze(d[s])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["deal", "block", "kind", "keys", "c", "d"])

    def add(batches):
        held: dict[int, list] = {0: [], 1: []}
        at = None
        for batch in batches:
            for k, number, kind, keys, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                at = k
                held[kind].append((number, np.cumsum(spread(keys, np.uint64)), spread(c, np.uint32), spread(d, np.uint32)))
        if at is None:
            return
        names = ["block", "kind", "deal", "c", "d", "distinct", "total"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        for kind, own in held.items():
            if not own:
                continue
            keys, of = np.unique(np.concatenate([x[1] for x in own]), return_inverse=True)
            c = np.bincount(of, weights=np.concatenate([x[2] for x in own]), minlength=len(keys)).astype(np.uint64)
            d = np.bincount(of, weights=np.concatenate([x[3] for x in own]), minlength=len(keys)).astype(np.uint64)
            rows, start = [], 0
            for number, k, _, _ in own:
                mine = of[start : start + len(k)]
                start += len(k)
                rows.append((number, kind, at, squeeze(c[mine]), squeeze(d[mine]), None, None))
            if kind == 0:
                rows.append((None, 2, at, None, None, int((c > 0).sum()), int(c.sum())))
                rows.append((None, 3, at, None, None, int((d > 0).sum()), int(d.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    sent = stored.mapInArrow(send, "deal int, block long, kind int, keys binary, c binary, d binary")
    return sent.repartitionById(deal, F.col("deal")).mapInArrow(add, "block long, kind int, deal int, c binary, d binary, distinct long, total long")


def _with_counts(batch: pa.RecordBatch):
    """(block, word counts, deleted, pair counts, deleted) of joined rows."""
    for i, (_, b) in enumerate(_blocks_in(batch)):
        found = sorted((r["kind"], r["deal"], r["c"], r["d"]) for r in batch.column(6)[i].as_py())
        out = [np.concatenate([spread(r[k], np.uint64) for r in found if r[0] == kind]).astype(np.float64) for kind in (0, 1) for k in (2, 3)]
        yield b, *out


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def _level(x: np.ndarray) -> np.ndarray:
    """Bin of a ratio to the uniform; 0 for none."""
    return np.where(x > 0, np.clip(np.floor(np.log2(np.maximum(x, 1e-9)) * _RATIO).astype(np.int64) + 40, 1, 254), 0)


def ratio_histogram(joined: DataFrame, n: int, v: int, starts: int) -> DataFrame:
    """(bucket, bin2, bin1, n, r2, r1) of the deleted part's tokens: sums of the ratios of both estimates to the uniform."""

    def run(batches):
        for batch in batches:
            for b, c1, d1, c2, d2 in _with_counts(batch):
                own = np.flatnonzero(b.deleted)
                if not len(own):
                    continue
                left1, left2 = c1 - d1, c2 - d2
                context = np.append(left1, starts)[b.before[own]]
                f2 = np.where(context > 0, left2[b.pair[own]] / np.maximum(context, 1), 0) * (v + 1)
                f1 = left1[b.tokens[own]] / max(n, 1) * (v + 1)
                key, of = np.unique((_bucket(context) * 256 + _level(f2)) * 256 + _level(f1), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(of).astype(np.float64)), pa.array(np.bincount(of, weights=f2)), pa.array(np.bincount(of, weights=f1))], ["key", "n", "r2", "r1"])

    return joined.mapInArrow(run, "key long, n double, r2 double, r1 double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("r2").alias("r2"), F.sum("r1").alias("r1"))


def learn_weights(histogram: list[tuple[int, float, float, float]], rounds: int = 100) -> np.ndarray:
    """Weights (bigram, word, uniform) of each context bucket, by expectation-maximisation."""
    out = np.tile(np.array(PRIOR), (BUCKETS, 1))
    for bucket in range(BUCKETS):
        rows = np.array([(n, r2 / n, r1 / n, 1.0) for key, n, r2, r1 in histogram if key >> 16 == bucket])
        if len(rows):
            n, r = rows[:, :1], rows[:, 1:]
            w = out[bucket]
            for _ in range(rounds):
                share = w * r
                share /= share.sum(axis=1, keepdims=True)
                w = (n * share).sum(axis=0) + 0.5 * np.array(PRIOR)
                w /= w.sum()
            out[bucket] = w
    return out


def interpolated_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    blocks.bound_batches(docs.sparkSession)
    stored = blocks.bucketed(token_blocks(docs, id_col, text_col, block_bytes), "block", "token-blocks")  # so that later joins move the counts and not the blocks
    deal = max(16, stored.count() // 2)  # each task adds up about two blocks' worth of entries
    counts, _ = blocks.stored(corpus_counts(stored, deal), "counts")
    totals = {r["kind"]: (r["v"], r["n"]) for r in counts.where("kind >= 2").groupBy("kind").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).collect()}
    (v, n), (_, deleted) = totals.get(2, (0, 0)), totals.get(3, (0, 0))
    part = blocks.remainder(id_col, FOLDS)
    heads = docs.agg(F.count(F.when(part != HELD_OUT, 1)).alias("all"), F.count(F.when(part == DELETED, 1)).alias("out")).first()
    back = counts.where("kind < 2").groupBy("block").agg(F.collect_list(F.struct("kind", "deal", "c", "d")).alias("counts"))  # two entries a block and deal
    joined = stored.join(back.hint("merge"), "block").select(*(x.split()[0] for x in _BLOCK.split(", ")), "counts")
    found = ratio_histogram(joined, n - deleted, v, heads["all"] - heads["out"]).collect()  # at most BUCKETS * 255 * 255 rows, whatever the corpus
    weights = learn_weights([(r["key"], r["n"], r["r2"], r["r1"]) for r in found])
    starts = heads["all"]

    def run(batches):
        for batch in batches:
            for b, c1, _, c2, _ in _with_counts(batch):
                context = np.append(c1, starts)[b.before]
                w = weights[_bucket(context)]
                seen = context > 0
                f2 = np.where(seen, c2[b.pair] / np.maximum(context, 1), 0)
                c = c1[b.tokens]
                p = w[:, 0] * f2 + w[:, 1] * (c / max(n, 1)) + w[:, 2] / (v + 1)
                p /= np.where(seen, 1, w[:, 1] + w[:, 2]) if n else p
                base = np.log10((c + 1) / (n + v + 1))
                sums = [np.add.reduceat(x, b.first) for x in (c > 0, base, np.log10(p))]
                null = (b.parts & 8) > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids, mask=null), pa.array((b.parts & 4) > 0), pa.array(b.sizes), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(b.ids), n)), pa.array(sums[1]), pa.array(sums[2])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
