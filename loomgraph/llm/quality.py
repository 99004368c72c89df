"""Quality of whole texts by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words; only the bag has a label. Each
passage is encoded: shares of its bytes, of hashed pairs of bytes, and shape
(word lengths, repeated words, symbols), standardised, through a layer of
``WIDTH`` units. A gated attention, tanh(V h) * sigmoid(U h) weighed and put
through a softmax over the bag, says how much each passage counts; the score is a
logistic function of the weighted representation. Encoder, attention and
classifier are learned together from the labels of texts, by Adam on the exact
gradient.

Fitted on at most ``PER_LABEL`` labelled texts a label outside the held-out fold,
chosen by a hash of the id, with weights that restore the shares of the labels
among all labelled texts; of the chosen texts all passages are used. Their
features come to the driver, not their texts, one row a passage: of a text of more than
``TRAIN_PASSAGES`` passages, so many that are spread evenly over it. All texts
are scored in one scan without a shuffle, whole.

Defined cases: a null text, an empty one and one of white space is one passage without
words; a text of any length is scored whole; null ids and null labels, and labels
other than 0 and 1, are never learned from and null ids still scored; an id that
is labelled twice counts by its greatest label; where a label is missing from
the sample all texts score the share of label 1 (0.5 without labels); repeated rows get the
same score; an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import blocks
from loomgraph.llm.features import bounded_sample

PASSAGE = 48
#: Bounds of the training sample: texts of each label, and passages of a text.
PER_LABEL, TRAIN_PASSAGES = 1000, 32
PAIR_BITS = 8
WIDTH, GATE = 24, 12
_SHAPES = 11
FEATURES = 256 + (1 << PAIR_BITS) + _SHAPES
_PAIR = (blocks.mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
_KIND = np.zeros(256, dtype=np.int64)  # 1 lower-case letters and bytes beyond ASCII, 2 capitals, 3 digits, 4 symbols, 0 white space
_KIND[0x21:0x7F] = 4
_KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x80:] = 3, 2, 1, 1


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (float32) of all passages of a slice, and the first passage of each text (n + 1 entries)."""
    starts, ends, first, h = blocks.word_hashes(data, offsets, lower=False)
    n = np.diff(first)
    count = np.maximum(-(-n // PASSAGE), 1)
    begin = np.concatenate(([0], np.cumsum(count)))
    total = int(begin[-1])
    text = np.repeat(np.arange(len(n)), n)
    of = begin[text] + (np.arange(len(starts)) - first[text]) // PASSAGE  # passage of each word
    out = np.zeros((total, FEATURES), dtype=np.float32)
    size = ends - starts
    length = np.bincount(of, weights=size, minlength=total)
    words = np.bincount(of, minlength=total)
    byte_of = np.repeat(of, size)
    at = np.repeat(starts, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    seen = data[at].astype(np.int64)
    follows = np.ones(len(at), dtype=bool)
    follows[np.cumsum(size) - size] = False  # the first byte of a word
    pair = np.flatnonzero(follows)
    scale = np.maximum(length, 1)[:, None]
    out[:, :256] = np.sqrt(np.bincount(byte_of * 256 + seen, minlength=total * 256).reshape(total, 256) / scale)
    codes = _PAIR[seen[pair - 1] * 256 + seen[pair]]
    out[:, 256 : 256 + (1 << PAIR_BITS)] = np.sqrt(np.bincount((byte_of[pair] << PAIR_BITS) + codes, minlength=total << PAIR_BITS).reshape(total, -1) / scale)
    kinds = np.bincount(byte_of * 5 + _KIND[seen], minlength=total * 5).reshape(total, 5)[:, 1:] / scale
    some = np.maximum(words, 1)
    order = np.lexsort((h, of))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    mean = length / some
    marked = np.zeros(len(starts), dtype=bool)
    bare = np.zeros(len(starts), dtype=bool)
    if len(starts):
        marked = _KIND[data[ends - 1]] == 4
        bare = marked & (size == 1)
    shape = [
        kinds,
        np.log1p(words)[:, None],
        mean[:, None],
        np.sqrt(np.maximum(np.bincount(of, weights=size.astype(float) ** 2, minlength=total) / some - mean**2, 0))[:, None],
        (np.bincount(of[order], weights=fresh, minlength=total) / some)[:, None],
        (np.bincount(of, weights=again, minlength=total) / some)[:, None],
        (np.bincount(of, weights=marked, minlength=total) / some)[:, None],
        (np.bincount(of, weights=bare, minlength=total) / some)[:, None],
    ]
    out[:, -_SHAPES:] = np.concatenate(shape, axis=1)
    return out, begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _by_bag(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, begin[:-1], axis=0)  # no bag is empty


def softmax(logit: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Weights of the passages of each bag."""
    size = np.diff(begin)
    x = np.exp(logit - np.repeat(np.maximum.reduceat(logit, begin[:-1]), size))
    return x / np.repeat(_by_bag(x, begin), size)


@dataclass
class QualityModel:
    """Encoder (w, b), gates v and u with the weights of their units, classifier (c, c0); constant: the score where nothing could be learned."""

    constant: float | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    parts: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"] + p["v0"]), _sigmoid(h @ p["u"] + p["u0"])
        a = softmax((t * g) @ p["gate"], begin)
        z = _by_bag(h * a[:, None], begin)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["c0"][0])}

    def gradient(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted log loss of the bags, and its gradient."""
        p, f, size = self.parts, self.forward(x, begin), np.diff(begin)
        h, t, g, a = f["h"], f["t"], f["g"], f["a"]
        score = np.clip(f["score"], 1e-12, 1 - 1e-12)
        loss = -float((weight * (y * np.log(score) + (1 - y) * np.log(1 - score))).sum())
        d = weight * (f["score"] - y)
        dz = np.repeat(d[:, None] * p["c"], size, axis=0)
        da = (dz * h).sum(axis=1)
        dl = a * (da - np.repeat(_by_bag(a * da, begin), size))  # through the softmax
        dm = dl[:, None] * p["gate"]
        dt, dg = dm * g * (1 - t * t), dm * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return loss, {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "v0": dt.sum(axis=0), "u": h.T @ dg, "u0": dg.sum(axis=0), "gate": (t * g).T @ dl, "c": f["z"].T @ d, "c0": np.array([d.sum()])}

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text of a slice, its passages, and the attention of its strongest one."""
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant), np.zeros(n, np.int64), np.zeros(n)
        x, begin = passages(data, offsets)
        f = self.forward((x.astype(np.float64) - self.centre) / self.spread, begin)
        # rounded, so that the order of sums, which follows the size of a slice, does not show
        return np.round(f["score"], 9), np.diff(begin), np.round(np.maximum.reduceat(f["a"], begin[:-1]), 9)


def fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200, ridge: float = 3e-4, seed: int = 3) -> QualityModel:
    """The model of bags of passages: rows begin[k] up to begin[k + 1] of x are bag k."""
    rng = np.random.default_rng(seed)
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-4, spread, 1.0)
    x = ((x - centre) / spread).astype(np.float32)

    def start(rows, columns):
        return (rng.standard_normal((rows, columns)) / np.sqrt(rows)).astype(np.float32)

    parts = {"w": start(x.shape[1], WIDTH), "b": np.zeros(WIDTH), "v": start(WIDTH, GATE), "v0": np.zeros(GATE), "u": start(WIDTH, GATE), "u0": np.zeros(GATE), "gate": start(GATE, 1)[:, 0], "c": start(WIDTH, 1)[:, 0], "c0": np.zeros(1)}
    model = QualityModel(centre=centre, spread=spread, parts={k: np.asarray(q, dtype=np.float32) for k, q in parts.items()})
    first = {k: np.zeros_like(q) for k, q in model.parts.items()}
    second = {k: np.zeros_like(q) for k, q in model.parts.items()}
    weight = (weight / weight.sum()).astype(np.float32)
    for step in range(1, rounds + 1):
        _, slope = model.gradient(x, begin, y.astype(np.float32), weight)
        rate = 0.02 * min(1.0, 2 * (1 - (step - 1) / rounds))
        for k, p in model.parts.items():
            g = slope[k] + (ridge * p if k in ("w", "v", "u", "gate", "c") else 0)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.parts[k] = (p - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    model.parts = {k: p.astype(np.float64) for k, p in model.parts.items()}
    return model


def _features(docs: DataFrame, most: int) -> DataFrame:
    """id and packed features of the passages of each text, at most ``most`` of them, evenly spread."""

    def run(batches):
        for batch in batches:
            data, offsets, _ = blocks.buffer_of(batch.column(1))
            packed = []
            for i, j in blocks.slices(offsets, blocks.SLICE_BYTES // 2):
                x, begin = passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    pick = a + np.arange(b - a) if b - a <= most else a + (np.arange(most) * (b - a)) // most
                    packed.append(x[pick].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "x"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, x binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL, most: int = TRAIN_PASSAGES, folds: int = 3, fold: int = 1) -> QualityModel:
    """Fits the model on a bounded sample of labelled texts outside the held-out fold."""
    blocks.bound_batches(docs.sparkSession)
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    found, sizes = bounded_sample(marked, "id", "label", per_label, folds, fold)
    chosen = dict(found)
    share = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    if len(set(chosen.values())) < 2:
        return QualityModel(constant=float(share))
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], T.StructType([T.StructField("id", docs.schema[id_col].dataType)]))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id", "left_semi")  # at most per_label ids a label
    bags = sorted({(r["id"], bytes(r["x"])) for r in _features(own, most).toLocalIterator()})
    if len({chosen[i] for i, _ in bags}) < 2:
        return QualityModel(constant=float(share))
    begin = np.concatenate(([0], np.cumsum([len(x) // (4 * FEATURES) for _, x in bags])))
    y = np.array([chosen[i] for i, _ in bags], dtype=float)
    x = np.frombuffer(b"".join(x for _, x in bags), dtype=np.float32).reshape(-1, FEATURES)
    return fit(x, begin, y, np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean())))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_passages and attention (of the strongest passage) of every row; a scan without a shuffle."""
    blocks.bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets, _ = blocks.buffer_of(batch.column(1))
            got = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0))]
            for i, j in blocks.slices(offsets, blocks.SLICE_BYTES // 2):
                got.append(model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            s, n, a = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(n, pa.int64()), pa.array(a)], ["doc_id", "score", "predicted", "n_passages", "attention"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_passages long, attention double")
