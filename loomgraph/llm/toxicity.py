"""Toxic spans by a linear-chain conditional random field.

Labelled tokens come from labelled documents: a word is a toxic token where
its document is labelled toxic and the word's document counts differ between
toxic and clean documents by a likelihood ratio above ``EVIDENCE``, or, in a
second round, where the first field is sure of it. The field has two states,
hashed n-grams of each word as features, and the usual start and transition
weights. Forward-backward marginals give each token's probability; a logistic
curve over the greatest and the summed marginal gives the document's score.

Defined cases: null and empty texts have no tokens and get the score of a
text with all marginals near 0; no labelled rows of both kinds to learn from:
every score is 0; rows with null ids are scored, never learned from; repeated
rows get the same answer; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import blocks
from loomgraph.llm.features import bounded_sample, distinct_words, fold_case, word_ngrams

ORDERS, BITS = (2, 3, 4, 5), 16
#: Bounds of the training sample: documents of each label.
PER_LABEL = 800
EVIDENCE = 16.0
_STEP = 256


def marginals(u: np.ndarray, begins: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """P(state 1) of each token, forward vectors and backward vectors, for chains that begin where begins is set.

    u: score of state 1 over state 0. The tokens are cut into rows of equal
    length; products of 2x2 matrices along rows, then one pass over row ends,
    then vectors along rows, so that every numpy call handles a whole column.
    """
    n = len(u)
    if not n:
        return np.zeros(0), np.zeros((2, 0)), np.zeros((2, 0))
    width = int(max(16, min(_STEP, n**0.5)))
    rows = -(-n // width)

    def grid(x, fill):
        out = np.full(rows * width, fill, dtype=np.float64)
        out[:n] = x
        return np.ascontiguousarray(out.reshape(rows, width).T)

    e = grid(np.exp(np.clip(u, -30, 30)), 1.0)
    b = grid(begins, 1.0)
    t, s = np.exp(transition - transition.max()), np.exp(start - start.max())
    keep = 1 - b
    # matrix of token k: m[i][j] = weight of coming from i into j
    m = [[keep * t[0, 0] + b * s[0], (keep * t[0, 1] + b * s[1]) * e], [keep * t[1, 0] + b * s[0], (keep * t[1, 1] + b * s[1]) * e]]

    def along(order, step, first):
        """Row products, then vectors after (or before) each token."""
        p = [[np.ones(rows), np.zeros(rows)], [np.zeros(rows), np.ones(rows)]]
        for k in order:
            p = step(p, k)
            z = p[0][0] + p[0][1] + p[1][0] + p[1][1]
            p = [[x / z for x in r] for r in p]
        return p

    def right(p, k):
        return [[p[i][0] * m[0][j][k] + p[i][1] * m[1][j][k] for j in (0, 1)] for i in (0, 1)]

    def left(p, k):
        return [[m[i][0][k] * p[0][j] + m[i][1][k] * p[1][j] for j in (0, 1)] for i in (0, 1)]

    p = along(range(width), right, None)
    q = along(range(width - 1, -1, -1), left, None)
    into, out_of = np.empty((2, rows)), np.empty((2, rows))
    v = (0.5, 0.5)
    p00, p01, p10, p11 = (x.tolist() for r in p for x in r)
    for r in range(rows):
        into[:, r] = v
        a, c = v[0] * p00[r] + v[1] * p10[r], v[0] * p01[r] + v[1] * p11[r]
        v = (a / (a + c), c / (a + c))
    v = (0.5, 0.5)
    q00, q01, q10, q11 = (x.tolist() for r in q for x in r)
    for r in range(rows - 1, -1, -1):
        out_of[:, r] = v
        a, c = q00[r] * v[0] + q01[r] * v[1], q10[r] * v[0] + q11[r] * v[1]
        v = (a / (a + c), c / (a + c))
    alpha, beta = np.empty((2, width, rows)), np.empty((2, width, rows))
    a0, a1 = into
    for k in range(width):
        x0, x1 = a0 * m[0][0][k] + a1 * m[1][0][k], a0 * m[0][1][k] + a1 * m[1][1][k]
        z = x0 + x1
        a0, a1 = x0 / z, x1 / z
        alpha[0, k], alpha[1, k] = a0, a1
    b0, b1 = out_of
    for k in range(width - 1, -1, -1):
        beta[0, k], beta[1, k] = b0, b1
        x0, x1 = m[0][0][k] * b0 + m[0][1][k] * b1, m[1][0][k] * b0 + m[1][1][k] * b1
        z = x0 + x1
        b0, b1 = x0 / z, x1 / z
    alpha = alpha.transpose(0, 2, 1).reshape(2, -1)[:, :n]
    beta = beta.transpose(0, 2, 1).reshape(2, -1)[:, :n]
    # what follows a chain's end is the same for both states: the next matrix forgets where it came from
    one = alpha[1] * beta[1]
    return one / (one + alpha[0] * beta[0]), alpha, beta


@dataclass
class ToxicModel:
    weights: np.ndarray  # of the n-gram buckets
    bias: float
    transition: np.ndarray
    start: np.ndarray
    curve: np.ndarray  # constant, greatest marginal, summed marginals

    def tokens(self, data: np.ndarray, offsets: np.ndarray):
        """Starts, ends, first token of each text, marginals."""
        data = fold_case(data)
        starts, ends, first = blocks.words(data, offsets, blocks.ALNUM)
        u = np.zeros(0)
        if len(starts):
            s, e, inverse = distinct_words(data, starts, ends)
            gram, owner = word_ngrams(data, s, e, ORDERS, BITS)
            size = np.maximum(np.bincount(owner, minlength=len(s)), 1)
            u = (self.bias + np.bincount(owner, weights=self.weights[gram], minlength=len(s)) / np.sqrt(size))[inverse]
        begins = np.zeros(len(starts), dtype=bool)
        begins[first[:-1][first[:-1] < len(starts)]] = True
        p, _, _ = marginals(u, begins, self.transition, self.start)
        return starts, ends, first, p

    def scores(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = _summary(p, first)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -40, 40)))


def _summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(first) - 1
    most, total = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        most[full] = np.maximum.reduceat(p, first[full])
        total[full] = np.add.reduceat(p, first[full])
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(most / (1 - most)), np.log(np.clip(total, 1e-6, None))], axis=1)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.05 * np.eye(len(w)), x.T @ (weight * (y - p)) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence(a, b, na, nb):
    """Likelihood ratio of two document shares, 0 where the first isn't the greater."""
    p = (a + b) / (na + nb)

    def part(o, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(o > 0, o * np.log(o / n / p), 0) + np.where(n - o > 0, (n - o) * np.log((n - o) / n / (1 - p)), 0)

    return np.where(a / na > b / nb, 2 * (part(a, na) + part(b, nb)), 0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> ToxicModel | None:
    """Fits the field and the curve on a bounded sample of labelled documents outside the held-out fold."""
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic"))
    found, sizes = bounded_sample(marked, "id", "toxic", per_label)
    chosen = dict(found)
    if len(set(chosen.values())) < 2:
        return None
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], T.StructType([T.StructField("id", docs.schema[id_col].dataType)]))
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id", "left_semi")  # at most per_label ids a label
    texts = sorted(((r["id"], r["text"] or "") for r in got.toLocalIterator()))
    y = np.array([chosen[i] for i, _ in texts], dtype=float)
    return fit([t for _, t in texts], y, share=sizes[1] / (sizes[0] + sizes[1]))


def fit(texts: list[str], y: np.ndarray, rounds: int = 45, share: float | None = None) -> ToxicModel | None:
    """The model of texts with labels 0 and 1; share: of toxic texts among all, where the texts are not in that proportion."""
    if len(set(y.tolist())) < 2:
        return None
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = fold_case(np.frombuffer(b"".join(raw), dtype=np.uint8))
    starts, ends, first = blocks.words(data, np.concatenate(([0], np.cumsum([len(x) for x in raw]))), blocks.ALNUM)
    if not len(starts):
        return None
    s, e, word = distinct_words(data, starts, ends)
    doc = np.repeat(np.arange(len(raw)), np.diff(first))
    seen = np.unique(doc * len(s) + word)
    w, d = seen % len(s), seen // len(s)
    na, nb = y.sum(), (1 - y).sum()
    a = np.bincount(w, weights=y[d], minlength=len(s))
    b = np.bincount(w, weights=1 - y[d], minlength=len(s))
    strong = _evidence(a, b, na, nb) >= EVIDENCE
    strong &= b * na < 0.1 * a * nb  # words that clean documents hold too tag nothing
    gram, owner = word_ngrams(data, s, e, ORDERS, BITS)
    size = np.maximum(np.bincount(owner, minlength=len(s)), 1)
    begins = np.zeros(len(starts), dtype=bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    toxic = y[doc] > 0
    model = None
    for again in range(2):
        tag = toxic & strong[word]
        if again:
            tag |= toxic & (p > 0.5)  # noqa: F821  marginals of the first round
        model, p = _field(tag.astype(float), word, len(s), gram, owner, size, begins, rounds)
    share = y.mean() if share is None else share
    model.curve = _curve(_summary(p, first), y, np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean())))
    return model


def _sums(index, weights, n: int, step: int = 1 << 19) -> np.ndarray:
    """np.bincount by pieces; weights: of a slice of index. Bounds the memory of the driver."""
    out = np.zeros(n)
    for k in range(0, len(index), step):
        part = slice(k, k + step)
        out += np.bincount(index[part], weights=weights(part), minlength=n)
    return out


def _field(tag, word, n_words, gram, owner, size, begins, rounds):
    """Maximum likelihood of the tags by Adam with a ridge."""
    theta = np.zeros((1 << BITS) + 1 + 4 + 2)
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(tag)
    root = np.sqrt(size)
    theta[1 << BITS] = -4.0
    before = np.flatnonzero(~begins)
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((tag[before - 1] == i) & (tag[before] == j)).sum()
    first = np.array([(tag[begins] == 0).sum(), (tag[begins] == 1).sum()], dtype=float)
    weight = 1.0 / max(tag.sum(), 1.0)

    def unpack():
        return theta[: 1 << BITS], theta[1 << BITS], theta[-6:-2].reshape(2, 2), theta[-2:]

    pieces = _pieces(begins)
    for k in range(1, rounds + 1):
        w, bias, transition, start = unpack()
        score = (bias + _sums(owner, lambda part: w[gram[part]], n_words) / root).astype(np.float64)  # noqa: B023
        weigh, gap, pairs, starts = np.exp(transition), np.zeros(n_words), np.zeros((2, 2)), np.zeros(2)
        for part in pieces:
            own, head = word[part], begins[part]
            u = score[own]
            p, alpha, beta = marginals(u, head, transition, start)
            gap += np.bincount(own, weights=tag[part] - p, minlength=n_words)
            inner = np.flatnonzero(~head)
            ahead = (beta[0, inner], beta[1, inner] * np.exp(np.clip(u[inner], -30, 30)))
            rows = [[weigh[i, j] * alpha[i, inner - 1] * ahead[j] for j in (0, 1)] for i in (0, 1)]
            total = rows[0][0] + rows[0][1] + rows[1][0] + rows[1][1]
            pairs += [[(x / total).sum() for x in r] for r in rows]
            starts += ((1 - p[head]).sum(), p[head].sum())
        g = np.zeros_like(theta)
        share = gap / root
        g[: 1 << BITS] = _sums(gram, lambda part: share[owner[part]], 1 << BITS)  # noqa: B023
        g[1 << BITS] = gap.sum()
        g[-6:-2] = (seen - pairs).ravel()
        g[-2:] = first - starts
        g = g * weight
        g[: 1 << BITS] -= 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.25 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    w, bias, transition, start = unpack()
    model = ToxicModel(w.astype(np.float32), float(bias), transition.copy(), start.copy(), np.zeros(3))
    score = bias + _sums(owner, lambda part: w[gram[part]], n_words) / root
    return model, np.concatenate([marginals(score[word[part]], begins[part], transition, start)[0] for part in pieces])


#: Tokens whose marginals the training holds at once, or one text's.
PIECE = 1 << 16


def _pieces(begins: np.ndarray) -> list[slice]:
    """Runs of whole chains of about PIECE tokens."""
    ends, cuts = np.append(np.flatnonzero(begins), len(begins)), [0]
    while cuts[-1] < len(begins):
        k = int(np.searchsorted(ends, cuts[-1] + PIECE, side="right")) - 1
        k = k if ends[k] > cuts[-1] else k + 1
        cuts.append(int(ends[k]))
    return [slice(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def tag_batches(model: ToxicModel | None, text_at: int, batches, limit: int = blocks.SLICE_BYTES // 2, spans: bool = True):
    """(batch, scores, list of (start, end, probability) of each text) of Arrow batches; offsets count characters."""
    for batch in batches:
        data, offsets, _ = blocks.buffer_of(batch.column(text_at))
        scores, found = [np.zeros(0)], []
        for i, j in blocks.slices(offsets, limit):
            if model is None:
                scores.append(np.zeros(j - i))
                found += [[]] * (j - i)
                continue
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, first, p = model.tokens(part, at)
            scores.append(model.scores(p, first))
            own: list[list] = [[] for _ in range(j - i)]
            hit = np.flatnonzero(p >= 0.5) if spans else ()
            if len(hit):
                head = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                doc = np.searchsorted(first, hit, side="right") - 1
                base = head[at[doc]]
                for d, a, b, x in zip(doc.tolist(), (head[starts[hit]] - base).tolist(), (head[ends[hit]] - base).tolist(), p[hit].tolist(), strict=True):
                    own[d].append((a, b, x))
            found += own
        yield batch, np.concatenate(scores), found


def score(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and the offending spans of every row; a scan without a shuffle."""
    blocks.bound_batches(docs.sparkSession)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches):
        for batch, scores, found in tag_batches(model, 1, batches):
            spans = pa.array([[{"start": a, "end": b, "p": x} for a, b, x in s] for s in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), spans], ["doc_id", "score", "predicted", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {kind}, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def keep_clean(docs: DataFrame, model: ToxicModel | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below 0.5; in one scan."""
    blocks.bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch, scores, _ in tag_batches(model, at, batches, spans=False):
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)
