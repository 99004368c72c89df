"""Language identification by hierarchical discrimination.

A linear machine for each family names the family of a text; within it,
one-versus-one linear support vector machines separate the languages by vote.
Features are hashed byte 1- to 4-grams of words as relative frequencies, so a
text's decision values are sums over its words, and each distinct word of a
block is scored once.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with null lang or null id are never learned from and still predicted;
no rows to learn from: every text with a letter is ``und``; repeated rows get
the same answer; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import blocks
from loomgraph.llm.features import WORD_BYTES, bounded_sample, distinct_words, fold_case, linear_machine, word_ngrams

#: Language families; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
}
UNKNOWN = "und"
ORDERS, BITS = (1, 2, 3, 4), 13
#: Bound of the training sample: documents of each language.
PER_LANGUAGE = 300


@dataclass
class LanguageModel:
    """Columns of weights: one a family (if there are two or more), then one a pair of languages of a family."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def values(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Decision values, one row a text."""
        data = fold_case(data)
        starts, ends, first = blocks.words(data, offsets, WORD_BYTES)
        out = np.zeros((len(offsets) - 1, self.weights.shape[1]))
        if len(starts) and self.weights.shape[1]:
            s, e, inverse = distinct_words(data, starts, ends)
            gram, owner = word_ngrams(data, s, e, ORDERS, BITS)
            size = np.bincount(owner, minlength=len(s)).astype(float)
            total = np.concatenate(([0.0], np.cumsum(size[inverse])))
            n = np.maximum(total[first[1:]] - total[first[:-1]], 1.0)
            for k in range(out.shape[1]):
                score = np.bincount(owner, weights=self.weights[gram, k], minlength=len(s))
                total = np.concatenate(([0.0], np.cumsum(score[inverse])))
                out[:, k] = (total[first[1:]] - total[first[:-1]]) / n
        return out + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        v, n = self.values(data, offsets), len(offsets) - 1
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        many = len(self.families) > 1
        family = v[:, : len(self.families)].argmax(axis=1) if many else np.zeros(n, dtype=int)
        ranked = np.sort(v[:, : len(self.families)], axis=1) if many else None
        score = _logistic(ranked[:, -1] - ranked[:, -2]) if many else np.ones(n)
        names = np.empty(n, dtype=object)
        for k, f in enumerate(self.families):
            own = np.flatnonzero(family == k)
            langs = self.members[f]
            votes = np.zeros((len(own), len(langs)))
            near = np.full((len(own), len(langs)), np.inf)
            for c, (g, a, b) in enumerate(self.pairs, start=len(self.families) * many):
                if g == f:
                    margin, i, j = v[own, c], langs.index(a), langs.index(b)
                    # a vote each, and a trace of the margin for ties
                    votes[:, i] += (margin >= 0) + 1e-3 * np.tanh(margin)
                    votes[:, j] += (margin < 0) - 1e-3 * np.tanh(margin)
                    near[:, i], near[:, j] = np.minimum(near[:, i], margin), np.minimum(near[:, j], -margin)
            best = votes.argmax(axis=1) if len(langs) > 1 else np.zeros(len(own), dtype=int)
            names[own] = np.array(langs, dtype=object)[best]
            if len(langs) > 1:
                score[own] = np.minimum(score[own], _logistic(2 * near[np.arange(len(own)), best]))
        return names.tolist(), score


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * x, -40, 40)))


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fits the model on a bounded sample of labelled documents outside the held-out fold."""
    chosen, _ = bounded_sample(docs.where(F.col(text_col).isNotNull()), id_col, lang_col, per_language)
    texts = {}
    if chosen:
        ids = docs.sparkSession.createDataFrame([(i,) for i, _ in chosen], T.StructType([T.StructField("id", docs.schema[id_col].dataType)]))
        got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id", "left_semi")  # at most per_language ids a language
        texts = {r["id"]: r["text"] or "" for r in got.toLocalIterator()}
    langs = np.array([y for i, y in chosen if i in texts], dtype=object)
    raw = [texts[i].encode() for i, _ in chosen if i in texts]
    if not raw:
        return LanguageModel()
    data = fold_case(np.frombuffer(b"".join(raw), dtype=np.uint8))
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    starts, ends, first = blocks.words(data, offsets, WORD_BYTES)
    x = np.zeros((len(raw), 1 << BITS), dtype=np.float32)
    for i in range(len(raw)):
        s, e = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]
        if len(s):
            gram, _ = word_ngrams(data, s, e, ORDERS, BITS)
            x[i] = np.bincount(gram, minlength=1 << BITS) / len(gram)
    scale = 1 / (x.std(axis=0) + 1e-4) / np.sqrt(1 << BITS)
    x *= scale
    out = LanguageModel(members={})
    for lang in sorted(set(langs)):
        out.members.setdefault(family_of(lang), []).append(lang)
    out.families = sorted(out.members)
    families = np.array([family_of(y) for y in langs], dtype=object)
    columns = [linear_machine(x, families == f) for f in out.families] if len(out.families) > 1 else []
    for f in out.families:
        for a, b in combinations(out.members[f], 2):
            own = (langs == a) | (langs == b)
            out.pairs.append((f, a, b))
            columns.append(linear_machine(x[own], langs[own] == a))
    if columns:
        out.weights = np.stack([w * scale for w, _ in columns], axis=1).astype(np.float32)
        out.bias = np.array([b for _, b in columns])
    return out


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate(([0], np.cumsum((blocks.LOWER[data] >= 0x61) & (blocks.LOWER[data] <= 0x7A))))
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def label_batches(model: LanguageModel, text_at: int, batches, limit: int = blocks.SLICE_BYTES // 2):
    """(batch, predicted languages, scores) of Arrow batches whose column text_at holds the texts."""
    for batch in batches:
        data, offsets, _ = blocks.buffer_of(batch.column(text_at))
        names, scores = [], []
        for i, j in blocks.slices(offsets, limit):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            lang, score = model.predict(part, at)
            letter = _has_letter(part, at)
            names += [x if k else UNKNOWN for x, k in zip(lang, letter, strict=True)]
            scores.append(np.where(letter, score, 0.0))
        yield batch, names, np.concatenate(scores) if scores else np.zeros(0)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row of docs; a scan without a shuffle."""
    blocks.bound_batches(docs.sparkSession)

    def run(batches):
        for batch, names, scores in label_batches(model, 1, batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has a language; in one scan."""
    blocks.bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch, names, _ in label_batches(model, at, batches):
            yield batch.filter(pa.array([x != UNKNOWN for x in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
