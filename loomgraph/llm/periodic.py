"""Runs of repeated word sequences in whole texts, by heavy/light lag counting.

A run is a stretch of words with smallest period q (words q apart are equal)
of at least ``LEAST`` and 2 q words that no neighbouring word extends. For each
text:

1. *Counts of lags.* The number of places i with word i = word i + q, for every
   lag q up to half the text. The occurrences of a rare word are subtracted
   pair by pair; a word of more than ``heavy_from(n)`` occurrences would
   cost more that way than a transform does, so the frequent words of a text are
   counted together by exact autocorrelation: the sum of the squared spectra of
   their indicators, transformed back and rounded.
2. *Scans.* A run of period q has max(q, LEAST - q) equal places in a row; only
   lags with so many are scanned. Such a row covers a multiple of its own
   length, so a scan looks at those multiples first and reads the places between
   them only around equal ones.
3. A stretch found at several lags has the smallest of them as its period: of
   two periods that both fit twice into it, their greatest common divisor is
   one too, so the smaller divides the larger and was found with the same ends.

A text's memory is linear in its words; nothing is shuffled. Words are compared
by 64-bit hashes.

Defined cases: null and empty texts, and texts of white space, have no words and
no runs; a text of any length is one unit of work; rows that repeat get the
same answer; null ids stay; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import blocks

LEAST = 12
#: Places beside an equal one that a scan of a long lag reads before it reads them all.
_REACH = 8
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def heavy_from(n: int) -> float:
    """Occurrences from which f^2 / 2 pairs cost more than a transform of n words."""
    return max(16.0, (6.0 * n * np.log2(max(n, 2))) ** 0.5)


def light_counts(word: np.ndarray, first: np.ndarray, base: np.ndarray, total: int, heavy) -> np.ndarray:
    """Counts of lags of all texts of a slice, from the pairs of equal rare words.

    word: numbers that differ between texts; first: first word of each text; a
    text's lag q is counted at base + q; heavy: flags of words left out.
    """
    counts = np.zeros(total, dtype=np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    half = np.diff(first) // 2
    order = np.argsort(word, kind="stable")
    order = order[~heavy[word[order]]]
    own, at = word[order], np.arange(len(order))
    step = 1
    while len(at):
        at = at[at + step < len(own)]
        lag = order[at + step] - order[at]
        fine = (own[at + step] == own[at]) & (lag <= half[text[order[at]]])
        at, lag = at[fine], lag[fine]  # the next occurrences of a word are only further away
        place = base[text[order[at]]] + lag
        if len(at) < total // 8:
            np.add.at(counts, place, 1)
        else:
            counts += np.bincount(place, minlength=total)
        step += 1
    return counts


def heavy_counts(word: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Counts of lags 0 to n // 2 of one text, from its frequent words, by autocorrelation."""
    n = len(word)
    size = 1 << int(2 * n - 1).bit_length()
    power = np.zeros(size // 2 + 1)
    for w in frequent.tolist():
        spectrum = np.fft.rfft(word == w, size)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: n // 2 + 1]).astype(np.int64)


def _islands(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return starts[long], ends[long]


def scan(word: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the rows of at least ``least`` places i with word[i] == word[i + lag]."""
    n = len(word) - lag
    probe = np.arange(0, n, least)
    hit = probe[word[probe] == word[probe + lag]]
    if not len(hit):
        return hit, hit
    if 4 * least * len(hit) > n:
        return _islands(word[:n] == word[lag:], least)
    if least > 2 * _REACH:  # a row around a multiple has so many equal places before or after it
        near = hit[:, None] + np.arange(1, _REACH + 1)
        ahead = ((near < n) & (word[np.minimum(near, n - 1)] == word[np.minimum(near, n - 1) + lag])).all(axis=1)
        near = hit[:, None] - np.arange(1, _REACH + 1)
        hit = hit[ahead | ((near >= 0) & (word[np.maximum(near, 0)] == word[np.maximum(near, 0) + lag])).all(axis=1)]
        if not len(hit):
            return hit, hit
    cut = np.flatnonzero(np.diff(hit) > least) + 1
    starts, ends = [], []
    for group in np.split(hit, cut):
        a, b = max(int(group[0]) - least + 1, 0), min(int(group[-1]) + least, n)
        s, e = _islands(word[a:b] == word[a + lag : b + lag], least)
        starts.append(s + a)
        ends.append(e + a)
    return np.concatenate(starts), np.concatenate(ends)


def runs_of(word: np.ndarray, counts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of a text, by start and period; counts: of its lags 0 to n // 2."""
    lags = np.arange(len(counts))
    need = np.maximum(lags, least - lags)
    found: dict[tuple[int, int], int] = {}
    for lag in np.flatnonzero((lags > 0) & (counts >= need)).tolist():
        for s, e in zip(*(x.tolist() for x in scan(word, lag, int(need[lag]))), strict=True):
            found.setdefault((s, e + lag), lag)  # lags come in ascending order
    out = np.array(sorted((s, q, e - s) for (s, e), q in found.items()), dtype=np.int64).reshape(-1, 3)
    return out[:, [0, 2, 1]]


def slice_runs(h: np.ndarray, first: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """Runs of each text of a slice of word hashes."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, text))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    word = np.empty(len(h), dtype=np.int64)
    word[order] = np.cumsum(new) - 1
    often = np.bincount(word) if len(word) else np.zeros(0, np.int64)
    of = text[order][new]
    heavy = often > np.array([heavy_from(x) for x in n.tolist()])[of] if len(word) else np.zeros(0, bool)
    width = n // 2 + 1
    base = np.cumsum(width) - width
    counts = light_counts(word, first, base, int(width.sum()), heavy)
    for d in np.unique(of[heavy]).tolist():
        own = word[first[d] : first[d + 1]]
        counts[base[d] : base[d] + width[d]] += heavy_counts(own, np.flatnonzero(heavy & (of == d)))
    return [runs_of(word[a:b], counts[c : c + w], least) if b - a >= least else np.zeros((0, 3), np.int64) for a, b, c, w in zip(first[:-1].tolist(), first[1:].tolist(), base.tolist(), width.tolist(), strict=True)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Flags of the words that no run holds after its first period."""
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed text of every row of docs.

    The collapsed text is null for a null text, else the kept words joined by one blank.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    blocks.bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets, valid = blocks.buffer_of(batch.column(1))
            words, runs, texts = [np.zeros(0, np.int64)], [], []
            for i, j in blocks.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first, h = blocks.word_hashes(part, at, lower=False)
                raw = part.tobytes()
                words.append(np.diff(first))
                for a, b, own in zip(first[:-1].tolist(), first[1:].tolist(), slice_runs(h, first, least), strict=True):
                    keep = np.flatnonzero(kept_words(b - a, own)) + a
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()])
                    texts.append(b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
            collapsed = pa.array(texts, pa.binary(), mask=~valid).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words)), pa.array(runs, pa.list_(_RUN)), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, runs {_RUNS}, collapsed string")


def looped_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 10) -> DataFrame:
    """doc_id and text, with loops in about one of ``every`` texts, so that runs of all lengths occur.

    Where h = crc32 of the id as text is divisible by ``every``, with g = h // every and n > 0 words,
    word i from a = g % n on becomes word a + (i - a) % (1 + (n - a) // (3 + g % 8)). Other texts stay.
    """
    blocks.bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            marks = batch.column(2).to_pylist()
            if any(m is not None and m % every == 0 for m in marks):
                data, offsets, _ = blocks.buffer_of(texts)
                out = texts.cast(pa.large_binary()).to_pylist()
                for k, mark in enumerate(marks):
                    if mark is None or mark % every or out[k] is None:
                        continue
                    part = data[offsets[k] : offsets[k + 1]]
                    starts, ends, _ = blocks.words(part, np.array([0, len(part)]), blocks.NOT_SPACE)
                    n, g = len(starts), mark // every
                    if n:
                        a = g % n
                        at = np.arange(n)
                        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
                        raw = part.tobytes()
                        pieces = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                        out[k] = b" ".join([pieces[x] for x in at.tolist()])
                texts = pa.array(out, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.string())], ["doc_id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    crc = F.crc32(F.col(id_col).cast("string"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), crc.alias("mark")).mapInArrow(run, f"doc_id {kind}, text string")


def runs_digest(runs: list) -> str:
    """sha256 of the lines start,length,period of all runs."""
    return hashlib.sha256("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs).encode()).hexdigest()
