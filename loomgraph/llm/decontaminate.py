"""Benchmark decontamination with suffix arrays over the training text.

Each slice of documents is a shard. Its suffix array holds, in word order,
every suffix of the runs of benchmark words that are as long as the shortest
window (words that the benchmark lacks end a suffix, as the end of a document
does: no match crosses either). The array is sorted by the first words and
then by doubling, as far as the longest test suffix reaches.

Each test suffix, one for each window of the benchmark, is binary-searched in
every shard: by its first words, and within the range that has them by all its
words. The common lengths with both neighbours of its place in the array give
its longest match there; going outward, the least common length of adjacent
suffixes gives the match at every other location. Matches that begin one word
earlier in both texts are part of a longer one and left out.

The benchmark travels to the executors in blocks of at most ``BLOCK_WORDS``
words, one at a time: where it is more than one block, the documents and what
was found so far are written to the shared folder between two blocks, and a
block is removed from the executors after its scan. Nothing is shuffled.

Defined cases: null and empty texts have no words; an item without words
matches nothing; an item of fewer words than a window is one window; items
that repeat an id count once; a null item id counts as the empty string;
repeated documents get the same answer; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import blocks

WINDOW = 10
#: Bound of what is broadcast at once: words of one block of the benchmark.
BLOCK_WORDS = 2_000_000


@dataclass
class TestSuffixes:
    """Test suffixes of a block of the benchmark, ordered by the windows they begin with."""

    width: int
    vocabulary: np.ndarray  # sorted word hashes; the id of a word is its place + 1
    words: np.ndarray  # word hashes of all items, one item after another
    keys: np.ndarray  # distinct windows: big-endian ids, padded with 0
    length: np.ndarray  # words of each window
    bounds: np.ndarray  # suffixes of window k: bounds[k] up to bounds[k + 1]
    at: np.ndarray  # first word of each suffix, among words
    place: np.ndarray  # and within its item
    rest: np.ndarray  # words from there to the item's end
    item: np.ndarray
    items: list[str]


def test_suffixes(rows: list[tuple[str, str | None]], width: int = WINDOW) -> TestSuffixes:
    raw = [(t or "").encode() for _, t in rows]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    _, _, first, h = blocks.word_hashes(data, np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64), blocks.ALNUM)
    vocabulary = np.unique(h)
    ids = np.append(np.searchsorted(vocabulary, h) + 1, np.zeros(width, dtype=np.int64)).astype(np.uint32)
    names = sorted({i for i, _ in rows})
    number = {x: k for k, x in enumerate(names)}
    size = np.diff(first)
    windows = np.where(size > 0, size - np.minimum(size, width) + 1, 0)
    row = np.repeat(np.arange(len(rows)), windows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at, length = first[row] + place, np.minimum(size, width)[row]
    keys, which = np.unique(_key(_first_words(ids, at, length, width)), return_inverse=True)
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(len(keys) + 1))
    item = np.array([number[i] for i, _ in rows], dtype=np.int64)[row] if rows else row
    return TestSuffixes(width, vocabulary, h, keys, length[order][bounds[:-1]], bounds, at[order], place[order], (size[row] - place)[order], item[order], names)


def _first_words(ids: np.ndarray, at: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(at), width), dtype=">u4")
    for k in range(width):
        inside = length > k
        out[inside, k] = ids[at[inside] + k]
    return out


def _key(matrix: np.ndarray) -> np.ndarray:
    """Rows as byte strings that sort like the rows."""
    return np.ascontiguousarray(matrix, dtype=">u4").view(f"S{4 * matrix.shape[1]}").ravel()


def suffix_array(ids: np.ndarray, run: np.ndarray, of: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at of, in the order of their first reach words or more (equal ones by place), and their first width words as keys.

    A suffix is the next run words; with a word, of holds all later words of its run.
    """
    keys = _key(_first_words(ids, of, run[of], width))
    order = np.argsort(keys, kind="stable")
    suffix, keys = of[order], keys[order]
    place = np.arange(len(suffix))
    rank = np.zeros(len(ids) + 1, dtype=np.int64)  # place of the first equal suffix, from 1; 0 is the end
    rank[suffix] = 1 + np.maximum.accumulate(np.where(np.append(True, keys[1:] != keys[:-1]), place, 0)) if len(suffix) else 0
    while width < reach:
        r = rank[suffix]
        same = r[1:] == r[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        p = suffix[tied]
        more = run[p] > width
        if not more.any():
            break
        pair = r[tied] * (len(suffix) + 1) + np.where(more, rank[np.where(more, p + width, len(ids))], 0)
        order = np.argsort(pair, kind="stable")
        p, pair = p[order], pair[order]
        suffix[tied] = p
        rank[p] = 1 + np.maximum.accumulate(np.where(np.append(True, pair[1:] != pair[:-1]), tied, 0))
        width *= 2
    return suffix, keys


_PRIME = (1 << 61) - 1
_BASE = 0x1E3779B97F4A7C15 % _PRIME
_U = np.uint64


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo _PRIME, for x below 2^63."""
    x = (x & _U(_PRIME)) + (x >> _U(61))
    return np.where(x >= _U(_PRIME), x - _U(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo _PRIME, by halves of 31 and 30 bits."""
    a1, a0, b1, b0 = a >> _U(31), a & _U(0x7FFFFFFF), b >> _U(31), b & _U(0x7FFFFFFF)
    middle = a0 * b1 + a1 * b0
    high = _fold(_U(2) * a1 * b1 + (middle >> _U(30)))
    return _fold(high + _fold(((middle & _U(0x3FFFFFFF)) << _U(31)) + a0 * b0))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate((out, _times(out, np.full(len(out), pow(base, len(out), _PRIME), dtype=np.uint64))))
    return out[:n]


class _Spans:
    """Common lengths of spans of word hashes, by polynomials of their prefixes modulo a prime.

    Modulo a power of two, regular sequences of two words would have equal polynomials.
    """

    def __init__(self, words: np.ndarray):
        terms = _times(_fold(words >> _U(1)), _powers(_BASE, len(words)))
        low, high = np.cumsum(terms & _U(0xFFFFFFFF)), np.cumsum(terms >> _U(32))
        high = _fold(high)
        sums = _fold(_fold(low) + _times(high, np.full(len(high), 1 << 32, dtype=np.uint64)))
        self.sums = np.append(_U(0), sums)
        self.down = _powers(pow(_BASE, -1, _PRIME), len(self.sums))

    def _of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _times(_fold(self.sums[at + size] + (_U(_PRIME) - self.sums[at])), self.down[at])

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self._of(a, middle) == self._of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def search(test: TestSuffixes, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position, test suffix, words) of every maximal match in a shard of word hashes, documents beginning at first."""
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    n = len(h)
    if not n or not len(test.length):
        return none
    at = np.minimum(np.searchsorted(test.vocabulary, h), len(test.vocabulary) - 1)
    ids = np.where(test.vocabulary[at] == h, at + 1, 0)
    # words ahead, up to the first that the benchmark lacks or the end of the document
    stop = np.zeros(n + 1, dtype=bool)
    stop[first] = True
    stop[:-1] |= ids == 0
    stop[n] = True
    ends = np.flatnonzero(stop)
    position = np.arange(n)
    of_run = np.searchsorted(ends, position, side="right")
    run = ends[of_run] - position
    run[ids == 0] = 0
    words_of_run = np.bincount(of_run[ids > 0], minlength=len(ends) + 1)
    suffix, keys = suffix_array(ids, run, np.flatnonzero((ids > 0) & (words_of_run[of_run] >= test.length.min())), test.width, int(test.rest.max()))
    if not len(suffix):
        return none
    # the range of the first words of each window
    low = np.searchsorted(keys, test.keys, side="left")
    full = test.length == test.width
    high = np.empty_like(low)
    high[full] = np.searchsorted(keys, test.keys[full], side="right")
    if not full.all():
        top = np.frombuffer(test.keys[~full].tobytes(), dtype=">u4").reshape(-1, test.width).copy()
        for k, size in enumerate(test.length[~full]):
            top[k, size:] = 0xFFFFFFFF
        high[~full] = np.searchsorted(keys, _key(top), side="right")
    found = np.flatnonzero(high > low)
    if not len(found):
        return none
    count = test.bounds[found + 1] - test.bounds[found]
    own = np.repeat(test.bounds[found] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    low, high = np.repeat(low[found], count), np.repeat(high[found], count)
    # within it, the place of the whole test suffix
    spans = _Spans(np.concatenate((test.words, h)))
    begin, rest, shift = test.at[own], test.rest[own], len(test.words)

    def match(which, k):
        p = suffix[k]
        return spans.common(begin[which], shift + p, np.minimum(rest[which], run[p]))

    lo, hi = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        middle = (lo[open_] + hi[open_]) >> 1
        p, size = suffix[middle], match(open_, middle)
        ended, short = size == rest[open_], size == run[suffix[middle]]
        q = np.where(ended, begin[open_], begin[open_] + size)
        mine = np.searchsorted(test.vocabulary, test.words[q]) + 1
        less = ~ended & (short | (ids[np.where(short, p, p + size)] < mine))  # the array's suffix comes first
        lo[open_], hi[open_] = np.where(less, middle + 1, lo[open_]), np.where(less, hi[open_], middle)
    before, after = np.flatnonzero(lo > low), np.flatnonzero(lo < high)
    left, right = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
    left[before], right[after] = match(before, lo[before] - 1), match(after, lo[after])
    # common lengths of adjacent suffixes, in these ranges
    inside = np.zeros(len(suffix) + 1, dtype=np.int64)
    np.add.at(inside, low + 1, 1)
    np.add.at(inside, high, -1)
    k = np.flatnonzero(np.cumsum(inside) > 0)
    adjacent = np.zeros(len(suffix), dtype=np.int64)
    adjacent[k] = spans.common(shift + suffix[k - 1], shift + suffix[k], np.minimum(run[suffix[k - 1]], run[suffix[k]]))
    places, sizes = [], []
    for a, m, b, x, y in zip(low.tolist(), lo.tolist(), high.tolist(), left.tolist(), right.tolist(), strict=True):
        size = np.empty(b - a, dtype=np.int64)
        if m > a:
            size[m - a - 1 :: -1] = np.minimum.accumulate(np.append(x, adjacent[m - 1 : a : -1]))
        if m < b:
            size[m - a :] = np.minimum.accumulate(np.append(y, adjacent[m + 1 : b]))
        places.append(suffix[a:b])
        sizes.append(size)
    p, own, size = np.concatenate(places), np.repeat(own, high - low), np.concatenate(sizes)
    starts = np.zeros(n + 1, dtype=bool)
    starts[first] = True
    maximal = starts[p] | (test.place[own] == 0)
    maximal[~maximal] = h[p[~maximal] - 1] != test.words[test.at[own[~maximal]] - 1]
    return p[maximal], own[maximal], size[maximal]


_MATCH = pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])
_MATCHES = "array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")


def _blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    rows, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        n = sum(1 for _ in _WORD.finditer((r["t"] or "").encode())) + 1
        if rows and size + n > block_words:
            yield rows
            rows, size = [], 0
        rows.append((r["i"] or "", r["t"]))
        size += n
    yield rows


def _by_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, width: int, block_words: int, scan) -> DataFrame:
    """docs after scan(docs, shared block, whether it is the last) of each block, written to the shared folder between two."""
    spark, path = docs.sparkSession, None
    found = _blocks_of(benchmark, item_col, text_col, block_words)
    following = next(found)
    while True:
        rows, following = following, next(found, None)
        shared = spark.sparkContext.broadcast(test_suffixes(rows, width))  # bounded by block_words
        docs = scan(docs, shared, following is None)
        if following is None:
            return docs
        earlier = path
        docs, path = blocks.stored(docs, "decontamination")
        shared.unpersist()
        if earlier:
            blocks.drop_path(spark, earlier)


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a match), item_ids and the maximal matches of every row of docs."""
    blocks.bound_batches(docs.sparkSession)

    def scan(rows: DataFrame, shared, last: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                test = shared.value
                data, offsets, _ = blocks.buffer_of(batch.column(1))
                words, hits, items, matches = [], [], [], []
                earlier = batch.column(4).to_pylist()
                for i, j in blocks.slices(offsets):
                    _, _, first, h = blocks.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], blocks.ALNUM)
                    long = [list(x or ()) for x in earlier[i:j]]
                    p, own, size = search(test, h, first)
                    doc = np.searchsorted(first, p, side="right") - 1
                    order = np.lexsort((test.place[own], p, test.item[own], doc))
                    for d, x, a, b, c in zip(*(x[order].tolist() for x in (doc, test.item[own], p - first[doc], test.place[own], size)), strict=True):
                        long[d].append({"item_id": test.items[x], "doc_word": a, "item_word": b, "n_words": c})
                    cover = np.zeros(len(h) + 1, dtype=np.int64)
                    at = np.array([(first[d] + m["doc_word"], m["n_words"]) for d, x in enumerate(long) for m in x], dtype=np.int64).reshape(-1, 2)
                    np.add.at(cover, at[:, 0], 1)
                    np.add.at(cover, at.sum(axis=1), -1)
                    hit = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
                    words.append(np.diff(first))
                    hits.append(hit[first[1:]] - hit[first[:-1]])
                    items += [sorted({m["item_id"] for m in x}) for x in long]
                    matches += long
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1), pa.array(np.concatenate(words) if words else [], pa.int64()), pa.array(np.concatenate(hits) if hits else [], pa.int64()), pa.array(matches, pa.list_(_MATCH)), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "text", "n_words", "n_hit", "matches", "item_ids"],
                )

        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(run, f"doc_id {kind}, text string, n_words long, n_hit long, matches {_MATCHES}, item_ids array<string>")

    empty = F.lit(None)
    start = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), empty.cast("long").alias("n_words"), empty.cast("long").alias("n_hit"), empty.cast(_MATCHES).alias("matches"))
    return _by_blocks(start, benchmark, item_col, text_col, width, block_words, scan).select("doc_id", "n_words", "n_hit", "item_ids", "matches")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark occurs."""
    blocks.bound_batches(docs.sparkSession)
    column = docs.columns.index(text_col)

    def scan(rows: DataFrame, shared, last: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                data, offsets, _ = blocks.buffer_of(batch.column(column))
                clean = np.ones(batch.num_rows, dtype=bool)
                for i, j in blocks.slices(offsets):
                    _, _, first, h = blocks.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], blocks.ALNUM)
                    clean[i + np.searchsorted(first, search(shared.value, h, first)[0], side="right") - 1] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(run, rows.schema)

    return _by_blocks(docs, benchmark, item_col, text_col, width, block_words, scan)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
