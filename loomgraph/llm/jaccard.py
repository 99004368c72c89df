"""Jaccard join of word-shingle sets with parity sketches.

A document's shingles are hashed into a bit sketch by exclusive or: each
shingle flips one bit, so two sketches differ in at most as many bits as the
sets differ in shingles. Sketches are made for each size band (sizes within
twice of each other; a document also enters the next band if a set there may be
similar enough). For sets of sizes a and b that are similar enough, at most
d = (a + b)(1 - t)/(1 + t) shingles differ, so of a document's parts of the
sketch that hold a shingle all but d must be equal in its partner: its spare
parts. This sketch is wide (``BITS`` bits a part) and sparse: a part is the
exclusive or of the codes of its set bits. In bands of small sets every shingle
is a part of its own. Where parts that several shingles fall into leave a
larger set no part to spare, it also takes part with one part a shingle; two
sets without spare parts meet there.

Equal sets are one class from the start. Then, by pigeonhole:

1. parts are dealt by key and counted; those that one class alone holds go. A
   class with fewer parts left than it must share has no partner and goes too;
2. the parts of a class are put into one order for all classes: by the number
   of classes that hold them, then by key. Of n parts at least s are common to
   a pair, so both hold the first common one among their first n - s + 1;
3. a part that at most ``HOT`` classes hold gives their pairs; of a hot one the
   smallest class is compared with the others. Candidates are verified by the
   Hamming distance of dense sketches, then on the whole sets;
4. the classes of a hot part that are still in several components are packed
   into blocks of bounded bytes, clustered by component and size. Blocks that
   share such a part are compared with each other, first by Hamming distance,
   then exactly where the two components are still apart; only links that join
   components become rows. The work grows with the square of the classes that
   share a common text without being copies of it, by ``BLOCK_BYTES`` pieces.

Links inside one component are not listed.

Defined cases: null texts and texts without words have no shingles and link
with nothing, not even with each other (component_id is the doc_id); texts of
fewer words than a shingle have one; rows that repeat a doc_id each get a row,
null ids take part and get the smallest other id of their component, else
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import blocks
from loomgraph.llm.components import components

WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
BITS = 1 << 26
#: Classes that may share a part before it counts as hot.
HOT = 16
#: Parts packed at once, and shingles whose parts one task sorts.
SEND, DEAL = 1_000_000, 2_000_000
#: Sizes of the bands below this have one part a shingle.
SMALL = 96
#: Bits of a part's key that are not sent; the lowest two of those that are tell the slot: odd band, one part a shingle.
DROP, SLOTS = 10, 4
BLOCK_BYTES, BLOCK_CLASSES = 512 << 10, 512
_U = np.uint64


def _bands(top: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band; sizes double from band to band."""
    out = [1, 2, 3]
    while out[-1] < top:
        out.append(out[-1] * 2)
    return np.array(out, dtype=np.int64)


_LOW = _bands()
_NONE = np.int64(1 << 40)
_SPARES = [f"spare{k}" for k in range(SLOTS)]


def fingerprints(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each set; sets are flat[bounds[i] : bounds[i + 1]]."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(blocks.mix(flat ^ _U(0xC2B2AE3D27D4EB4F)))))
    size = np.diff(bounds).astype(np.uint64)
    return blocks.mix(total[bounds[1:]] - total[bounds[:-1]] + size * _U(0x165667B19E3779F9)).view(np.int64)


def sketch_parts(flat: np.ndarray, bounds: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR):
    """(key, set) of every part that holds a shingle, in all bands of a set, and each set's spare parts by slot.

    spare: parts that must be equal in a partner, at least; ``_NONE`` where a
    set has no parts of that slot.
    """
    size = np.diff(bounds)
    band = np.searchsorted(_LOW, size, side="right") - 1
    keys, owners = [], []
    spare = np.full((SLOTS, len(size)), _NONE)
    doc = np.repeat(np.arange(len(size)), size)
    high, low = flat >> _U(32), flat & _U(BITS - 1)
    code = blocks.mix(low + _U(0x27D4EB2F165667C5))

    def add(key, d, slot):
        keys.append(key & ~_U((SLOTS - 1) << DROP) | slot.astype(np.uint64)[d] << _U(DROP))
        owners.append(d)

    for up in range(4):
        own = size * den >= num * _LOW[band + up] if up else size > 0
        if not own.any():
            break
        top = _LOW[band + up + 1] - 1
        odd = (band + up) & 1
        differ = (size + np.minimum(top, size * den // num)) * (den - num) // (den + num)
        # middling sets have room for a part a shingle, so that a passage they share leaves other parts
        parts = np.where(top < 192, 2 * top, np.where(top < 384, top, np.ceil(0.38 * top))).astype(np.uint64) + _U(12)
        single = own & (top < SMALL)
        inside = np.flatnonzero((own & ~single)[doc])
        if len(inside):
            d = doc[inside]
            part = (high[inside] * parts[d]) >> _U(32)
            begin = np.ones(len(inside), dtype=bool)
            begin[1:] = (d[1:] != d[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(begin)
            parity = np.bitwise_xor.reduceat(code[inside], at)
            d, part = d[at], part[at]
            add(blocks.mix(parity ^ blocks.mix((band[d] + up).astype(np.uint64) << _U(40) | part)), d, odd)
            left = np.bincount(d, minlength=len(size)) - differ
            at = np.flatnonzero(own & ~single)
            spare[odd[at], at] = left[at]
            single |= own & (left <= 0)
        inside = np.flatnonzero(single[doc])
        if len(inside):
            d = doc[inside]
            add(blocks.mix(flat[inside] ^ blocks.mix((band[d] + up).astype(np.uint64) << _U(40) | _U(1 << 39))), d, odd + 2)
            at = np.flatnonzero(single)
            spare[odd[at] + 2, at] = (size - differ)[at]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), spare
    return np.concatenate(keys), np.concatenate(owners), spare


def dense_sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Parity sketch of one set as 64-bit words; bits is a power of two of at least 64."""
    flips = np.bincount((blocks.mix(shingles ^ _U(0xA24BAED4963EE407)) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def sketch_bits(size: int, most: int = 1 << 62) -> int:
    return min(1 << max(9, (8 * max(size, 1) - 1).bit_length()), most)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set in fewer words: the halves' exclusive or."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _sets(batch: pa.RecordBatch, column: int, width: int):
    """(first row, flat hashes, bounds) of slices of a batch."""
    data, offsets, _ = blocks.buffer_of(batch.column(column))
    for i, j in blocks.slices(offsets):
        sets = blocks.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        yield i, np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def digests(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, class (null without shingles) and spare0 to spare3 of every row."""

    def run(batches):
        for batch in batches:
            sizes, marks, spares = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((SLOTS, 0), np.int64)]
            for _, flat, bounds in _sets(batch, 1, width):
                sizes.append(np.diff(bounds))
                marks.append(fingerprints(flat, bounds))
                spares.append(sketch_parts(flat, bounds, num, den)[2])
            n, spare = np.concatenate(sizes), np.concatenate(spares, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.concatenate(marks), mask=n == 0), *(pa.array(x, mask=x == _NONE) for x in spare)], ["doc_id", "n_shingles", "class", *_SPARES])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, class long, {', '.join(f'{x} long' for x in _SPARES)}")


def _cuts(x: np.ndarray) -> list:
    """Bounds of the runs of equal values."""
    return np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)])).tolist() if len(x) else []


def _distinct(key: np.ndarray, mark: np.ndarray):
    """Distinct (key, class), sorted, the first of each key, and its number of classes."""
    order = np.lexsort((mark, key))
    key, mark = key[order], mark[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
    key, mark = key[new], mark[new]
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
    return key, mark, begin, np.diff(np.append(begin, len(key)))


_PIECE = "deal int, hot boolean, keys binary, marks binary, classes binary, counts binary"
_PIECE_TYPES = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _piece(deal: int, hot: bool, key: np.ndarray, mark: np.ndarray, count: np.ndarray | None = None) -> tuple:
    """A row of sorted keys with their classes, packed."""
    table, index = np.unique(mark, return_inverse=True)
    return deal, hot, blocks.squeeze(np.diff(key, prepend=_U(0))), blocks.squeeze(index.astype(np.uint32)), table.tobytes(), None if count is None else blocks.squeeze(count)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], [c.split()[0] for c in _PIECE.split(", ")])


def _unpacked(keys: bytes, marks: bytes, classes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(blocks.spread(keys, np.uint64)), np.frombuffer(classes, dtype=np.int64)[blocks.spread(marks, np.uint32)]


def shared_parts(docs: DataFrame, text_col: str, width: int, num: int, den: int, deals: int) -> DataFrame:
    """Pieces of (part, class, number of classes that hold the part) of parts that several classes hold, dealt by class; 255 classes stand for more than HOT.

    Parts travel packed. A part that is hot within one batch goes on dealt by
    batch, but for a few classes that mark it, so that no task gathers all of
    a very common one.
    """

    def send(batches):
        salt = 0
        for batch in batches:
            keys, classes, size = [], [], 0
            for _, flat, bounds in _sets(batch, 0, width):
                key, owner, _ = sketch_parts(flat, bounds, num, den)
                keys.append(key)
                classes.append(fingerprints(flat, bounds)[owner])
                size += len(key)
                if size >= SEND:
                    salt += 1
                    yield dealt(np.concatenate(keys), np.concatenate(classes), salt)
                    keys, classes, size = [], [], 0
            if size:
                salt += 1
                yield dealt(np.concatenate(keys), np.concatenate(classes), salt)

    def dealt(key, mark, salt):
        key, mark, begin, count = _distinct(key, mark)
        rank = np.arange(len(key)) - np.repeat(begin, count)
        late = (np.repeat(count, count) > 2 * HOT) & (rank > HOT)  # HOT + 1 classes stay to mark the part as hot
        to = ((key >> _U(32)) * _U(deals)) >> _U(32)
        out = []
        for hot, own in ((False, ~late), (True, late)):
            k, m, t = key[own], mark[own], to[own]
            cut = _cuts(t)
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                out.append(_piece((int(t[x]) + (salt if hot else 0)) % deals, hot, k[x:y] >> _U(DROP), m[x:y]))
        return _pieces(out)

    def by_class(key, mark, count):
        to = np.mod(mark, _class_deals(deals))
        order = np.lexsort((key, to))
        key, mark, count, to = key[order], mark[order], count[order], to[order]
        cut = _cuts(to)
        return _pieces([_piece(int(to[x]), False, key[x:y], mark[x:y], count[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)])

    def meet(batches):
        held = []
        for batch in batches:
            for _, hot, keys, marks, classes, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, mark = _unpacked(keys, marks, classes)
                if hot:
                    yield by_class(key, mark, np.full(len(key), 255, dtype=np.uint8))
                else:
                    held.append((key, mark))
        if not held:
            return
        key, mark = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        key, mark, _, count = _distinct(key, mark)
        count = np.repeat(np.where(count > HOT, 255, count).astype(np.uint8), count)
        several = count > 1
        if several.any():
            yield by_class(key[several], mark[several], count[several])

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(send, _PIECE)
    return sent.repartitionById(deals, F.col("deal")).mapInArrow(meet, _PIECE)


def _class_deals(deals: int) -> int:
    return max(8, deals // 2)


def prefixes(shared: DataFrame, own: DataFrame, deals: int) -> DataFrame:
    """(class, part, need) of the first parts of each class that may have a partner.

    need is null for parts of few classes; the hot parts of a class all come,
    with the number of them that belong to its first parts.
    """
    to = _class_deals(deals)

    def run(batches):
        held, marks, spares = [], [np.zeros(0, np.int64)], [np.zeros((0, SLOTS), np.int64)]
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            known = rows.filter(rows["class"].is_valid())
            marks.append(known["class"].to_numpy())
            spares.append(np.stack([known[c].fill_null(int(_NONE)).to_numpy() for c in _SPARES], axis=1))
            for keys, index, classes, counts in zip(*(rows.filter(rows["keys"].is_valid())[c].to_pylist() for c in ("keys", "marks", "classes", "counts")), strict=True):
                held.append((*_unpacked(keys, index, classes), blocks.spread(counts, np.uint8)))
        if not held:
            return
        key, mark, count = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        slot = (key & _U(SLOTS - 1)).astype(np.uint8)
        order = np.lexsort((key, count, slot, mark))
        key, mark, count, slot = key[order], mark[order], count[order], slot[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        key, mark, count, slot = key[new], mark[new], count[new], slot[new]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (mark[1:] != mark[:-1]) | (slot[1:] != slot[:-1])
        begin = np.flatnonzero(first)
        n = np.diff(np.append(begin, len(key)))
        cold = np.add.reduceat((count < 255).astype(np.int64), begin)
        names, at = np.unique(np.concatenate(marks), return_index=True)
        spare = np.concatenate(spares)[at][np.searchsorted(names, mark[begin]), slot[begin]]
        take = np.where(n >= np.maximum(spare, 1), np.minimum(n - spare + 1, n), 0)
        place = np.arange(len(key)) - np.repeat(begin, n)
        few = (place < np.repeat(np.minimum(take, cold), n)) & (count < 255)
        need = np.repeat(take - cold, n)
        many = (need > 0) & (count == 255)
        both = few | many
        yield pa.RecordBatch.from_arrays([pa.array(mark[both]), pa.array(key[both].view(np.int64)), pa.array(need[both], mask=few[both])], ["class", "part", "need"])

    none = [F.lit(None).cast("long").alias(c) for c in ("class", *_SPARES)]
    parts = shared.select("deal", "keys", "marks", "classes", "counts", *none)
    sizes = own.where(F.col("class").isNotNull()).select(F.pmod("class", F.lit(to)).cast("int").alias("deal"), *[F.lit(None).cast("binary").alias(c) for c in ("keys", "marks", "classes", "counts")], "class", *_SPARES)
    return parts.unionByName(sizes).repartitionById(to, F.col("deal")).mapInArrow(run, "class long, part long, need long")


def cards(docs: DataFrame, wanted: DataFrame, text_col: str, width: int, filter_bits: int = 1 << 23) -> DataFrame:
    """(class, n, sketch, shingles) of the wanted classes, once each.

    A bitmap of filter_bits bits of the wanted classes, of fixed size, keeps
    most other sets from leaving their scan; the join drops the rest.
    """
    slots = wanted.select(F.pmod(F.xxhash64("class"), F.lit(filter_bits)).alias("s")).groupBy(F.expr("cast(s div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b"))
    words = np.zeros(filter_bits // 64, dtype=np.int64)
    for r in slots.toLocalIterator():  # at most filter_bits / 64 rows
        words[r["w"]] = r["b"]
    words = words.view(np.uint64)
    hashed = _SparkHash(filter_bits)

    def run(batches):
        for batch in batches:
            seen: set[int] = set()
            for _, flat, bounds in _sets(batch, 0, width):
                marks = fingerprints(flat, bounds)
                slot = hashed(marks)
                ok = ((words[slot // 64] >> (slot % 64).astype(np.uint64)) & _U(1)).astype(bool) & (np.diff(bounds) > 0)
                out = []
                for i in np.flatnonzero(ok).tolist():
                    if int(marks[i]) not in seen:
                        seen.add(int(marks[i]))
                        own = flat[bounds[i] : bounds[i + 1]]
                        out.append((int(marks[i]), len(own), dense_sketch(own, sketch_bits(len(own))).tobytes(), own.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["class", "n", "sketch", "shingles"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "class long, n long, sketch binary, shingles binary").join(wanted, "class", "left_semi")
    return found.groupBy("class").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "shingles")])


class _SparkHash:
    """xxhash64 of a long as Spark has it (seed 42), modulo n."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        p1, p2, p3, p4, p5 = (_U(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
        k = x.view(np.uint64) * p2
        k = ((k << _U(31)) | (k >> _U(33))) * p1
        h = (_U(42) + p5 + _U(8)) ^ k
        h = ((h << _U(27)) | (h >> _U(37))) * p1 + p4
        h = (h ^ (h >> _U(33))) * p2
        h = (h ^ (h >> _U(29))) * p3
        h = h ^ (h >> _U(32))
        return np.mod(h.view(np.int64), self.n)


def _alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    same = len(x) - int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] != x).sum())
    return den * same >= num * (len(x) + len(y) - same)


def verify(pairs: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough: by the Hamming distance of their sketches first, then by their shingles."""

    def near(batches):
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            ok = np.zeros(len(a), dtype=bool)
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                words = min(len(p), len(q))
                ok[i] = int(np.bitwise_count(fold(p, words) ^ fold(q, words)).sum()) * (den + num) <= (na[i] + nb[i]) * (den - num)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "b"])

    def exact(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = pa.array([_alike(np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64), num, den) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 1)], ["a", "b"])

    def of(name, *columns):
        return known.select(F.col("class").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    sized = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    close = pairs.join(of("a", "n", "sketch"), "a").join(of("b", "n", "sketch"), "b").where(sized).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(near, "a long, b long")
    close, _ = blocks.stored(close, "close")
    return close.join(of("a", "shingles"), "a").join(of("b", "shingles"), "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(exact, "a long, b long")


def _stars(groups: DataFrame) -> DataFrame:
    """(a, b): the smallest class of each part with each other one."""
    least = groups.groupBy("part").agg(F.min("class").alias("a"))
    return groups.join(least, "part").where(F.col("class") != F.col("a")).select("a", F.col("class").alias("b")).distinct()


def packed_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(block, least, most, low, high, held) of rows (place, class, component, n, shingles).

    A block holds classes of one place and of sizes within a factor den / num,
    about ``BLOCK_BYTES`` of shingles or ``BLOCK_CLASSES`` classes at most; least and most are its sizes, low and
    high its components.
    """
    rows = rows.withColumn("step", F.floor(F.log("n") / math.log(den / num)))
    pieces = F.ceil(F.greatest(F.sum("n") * 8 / BLOCK_BYTES, F.count(F.lit(1)) / BLOCK_CLASSES))
    rows = rows.join(rows.groupBy("place", "step").agg(pieces.alias("pieces")), ["place", "step"])
    rows = rows.withColumn("block", F.xxhash64("place", "step", F.pmod(F.xxhash64("class"), F.col("pieces"))))
    held = F.collect_list(F.struct("class", "component", "shingles")).alias("held")
    return rows.groupBy("block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.max("component").alias("high"), held)


def joining_links(first: list[dict], second: list[dict], same: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Links between the classes of two blocks that join components: one for each two that are still apart."""
    sides = []
    for held in (first, second):
        n = np.array([len(r["shingles"]) // 8 for r in held])
        sides.append(([r["class"] for r in held], np.array([r["component"] for r in held]), n, np.frombuffer(b"".join(r["shingles"] for r in held), dtype=np.uint64), np.concatenate(([0], np.cumsum(n)))))
    (ca, pa_, na, sa, ba), (cb, pb, nb, sb, bb) = sides
    bits = sketch_bits(int(max(na.max(), nb.max())), 1 << 16)
    ka, kb = (np.stack([dense_sketch(s[b[i] : b[i + 1]], bits) for i in range(len(n))]) for n, s, b in ((na, sa, ba), (nb, sb, bb)))
    left, right, far = [], [], []
    for i in range(len(na)):
        ok = (pb != pa_[i]) & (nb * den >= na[i] * num) & (na[i] * den >= nb * num)
        if same:
            ok[: i + 1] = False
        at = np.flatnonzero(ok)
        if len(at):
            differ = np.bitwise_count(kb[at] ^ ka[i]).sum(axis=1, dtype=np.int64)
            close = differ * (den + num) <= (nb[at] + na[i]) * (den - num)
            left.append(np.full(int(close.sum()), i))
            right.append(at[close])
            far.append(differ[close])
    if not left:
        return []
    left, right, far = (np.concatenate(x) for x in (left, right, far))
    root: dict[int, int] = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for k in np.argsort(far, kind="stable").tolist():
        i, j = int(left[k]), int(right[k])
        x, y = find(int(pa_[i])), find(int(pb[j]))
        if x != y and _alike(sa[ba[i] : ba[i + 1]], sb[bb[j] : bb[j + 1]], num, den):
            root[x] = y
            out.append((ca[i], cb[j]))
    return out


def links_of_hot(groups: DataFrame, parts: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that join the components of hot parts whose classes are in several. groups: (part, class); parts: (node, component)."""
    placed = groups.join(parts.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = placed.groupBy("part").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("part", "low")
    apart, _ = blocks.stored(placed.join(mixed, "part"), "apart")
    rows = apart.groupBy("class").agg(F.min("low").alias("place"), F.first("component").alias("component"))
    packed, _ = blocks.stored(packed_blocks(rows.join(known.select("class", "n", "shingles"), "class"), num, den), "blocks")
    where = packed.select("block", F.explode("held.class").alias("class"))
    sites = apart.select("part", "class").join(where, "class").select("part", "block").distinct()
    spans = packed.select("block", "least", "most", "low", "high")
    met = sites.join(sites.withColumnRenamed("block", "other"), "part").where("block <= other").select("block", "other").distinct()
    met = met.join(spans, "block").join(spans.select(*[F.col(c).alias("other" if c == "block" else f"{c}_") for c in spans.columns]), "other")
    met = met.where((F.col("most") * den >= F.col("least_") * num) & (F.col("most_") * den >= F.col("least") * num) & ((F.col("low") != F.col("high")) | (F.col("low_") != F.col("high_")) | (F.col("low") != F.col("low_"))))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one at a time: a row is two blocks
                block, other, first, second = (batch.column(c)[k].as_py() for c in range(4))
                if out := joining_links(first, second, block == other, num, den):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    both = met.select("block", "other").join(packed.select("block", F.col("held").alias("first")), "block").join(packed.select(F.col("block").alias("other"), F.col("held").alias("second")), "other")
    return both.select("block", "other", "first", "second").mapInArrow(run, "a long, b long")


def _placed(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, class and component (a class; null without shingles) of every row of docs."""
    blocks.bound_batches(docs.sparkSession)
    own, _ = blocks.stored(digests(docs, id_col, text_col, width, num, den), "digests")
    deals = max(16, -(-(own.agg(F.sum("n_shingles")).first()[0] or 0) // DEAL))
    first, path = blocks.stored(prefixes(shared_parts(docs, text_col, width, num, den, deals), own, deals), "parts")
    cold = first.where("need is null").select("part", "class")
    hot = first.where("need is not null")
    place = F.row_number().over(W.partitionBy("class", F.col("part").bitwiseAND(SLOTS - 1)).orderBy("m", "part"))
    hot = hot.join(hot.groupBy("part").agg(F.count(F.lit(1)).alias("m")), "part").withColumn("place", place).where(F.col("place") <= F.col("need"))
    hot, hot_path = blocks.stored(hot.select("part", "class"), "hot")
    pairs = cold.withColumnRenamed("class", "a").join(cold.withColumnRenamed("class", "b"), "part").where("a < b").select("a", "b").distinct()
    tried, tried_path = blocks.stored(pairs.unionByName(_stars(hot)).distinct(), "pairs")
    wanted = tried.select(F.col("a").alias("class")).unionByName(tried.select(F.col("b").alias("class"))).distinct()  # a hot part's smallest class meets all others
    known, known_path = blocks.stored(cards(docs, wanted, text_col, width), "cards")
    links, _ = blocks.stored(verify(tried, known, num, den), "links")
    parts = components(links)
    more, _ = blocks.stored(links_of_hot(hot, parts, known, num, den), "links")
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    for done in (path, hot_path, tried_path, known_path):
        blocks.drop_path(docs.sparkSession, done)
    return own.join(parts.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, class and component_id of every row of docs."""
    placed = _placed(docs, id_col, text_col, width, num, den)
    least = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "component", "left").select("doc_id", "n_shingles", "class", F.coalesce("least", "doc_id").alias("component_id"))


def _with_class(docs: DataFrame, text_col: str, width: int, name: str) -> DataFrame:
    """docs with the class, null without shingles, under a new name."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            sizes, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, flat, bounds in _sets(batch, at, width):
                sizes.append(np.diff(bounds))
                marks.append(fingerprints(flat, bounds))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(marks), mask=np.concatenate(sizes) == 0)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs a component, all columns: that with the smallest id, null last; rows without shingles all stay.

    Where ids are there and differ, rows are chosen by id; rows without an id or
    with a repeated one by id and class, of equal ones the first by text. Other
    columns may have any names.
    """
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    kind, part, first_id, place = (mark + x for x in ("class", "component", "id", "place"))
    placed, _ = blocks.stored(_placed(docs, id_col, text_col, WIDTH, NUMERATOR, DENOMINATOR), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "class")).alias("first")
    best = placed.where(F.col("component").isNotNull()).groupBy("component").agg(first).select(F.col("component").alias(part), F.col("first.doc_id").alias(first_id), F.col("first.class").alias(kind))
    extra = placed.join(best, F.col("component") == F.col(part)).where((F.col("doc_id") != F.col(first_id)) | (F.col("class") != F.col(kind))).select(F.col("doc_id").alias(id_col))
    doubtful = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(id_col))
    if doubtful.isEmpty():
        return docs.join(extra.distinct(), id_col, "left_anti").select(*docs.columns)
    named = docs.where(F.col(id_col).isNotNull())
    plain = named.join(extra.unionByName(doubtful).distinct(), id_col, "left_anti").select(*docs.columns)
    rows = named.join(doubtful, id_col, "left_semi").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
    rows, _ = blocks.stored(_with_class(rows, text_col, WIDTH, kind), "doubtful")
    chosen = rows.join(best, kind).where(F.col(id_col).eqNullSafe(F.col(first_id)))
    chosen = chosen.withColumn(place, F.row_number().over(W.partitionBy(part).orderBy(text_col))).where(F.col(place) == 1)
    return plain.unionByName(rows.where(F.col(kind).isNull()).select(*docs.columns)).unionByName(chosen.select(*docs.columns))
