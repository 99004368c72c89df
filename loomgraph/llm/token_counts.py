"""Token counts without token ids: pieces a distinct pre-token, joined to pre-token frequencies.

The SentencePiece model never joins a piece across the start of a run of
blanks: no piece of its vocabulary holds a blank after another character
(``blank_pieces_lead`` checks that). So a text's tokens are those of its pre-tokens,
a run of blanks with the characters up to the next blank.

1. Documents become blocks of about ``BLOCK_BYTES`` of text, stored in the shared
   folder: the distinct pre-tokens of a block in the order of their hashes, and
   for each document the places of its pre-tokens among them with their frequencies;
2. each block sends its distinct pre-tokens, packed and dealt by hash. The task
   that gets a pre-token from all blocks asks the model once for its pieces, and
   sends the numbers back to each block in the order in which they came;
3. a block's frequencies are joined with the numbers of its pre-tokens and summed.

So a pre-token that is everywhere costs one entry a block, and no task sees more
than ``DEAL`` entries. The library has no function that only counts: the pieces of ``ASK``
pre-tokens at a time exist until their number is taken, and no text's ever.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a text without
blanks is one pre-token; repeated rows get the same answer; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import blocks
from loomgraph.llm.blocks import spread, squeeze

LIMIT = 4096
BLOCK_BYTES, DEAL, ASK = 4 << 20, 500_000, 20_000
_U = np.uint64
_MARK = "▁".encode()
_NOT_BLANK = np.ones(256, dtype=bool)
_NOT_BLANK[0x20] = False


def blank_pieces_lead(model) -> bool:
    return not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))


_models: dict = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if not blank_pieces_lead(model):
            raise ValueError("a piece of this vocabulary crosses blanks; its counts don't add up over pre-tokens")
        _models[path] = model
    return _models[path]


def piece_counts(path: str, tokens: list[bytes]) -> np.ndarray:
    """Number of pieces of each pre-token, a leading blank included; a lone blank is one."""
    model, out = _model(path), np.empty(len(tokens), dtype=np.uint32)
    for k in range(0, len(tokens), ASK):
        # the model puts a blank before a text, but none before an empty one
        out[k : k + ASK] = [1 if t == b" " else n for t, n in zip(tokens[k : k + ASK], map(len, model.encode([t[1:].decode("utf-8") for t in tokens[k : k + ASK]], num_threads=1)), strict=True)]
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray):
    """Texts as the model sees them (a blank before each, its blank mark as a blank), starts and ends of their pre-tokens, and the first of each text."""
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    if _MARK in raw:
        texts = [t.replace(_MARK, b" ") for t in texts]
    texts = [b" " + t if t else t for t in texts]
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begin = ~_NOT_BLANK[flat]
    begin[1:] &= _NOT_BLANK[flat[:-1]]
    begin[edges[:-1][np.diff(edges) > 0]] = True
    starts = np.flatnonzero(begin)
    return flat, starts, np.append(starts[1:], len(flat))[: len(starts)], np.searchsorted(starts, edges)


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes of spans one after another."""
    size = ends - starts
    return data[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(int(size.sum()))].tobytes()


_BLOCK = "ids array<{0}>, bytes binary, sizes binary, places binary, times binary, lengths binary, words binary"


def frequency_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks: ids, bytes and number of distinct pre-tokens of each document, their places and frequencies, and the block's distinct pre-tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        number, base = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets, _ = blocks.buffer_of(batch.column(1))
            for i, j in blocks.slices(offsets, block_bytes):
                flat, starts, ends, first = pre_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                _, at, token = np.unique(blocks.span_hashes(flat, starts, ends), return_index=True, return_inverse=True)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                own, times = np.unique(doc * max(len(at), 1) + token, return_counts=True)
                sizes = np.bincount(own // max(len(at), 1), minlength=j - i)
                length = ends[at] - starts[at]
                row = [squeeze(np.diff(offsets[i : j + 1])), squeeze(sizes.astype(np.uint32)), squeeze((own % max(len(at), 1)).astype(np.uint32)), squeeze(times.astype(np.uint32)), squeeze(length.astype(np.uint32)), zstandard.compress(_gathered(flat, starts[at], ends[at]), 1)]
                ids = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.array([len(at)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in row)], ["block", "n_words", "ids", *(c.split()[0] for c in _BLOCK.split(", ")[1:])])
                number += 1

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"block long, n_words long, {_BLOCK.format(kind)}")


def _words(lengths: bytes, words: bytes):
    """Bytes of pre-tokens, and their starts and ends."""
    data, size = np.frombuffer(zstandard.decompress(words), dtype=np.uint8), spread(lengths, np.uint32).astype(np.int64)
    ends = np.cumsum(size)
    return data, ends - size, ends


def piece_numbers(stored: DataFrame, path: str, deals: int) -> DataFrame:
    """(block, deal, numbers): pieces of the block's pre-tokens of a deal, in their order; asked is the number of pre-tokens that the deal's model was asked for."""

    def send(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one at a time: a row is a block
                block, lengths, words = (batch.column(c)[k].as_py() for c in range(3))
                data, starts, ends = _words(lengths, words)
                to = ((blocks.span_hashes(data, starts, ends) >> _U(32)) * _U(deals)) >> _U(32)
                cut = np.searchsorted(to, np.arange(deals + 1, dtype=np.uint64))  # hashes are sorted
                rows = [(d, block, squeeze((ends - starts)[cut[d] : cut[d + 1]].astype(np.uint32)), zstandard.compress(data[starts[cut[d]] : ends[cut[d + 1] - 1]].tobytes(), 3)) for d in np.flatnonzero(np.diff(cut)).tolist()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["deal", "block", "lengths", "words"])

    def count(batches):
        held, deal = [], None
        for batch in batches:
            for d, block, lengths, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                deal = d
                held.append((block, *_words(lengths, words)))
        if deal is None:
            return
        shift = np.cumsum([0, *(len(x[1]) for x in held)])
        data = np.concatenate([x[1] for x in held])
        starts, ends = (np.concatenate([x[c] + s for x, s in zip(held, shift[:-1], strict=True)]) for c in (2, 3))
        _, at, token = np.unique(blocks.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        whole = data.tobytes()
        pieces = piece_counts(path, [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])[token]
        cut = np.cumsum([0, *(len(x[2]) for x in held)]).tolist()
        for k, (block, *_) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([deal], pa.int32()), pa.array([squeeze(pieces[cut[k] : cut[k + 1]])], pa.binary()), pa.array([len(at)], pa.int64())], ["block", "deal", "numbers", "asked"])

    sent = stored.select("block", "lengths", "words").mapInArrow(send, "deal int, block long, lengths binary, words binary")
    return sent.repartitionById(deals, F.col("deal")).mapInArrow(count, "block long, deal int, numbers binary, asked long")


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    spark = docs.sparkSession
    blocks.bound_batches(spark)
    stored = blocks.bucketed(frequency_blocks(docs, id_col, text_col, block_bytes), "block", "pre-tokens")  # so that the join moves the numbers and not the blocks
    deals = max(8, -(-(stored.agg(F.sum("n_words")).first()[0] or 0) // DEAL))
    numbers, _ = blocks.stored(piece_numbers(stored, model_path, deals), "piece-numbers")
    back = numbers.groupBy("block").agg(F.collect_list(F.struct("deal", "numbers")).alias("numbers"))  # one entry a deal
    joined = stored.select("block", "ids", "bytes", "sizes", "places", "times").join(back.hint("merge"), "block", "left").drop("block")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n_bytes, sizes, places, times = (spread(batch.column(c)[k].as_py(), t) for c, t in ((1, np.int64), (2, np.uint32), (3, np.uint32), (4, np.uint32)))
                found = sorted((r["deal"], r["numbers"]) for r in batch.column(5)[k].as_py() or [])
                pieces = np.concatenate([spread(r[1], np.uint32) for r in found]).astype(np.int64) if found else np.zeros(0, dtype=np.int64)
                total = np.concatenate(([0], np.cumsum(pieces[places] * times)))
                last = np.cumsum(sizes.astype(np.int64))
                tokens = total[last] - total[last - sizes]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
