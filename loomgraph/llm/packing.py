"""Best-two-fit packing of token sequences.

A sequence is filled greedily with the longest pieces that fit. Then its
shortest piece is taken out if two unpacked pieces fill the gap it leaves more
tightly than it did. Pieces are dealt by a hash into groups of about
``GROUP_TOKENS`` tokens, and groups are packed side by side: a group wastes
less than one sequence more than one packing of all would, one part in
``GROUP_TOKENS / capacity``.

Defined cases: a null or empty text is the end id alone; a document longer
than the capacity is cut into pieces of the capacity and a rest; repeated rows
are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import blocks
from loomgraph.llm.token_files import _ids

CAPACITY = 4096
GROUP_TOKENS = 8_000_000


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces of a sequence follow each other without gaps."""
    order = np.argsort(-lengths, kind="stable")
    waiting: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)  # the first of equals is taken last in, first out
    count = np.zeros(capacity + 1, dtype=np.int64)
    present = 0
    for n, own in waiting.items():
        count[n] = len(own)
        present |= 1 << n

    def take(n: int) -> None:
        nonlocal present
        count[n] -= 1
        if not count[n]:
            present &= ~(1 << n)

    def put(n: int) -> None:
        nonlocal present
        count[n] += 1
        present |= 1 << n

    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    number = 0
    while present:
        gap, own = capacity, []
        while gap:
            n = (present & ((1 << (gap + 1)) - 1)).bit_length() - 1
            if n <= 0:
                break
            take(n)
            own.append(n)
            gap -= n
        if gap and present and len(own) > 1:
            short = own[-1]
            room = gap + short
            sizes = np.flatnonzero(count[: room + 1])
            if len(sizes):
                mate = np.searchsorted(sizes, room - sizes, side="right") - 1
                alone = (mate >= 0) & (sizes[np.maximum(mate, 0)] == sizes) & (count[sizes] < 2)
                mate = mate - alone
                sums = np.where(mate >= 0, sizes + sizes[np.maximum(mate, 0)], -1)
                best = int(sums.argmax())
                if sums[best] > short:
                    put(short)
                    own.pop()
                    for n in (int(sizes[best]), int(sizes[mate[best]])):
                        take(n)
                        own.append(n)
        at = 0
        for n in own:
            i = waiting[n].pop()
            sequence[i], offset[i] = number, at
            at += n
        number += 1
    return sequence, offset


def cut(docs: DataFrame, tokenizer: str, style: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of all rows; a scan without a shuffle."""
    blocks.bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for row, ids in enumerate(_ids(batch.column(1), tokenizer, style, end_id)):
                rows += [(row, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
            of, piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, style: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The pieces of all rows with sequence_id and offset."""
    pieces, _ = blocks.stored(cut(docs, tokenizer, style, end_id, capacity, id_col, text_col), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, int(total // group_tokens))
    group = F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("int")

    def run(frames):
        held = list(frames)  # one group: group_tokens tokens, or a group_tokens-th of the pieces
        rows = pd.concat(held) if held else None
        if rows is None or rows.empty:
            return
        rows = rows.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        for g, own in rows.groupby("group", sort=True):
            number, offset = pack_lengths(own["length"].to_numpy(), capacity)
            yield own.drop(columns="group").assign(sequence_id=(int(g) << 40) + number, offset=offset)

    schema = pieces.schema.simpleString()[7:-1].replace(":", " ")
    return pieces.withColumn("group", group).repartitionById(groups, F.col("group")).mapInPandas(run, f"{schema}, sequence_id long, offset long")
