"""Token ids in binary files with a shared zstandard dictionary.

Layout: a folder of Parquet files whose rows are blocks. A block holds the
compressed documents of a range of ids back to back (``payload``, one
zstandard frame a document), an offset index (``index``: for each document
its id, a null flag, its number of ids and the end of its frame, as
little-endian 64-bit integers), the sha256 of the dictionary (``dict_hash``)
and the number of ids of its part before it. Part k holds smaller ids than
part k + 1, and blocks of a part follow each other, so that the files are in
ascending doc_id order; one document is read with its block's index alone. A
second folder holds the dictionary.

The dictionary is trained on a bounded sample (``SAMPLE_DOCS`` documents); it
changes sizes only. Ids are 32-bit little-endian integers before compression.

Defined cases: a null or empty text is the end id alone; null ids come first;
rows with equal ids stay in the order of their digests; an empty table gives
an empty result; without enough samples the dictionary is empty and its hash
is that of no bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import blocks
from loomgraph.llm.tokens import encoder

SAMPLE_DOCS = 256
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 4 << 20
LEVEL = 1


@dataclass
class TokenFiles:
    path: str
    dictionary_path: str
    parts: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_SCHEMA).parquet(self.path)

    def dictionary(self, spark: SparkSession) -> bytes:
        return bytes(spark.read.parquet(self.dictionary_path).first()["bytes"])


def _ids(texts: pa.Array, tokenizer: str, style: str, end_id: int):
    """ids of each text, the end id included."""
    data, offsets, _ = blocks.buffer_of(texts)
    enc, end = encoder(tokenizer, style), np.array([end_id], dtype="<u4")
    for i, j in blocks.slices(offsets):
        for ids in enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
            yield np.concatenate((ids, end)).astype("<u4")


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, style: str, end_id: int, sample: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from about sample documents, chosen by a hash of the id."""
    n = docs.count()
    share = min(1.0, sample / max(n, 1))
    rows = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).select(F.col(text_col).alias("text")).limit(2 * sample).collect()
    samples = [x.tobytes() for x in _ids(pa.array([r["text"] for r in rows], pa.string()), tokenizer, style, end_id)]
    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:  # too little variety to train on
        return b""


def write_token_files(docs: DataFrame, path: str, tokenizer: str, style: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block_bytes: int = BLOCK_BYTES) -> TokenFiles:
    """Encodes, compresses and writes all rows of docs; ids are integers."""
    blocks.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = train_dictionary(docs, "doc_id", "text", tokenizer, style, end_id)
    digest = hashlib.sha256(words).hexdigest()
    spark.createDataFrame([(digest, bytearray(words))], "dict_hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    cuts = [k / parts for k in range(1, parts)]
    found = docs.select(F.percentile_approx("doc_id", cuts, 100 * parts)).first()[0] if cuts else None
    bounds = np.array(found or [], dtype=np.int64)

    def encode(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=False)
        for batch in batches:
            key = batch.column(0)
            part = np.searchsorted(bounds, key.fill_null(0).to_numpy(zero_copy_only=False), side="left")
            part[~np.asarray(key.is_valid())] = 0
            sizes, frames = [], []
            for ids in _ids(batch.column(1), tokenizer, style, end_id):
                sizes.append(len(ids))
                frames.append(packer.compress(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), key, pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], ["part", "doc_id", "n_tokens", "frame"])

    def lay_out(batches):
        before, block, part = 0, 0, None
        held: list[tuple] = []

        def flush():
            nonlocal before, block
            index = np.zeros((len(held), 4), dtype="<i8")
            index[:, 0] = [0 if k is None else k for k, _, _ in held]
            index[:, 1] = [k is None for k, _, _ in held]
            index[:, 2] = [n for _, n, _ in held]
            index[:, 3] = np.cumsum([len(f) for _, _, f in held])
            total, known = int(index[:, 2].sum()), [k for k, _, _ in held if k is not None]
            row = [part, block, before, len(held), total, min(known, default=None), max(known, default=None), digest, index.tobytes(), b"".join(f for _, _, f in held)]
            before, block = before + total, block + 1
            held.clear()
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["part", "block", "before", "n_docs", "n_tokens", "first_id", "last_id", "dict_hash", "index", "payload"])

        size = 0
        for batch in batches:
            for p, k, n, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = p
                held.append((k, n, f))
                size += len(f)
                if size >= block_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    out = TokenFiles(f"{path}/blocks", f"{path}/dictionary", parts)
    rows = docs.mapInArrow(encode, "part int, doc_id long, n_tokens long, frame binary").repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", F.crc32("frame"))
    rows.mapInArrow(lay_out, _SCHEMA).write.parquet(out.path)
    return out


_SCHEMA = "part int, block int, before long, n_docs long, n_tokens long, first_id long, last_id long, dict_hash string, index binary, payload binary"


def frames(row_index: bytes, payload: bytes):
    """(doc_id or None, number of ids, frame) of each document of a block."""
    index = np.frombuffer(row_index, dtype="<i8").reshape(-1, 4)
    at = 0
    for k, null, n, end in index.tolist():
        yield (None if null else k), n, payload[at:end]
        at = end


def read_document(spark: SparkSession, files: TokenFiles, doc_id: int) -> list[np.ndarray]:
    """ids of the documents with this id: reads the blocks whose range holds it, and decompresses their frames only."""
    words = files.dictionary(spark)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    found = files.read(spark).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("index", "payload").collect()
    return [np.frombuffer(opener.decompress(f, max_output_size=4 * n), dtype="<u4") for r in found for k, n, f in frames(r["index"], r["payload"]) if k == doc_id]


def read_digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    words = files.dictionary(spark)
    digest = hashlib.sha256(words).hexdigest()
    table = files.read(spark)
    base, total = {}, 0  # one number a part
    for r in sorted(table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"]):
        base[r["part"]], total = total, total + r["n"]

    def run(batches):
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        for batch in batches:
            for part, before, known, index, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known != digest:
                    raise ValueError(f"block of part {part} was written with another dictionary")
                ids, starts, sizes, sums = [], [], [], []
                at = base[part] + before
                for k, n, f in frames(index, payload):
                    raw = opener.decompress(f, max_output_size=4 * n)
                    if len(raw) != 4 * n:
                        raise ValueError("a frame and its index differ")
                    ids.append(k)
                    starts.append(at)
                    sizes.append(n)
                    sums.append(zlib.crc32(raw))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("part", "before", "dict_hash", "index", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
