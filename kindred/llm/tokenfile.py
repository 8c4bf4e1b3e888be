"""Token files: ids bit-packed at the width of the vocabulary, readable in part.

A file is a table of segments, written by Spark's own writer to any store that Spark
reaches. Each segment is self-contained bytes:

    magic "KTF1", bits per id (u8), 3 zero bytes, ids per block (u32), documents (u64), ids (u64)
    document ids (i64 each; the smallest value stands for null)
    first id of each document within the segment (u64 each, one more than documents)
    byte offset of each block within the payload (u64 each, one more than blocks)
    payload: blocks of ids, ``bits`` bits each, least significant bit first

All integers are little-endian. A block begins on a byte, so any range of ids is
unpacked from the blocks it touches, with numpy and without a loop over ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from kindred.llm.common import map_rows, partitions, table
from kindred.llm.tokens import ROWS, crc32, encoder, with_end
from kindred.plans.storage import discard, fresh_path, materialise

MAGIC = b"KTF1"
BLOCK_IDS = 4096
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18
END_ID = 2
_HEAD = np.dtype([("magic", "S4"), ("bits", "u1"), ("zero", "S3"), ("block", "<u4"), ("docs", "<u8"), ("ids", "<u8")])
NULL_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits for each id, least significant first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}", copy=False).tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of ``pack``'s bytes, unsigned 32-bit."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = planes
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    if len(flat) and int(flat.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.uint64)]).astype("<u8")
    blocks = [pack(flat[i : i + block], bits) for i in range(0, len(flat), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.uint64)]).astype("<u8")
    head = np.zeros(1, _HEAD)
    head["magic"], head["bits"], head["block"], head["docs"], head["ids"] = MAGIC, bits, block, len(ids), len(flat)
    own = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    return b"".join([head.tobytes(), own.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Segment:
    """Reads a segment's bytes; only the blocks asked for are unpacked."""

    def __init__(self, data: bytes) -> None:
        head = np.frombuffer(data, _HEAD, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a token segment")
        self.bits, self.block, docs, self.n_ids = int(head["bits"]), int(head["block"]), int(head["docs"]), int(head["ids"])
        at = _HEAD.itemsize
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at := at + 8 * docs).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * (docs + 1)).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1) :]

    def range(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi (exclusive)."""
        if hi <= lo:
            return np.zeros(0, "<u4")
        first, last = lo // self.block, (hi - 1) // self.block
        parts = [unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[lo - first * self.block : hi - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.starts[i]), int(self.starts[i + 1]))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tokenizer: str | None = None, by_word: bool = True) -> DataFrame:
    """``(doc_id, tie, n, ids)`` for every row, without a shuffle: its ids and ``end_id`` as bytes, and the hash of its text."""

    def make():
        own = encoder(tokenizer, by_word)
        code = own.dtype if end_id >> 16 == 0 else np.dtype("<u4")

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, bounds = with_end(*own.encode(batch.column("text")), end_id)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds * code.itemsize), pa.py_buffer(flat.astype(code))])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(np.diff(bounds)), data.cast(pa.binary())], ["doc_id", "tie", "n", "ids"])

        return kernel

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"))
    return map_rows(rows, make, "doc_id long, tie long, n long, ids binary", rows=ROWS)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tokenizer: str | None = None, by_word: bool = True, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text, append ``end_id`` and write segments in ascending id order.

    Texts are encoded where they are read and never move; one shuffle deals their ids by
    range of document id, and each task streams segments of bounded size. Null texts
    count as empty (one id, the end); null ids come first; rows with equal ids are
    ordered by the hash of their text and are all kept, equal rows in any order, dealt
    to as many tasks as their number asks for; an empty table writes no segment.
    """
    spark = docs.sparkSession
    vocabulary = encoder(tokenizer, by_word).vocabulary
    bits = bits_for(max(vocabulary, end_id + 1))
    ids = materialise(encoded(docs, id_col, text_col, end_id, tokenizer, by_word), "ids", "zstd")
    rows = ids.withColumn("nth", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "nth"]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        own: list[int | None] = []
        ids: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            data = write_segment(own, ids, bits)
            row = {"part": part, "seq": seq, "first_id": own[0], "last_id": own[-1], "n_docs": len(own), "n_ids": held, "data": data}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for d, n, e in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids"), strict=True):
                data = e.as_buffer()
                own.append(d)
                ids.append(np.frombuffer(data, f"<u{data.size // n}"))
                held += n
                if held >= segment_ids:
                    yield segment()
                    own, ids, held, seq = [], [], 0, seq + 1
        if own:
            yield segment()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
    dealt.select("doc_id", "n", "ids").mapInArrow(run, "part int, seq long, first_id long, last_id long, n_docs long, n_ids long, data binary").write.option("compression", "zstd").parquet(path)
    discard(ids)


def read_documents(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """``(doc_id, ids)`` of the documents asked for, all rows of a repeated id.

    Segments tell their first and last id in columns of their own, whose statistics keep
    the reader from all but the few that may hold one; of those only the blocks with the
    documents' ids are unpacked.
    """
    wanted = sorted(set(doc_ids))
    may = F.lit(False)
    for d in wanted:
        may = may | ((F.col("last_id") >= d) & (F.coalesce("first_id", F.lit(NULL_ID)) <= d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                s = Segment(data.as_py())
                at = np.flatnonzero(np.isin(s.doc_ids, wanted))
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[at]), pa.array([s.document(int(i)).astype(np.int64) for i in at], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return spark.read.parquet(path).filter(may).select("data").mapInArrow(run, "doc_id long, ids array<long>")


def read_tokens(spark, path: str) -> DataFrame:
    """Per document: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``.

    Segments know their own lengths, so starts come from sums over segments: within a
    part, then over the parts, of which there are as many as the writer had tasks.
    """
    segments = spark.read.parquet(path)
    lengths = segments.select("part", "seq", "n_ids")
    parts = lengths.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    bases = lengths.withColumn("in_part", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("base") + F.col("in_part")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("data"), strict=True):
                s = Segment(data.as_py())
                n, flat = len(s.doc_ids), s.range(0, s.n_ids)
                crcs = [crc32(flat[s.starts[i] : s.starts[i + 1]]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int64)), pa.array(s.doc_ids, mask=s.doc_ids == NULL_ID), pa.array(s.starts[:-1]), pa.array(np.diff(s.starts)), pa.array(crcs, pa.int64())], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = segments.select("part", "seq", "data").mapInArrow(run, "part int, seq long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_file(spark, sf_dir: str) -> DataFrame:
    """All documents, written as token segments to the shared folder and read back from them."""
    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
