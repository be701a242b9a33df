"""Token ids in bit-packed binary files (operator 8).

Method: fixed-width bit packing. Each id takes the minimum bits of the vocabulary;
a table of block offsets lets a reader unpack any block alone with numpy.

File layout (little-endian): magic ``RWTOKEN1``; u32 bits an id; u32 ids a block;
u64 documents; u64 ids; then i64 document ids, u8 validity of each (0: null id),
u64 first id of each document and one past the last, u64 byte offset of each block
in the payload and one past the last; then the payload, each block padded to bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.llm.encoding import PieceEncoder
from roadweave.llm.shared import shared_path, stored

MAGIC = b"RWTOKEN1"
HEAD = struct.Struct("<8sIIQQ")
#: Ids in a block, ids after which a file ends, bytes of text in a range partition.
BLOCK_IDS, FILE_IDS, PARTITION_BYTES = 8192, 4_000_000, 24 << 20


def bits_for(vocabulary: int) -> int:
    """Least bits that hold every id below ``vocabulary``."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a bit string, lowest bit first, padded with zeros to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = np.arange(bits, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> places) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    """The ``count`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little")
    return (flat.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def file_bytes(doc_ids: list[int | None], documents: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    """One file of these documents, in the order given."""
    ids = np.concatenate(documents) if documents else np.zeros(0, "<u4")
    starts = np.concatenate([[0], np.cumsum([len(x) for x in documents])]).astype("<u8")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in blocks])]).astype("<u8")
    keys = np.array([x or 0 for x in doc_ids], dtype="<i8")
    valid = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    head = HEAD.pack(MAGIC, bits, block, len(documents), len(ids))
    return b"".join([head, keys.tobytes(), valid.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Reader with random access: ``read(a, b)`` unpacks only the blocks it needs."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, self.block, self.n_docs, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.valid = np.frombuffer(data, np.uint8, self.n_docs, at)
        at += self.n_docs
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last - 1`` of the file."""
        if last <= first:
            return np.zeros(0, "<u4")
        a, b = first // self.block, -(-last // self.block)
        parts = [
            unpack(self.payload[self.offsets[k] : self.offsets[k + 1]], self.bits, min(self.block, self.n_ids - k * self.block))
            for k in range(a, b)
        ]
        return np.concatenate(parts)[first - a * self.block : last - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encode every whole text, append ``end_id``, write files in ascending doc_id order.

    Returns the manifest: file, partition, seq, n_docs, n_ids, start (ids before the
    file). Null texts are empty (the end id alone); null doc_ids come first; repeated
    doc_ids lie side by side, ordered by a hash of the text, then the text; an empty table gives no file. A task that runs
    twice writes the same file under the same name, by a rename of its finished copy.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-int(size) // PARTITION_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        store, base = pafs.FileSystem.from_uri(folder)
        context, coder = TaskContext.get(), PieceEncoder.of(tokenizer)
        bits, end = bits_for(max(coder.vocabulary, end_id + 1)), np.array([end_id], "<u4")
        keys: list[int | None] = []
        coded: list[np.ndarray] = []
        held, seq, rows = 0, 0, []

        def flush() -> None:
            nonlocal keys, coded, held, seq
            name = f"part-{context.partitionId():06d}-{seq:04d}.rwtok"
            draft = f"{base}/.{name}.{context.taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                out.write(file_bytes(keys, coded, bits))
            try:
                store.move(draft, f"{base}/{name}")
            except OSError:  # another attempt was first, on a store that does not overwrite
                store.delete_file(draft)
            rows.append((name, context.partitionId(), seq, len(keys), held))
            keys, coded, held, seq = [], [], 0, seq + 1

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                keys.append(key)
                coded.append(np.concatenate([ids, end]))
                held += len(ids) + 1
                if held >= FILE_IDS:
                    flush()
        if keys:
            flush()
        if rows:
            yield pa.RecordBatch.from_pydict({n: list(v) for n, v in zip(("file", "partition", "seq", "n_docs", "n_ids"), zip(*rows))})

    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))  # the hash splits rows of one doc_id without sampling texts
    dealt = slim.repartitionByRange(min(parts, 1 << 16), *order).sortWithinPartitions(*order, "text")
    manifest = stored(dealt.mapInArrow(write, "file string, partition long, seq long, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("partition", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # one row a file


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """What the files hold, one row a document: doc_id, start, n_tokens, ids_crc32, bits, file."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_py()
                held = TokenFile(data)
                crc = [zlib.crc32(held.document(d).astype("<u4").tobytes()) for d in range(held.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[k].as_py().rpartition("/")[2]] * held.n_docs, pa.string()),
                        pa.array(held.doc_ids, pa.int64(), mask=held.valid == 0),
                        pa.array(held.starts[:-1], pa.int64()),
                        pa.array(np.diff(held.starts), pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array([held.bits] * held.n_docs, pa.int32()),
                    ],
                    names=["file", "doc_id", "at", "n_tokens", "ids_crc32", "bits"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rwtok").load(folder).select("path", "content")
    rows = files.mapInArrow(digest, "file string, doc_id long, at long, n_tokens long, ids_crc32 long, bits int")
    starts = manifest.select(F.col("file").alias("of"), F.col("start").alias("before"))
    return rows.join(starts, F.col("file") == F.col("of")).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "bits", "file"
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files (to ``folder``, else a fresh shared one) and read them back."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-files")
    return read_token_files(spark, folder, write_token_files(docs, tokenizer, end_id, folder))
