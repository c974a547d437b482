"""Token ids of documents as files of entropy-coded blocks.

``write`` tokenises all documents in ascending id order into a scratch table of plain ids, makes the shared
frequency table from the counts of all ids, and encodes the blocks.  Each task writes one file of
blocks; a block holds whole documents, at least ``BLOCK_IDS`` ids but for the last of a file, together
with the ids and lengths of its documents.  The files are Parquet tables with one block per row (see
``rans`` for its layout), so any file system Spark can write to will do, and a task that is lost
leaves nothing half written.

``read`` decodes blocks independently of each other.  What the driver sees is the frequency table (bounded
by the vocabulary) and one number of ids per file.

Null texts are empty; every document ends with the id ``end``.  Documents without id come first, rows
with equal ids follow each other in text order.  An empty table gives no blocks and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import rans
from ledgerloom.llm.common import map_batches, slices_of, texts_of
from ledgerloom.llm.tokens import WordTokens
from ledgerloom.session import scratch_path

END_ID = 1
BLOCK_IDS = 1 << 18
#: Bytes of texts whose words are numbered together.
SLICE_BYTES = 4_000_000
BLOCKS = ("file bigint, block bigint, start_in_file bigint, n_ids bigint, doc_ids array<bigint>, "
          "doc_lengths array<bigint>, payload binary")
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int) -> Iterator[tuple[int | None, bytes]]:
    tokens, last = WordTokens.shared(tokenizer), np.array([end], "<u4").tobytes()
    for batch in batches:
        for part in slices_of(batch, SLICE_BYTES):
            ids = tokens.encode(texts_of(part.column("text")))
            yield from zip(part.column("doc_id").to_pylist(), (i + last for i in ids), strict=True)


def _tokenised(documents: DataFrame, path: str, tokenizer: str, end: int, files: int, block_ids: int) -> DataFrame:
    """Blocks of whole documents in ascending id order with their plain ids, as a table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, start, number = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        parts: list[bytes] = []
        size = 0
        for key, ids in _encoded(batches, tokenizer, end):
            keys.append(key)
            parts.append(ids)
            size += len(ids) // 4
            if size >= block_ids:
                yield _block(file, number, start, keys, parts)
                number, start, size, keys, parts = number + 1, start + size, 0, [], []
        if parts:
            yield _block(file, number, start, keys, parts)

    ordered = documents.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.parquet(path)


def _block(file: int, number: int, start: int, keys: list, parts: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(parts), "<u4")
    narrow = ids.astype("<u2") if ids.max() < 1 << 16 else ids
    values = (file, number, start, len(ids), keys, [len(p) // 4 for p in parts], narrow.tobytes())
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=_NAMES)


def _ids(n: int, payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4").astype(np.uint32)


def id_counts(blocks: DataFrame) -> DataFrame:
    """Occurrences of every id in all blocks; counted inside each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for n, payload in zip(batch.column("n_ids").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                own = np.bincount(_ids(n, payload))
                counts = np.pad(counts, (0, max(0, len(own) - len(counts))))
                counts[:len(own)] += own
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found])], names=["id", "n"])
    return blocks.select("n_ids", "payload").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(documents: DataFrame, path: str, tokenizer: str, end: int = END_ID, files: int | None = None,
          block_ids: int = BLOCK_IDS) -> None:
    """Write ``path/table`` (the frequency table) and ``path/blocks``."""
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = _tokenised(source, scratch_path(spark, "token-ids"), tokenizer, end, n, block_ids)
    counted = id_counts(plain).collect()  # at most the vocabulary
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.int64)
    for row in counted:
        counts[row["id"]] = row["n"]
    table = rans.Frequencies.from_counts(counts)
    spark.createDataFrame([(bytearray(table.shares),)], "shares binary").coalesce(1).write.parquet(f"{path}/table")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = [rans.encode(_ids(k, p), table) for k, p in
                 zip(batch.column("n_ids").to_pylist(), batch.column("payload").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(coded, pa.binary())], names=_NAMES)

    map_batches(plain, run, BLOCKS, rows=1).write.option("compression", "none").parquet(f"{path}/blocks")


def table_of(spark: SparkSession, path: str) -> rans.Frequencies:
    return rans.Frequencies(bytes(spark.read.parquet(f"{path}/table").first()["shares"]))


def _with_start(blocks: DataFrame) -> DataFrame:
    """``start``: ids in all files and blocks before; one row per file is summed up in order."""
    totals = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("file", F.coalesce(before, F.lit(0)).alias("file_start"))
    return blocks.join(F.broadcast(starts), "file").withColumn(
        "start", F.col("file_start") + F.col("start_in_file"))  # one pair of numbers per file


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files: id, ids before it, number of ids, crc32 of them, and if asked the ids."""
    table = table_of(spark, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, starts, lengths, crcs, kept = [], [], [], [], []
        for row in batch.to_pylist():
            raw, at = rans.decode(row["payload"], table).astype("<u4"), 0
            for key, length in zip(row["doc_ids"], row["doc_lengths"], strict=True):
                own = raw[at:at + length]
                keys.append(key)
                starts.append(row["start"] + at)
                lengths.append(length)
                crcs.append(zlib.crc32(own.tobytes()))
                if with_ids:
                    kept.append(own)
                at += length
        columns = [pa.array(c, pa.int64()) for c in (keys, starts, lengths, crcs)]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            columns, names = [*columns, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    blocks = _with_start(spark.read.parquet(f"{path}/blocks"))
    schema = ROWS + (", ids array<bigint>" if with_ids else "")
    return map_batches(blocks.select("start", "doc_ids", "doc_lengths", "payload"), run, schema, rows=1)
