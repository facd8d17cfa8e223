"""Token-id files: documents' ids in blocks of an adaptive context-mixing range coder (see codec)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codec import decode_block, encode_block
from .common import in_order, rows, slabs
from .tokens import word_encoder

SCHEMA = "part int, block int, n_ids long, doc_ids array<bigint>, doc_lengths array<bigint>, payload binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
_READ = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 3 << 20) -> None:
    """Encode every text, append ``end_id``, and write the ids under ``path`` in ascending ``id_col`` order.

    A row of the files is one independently decodable block: whole documents of about ``block_ids`` ids, their
    doc ids and lengths, and the checksummed bytes. Files are in order of part, rows of block.
    Null texts count as empty and give the end id alone. Rows with a null id come first. Repeated ids stay,
    ordered by a hash of their texts. An empty table gives files without rows. Other columns are ignored. A document
    larger than ``block_ids`` has a block of its own."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        vocab = encoder.library.get_vocab_size()
        doc_ids: list = []
        ids: list[np.ndarray] = []
        lengths: list[int] = []
        held = block = 0

        def batch() -> pa.RecordBatch:
            all_ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            row = [part], [block], [len(all_ids)], [doc_ids], [lengths], [encode_block(all_ids, max(vocab, end_id + 1))]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _ARROW)], schema=_ARROW)

        for slab in slabs(rows(batches, "id", "text"), 1, 8_000_000):
            got, n = encoder.encode([t for _, t in slab], end=end_id)
            doc_ids += [i for i, _ in slab]
            ids.append(got)
            lengths += n.tolist()
            held += len(got)
            if held >= block_ids:
                yield batch()
                doc_ids, ids, lengths, held, block = [], [], [], 0, block + 1
        if doc_ids:
            yield batch()

    in_order(docs, id_col, text_col).mapInArrow(encode, SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (little-endian uint32) of each document.

    The files' rows know how many ids they hold, so starts come from sums over blocks, then over parts."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block, doc_ids, lengths, payload in rows(batches, "part", "block", "doc_ids", "doc_lengths", "payload"):
            raw = memoryview(decode_block(payload).astype("<u4").tobytes())
            ends = np.cumsum(lengths).tolist()
            pieces = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends, lengths)]
            columns = [part] * len(ends), [block] * len(ends), doc_ids, [e - n for e, n in zip(ends, lengths)], lengths, [bytes(p) if with_ids else None for p in pieces], [zlib.crc32(p) for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _READ)], schema=_READ)

    files = spark.read.schema(SCHEMA).parquet(path)
    blocks = files.select("part", "block", "n_ids")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    parts = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("part_start"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = blocks.withColumn("block_start", within).join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("first"))
    read = files.mapInArrow(decode, "part int, block int, doc_id long, before long, n_tokens long, ids binary, ids_crc32 long")
    out = read.join(starts, ["part", "block"]).withColumn("start", F.col("first") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
