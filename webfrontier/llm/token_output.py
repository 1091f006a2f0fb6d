"""Token ids of documents, written as Simple-8b blocks and read back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webfrontier.llm.common import id_back, id_column, ship, texts, whole_text
from webfrontier.llm.simple8b import pack, unpack
from webfrontier.llm.word_tokens import chunk_encoder

#: Documents are added to a block until it has so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: One row of the file is one block. doc_ids, lengths (ids of each document) and offsets (first word of each
#: document) are what a reader needs to decode any document of the block alone; all numbers are little-endian.
BLOCK = (
    "block long, start long, n_ids long, first_id long, "
    "doc_ids binary, lengths binary, offsets binary, escapes binary, words binary"
)


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes the ids of every document, each with ``end_id`` behind, in ascending order of doc_id.

    Documents are range-partitioned by doc_id and sorted there, then encoded as they stream by. ``block`` numbers
    the blocks of a file from its first one on and ``start`` counts the ids before a block in its file; ``shard``
    names the file. A null text has only the end id, a null doc_id comes first, and repeated rows are all written.
    """
    ship(docs.sparkSession)
    ordered = (
        docs.select(id_column().alias("doc_id"), whole_text().alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    schema = to_arrow_schema(StructType.fromDDL(BLOCK))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        ids: list[int] = []
        kept: list[np.ndarray] = []
        held = start = block = 0
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in kept])
            words, offsets, escapes = pack(np.concatenate(kept), lengths)
            parts = (np.array(ids, "<i8"), lengths.astype("<u4"), offsets.astype("<u4"), escapes.astype("<u4"), words.astype("<u8"))
            row = [block, start, held, ids[0], *(x.tobytes() for x in parts)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for group, bodies in texts(batches):
            for doc_id, text in zip(group, bodies):
                found = np.concatenate([encoder.ids(text), end])
                if kept and held + len(found) > BLOCK_IDS:
                    yield flush()
                    start, block = start + held, block + 1
                    ids, kept, held = [], [], 0
                ids.append(doc_id)
                kept.append(found)
                held += len(found)
        if kept:
            yield flush()

    ordered.mapInArrow(encode, BLOCK).withColumn("shard", F.spark_partition_id()).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all files, ``start`` now counting all ids before them."""
    blocks = spark.read.parquet(path)
    # one row per file, so both the window and the broadcast are as small as the number of write tasks
    shards = blocks.groupBy("shard").agg(F.min("first_id").alias("_first"), F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    return blocks.join(F.broadcast(bases), "shard").withColumn("start", F.col("start") + F.col("_base")).drop("_base")


def decode_block(row: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """Id, start and token ids of each document of a block."""
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    values, first = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u4"))
    places = first[np.frombuffer(row["offsets"], "<u4")]
    starts = row["start"] + np.cumsum(lengths) - lengths
    for doc_id, place, length, start in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), places.tolist(), lengths.tolist(), starts.tolist()):
        yield doc_id, start, values[place : place + length]


def token_report(blocks: DataFrame) -> DataFrame:
    """Per document of the blocks: doc_id, start, n_tokens, ids_crc32 of the decoded ids as 32-bit integers."""
    ship(blocks.sparkSession)
    columns = ["start", "doc_ids", "lengths", "offsets", "escapes", "words"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = [(i, s, len(v), zlib.crc32(v.astype("<u4").tobytes())) for i, s, v in decode_block(row)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*found)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    rows = blocks.select(columns).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.select(id_back(), "start", "n_tokens", "ids_crc32")
