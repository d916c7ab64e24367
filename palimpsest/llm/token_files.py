"""Token-ID files: each document's ids compressed on their own with a shared zstandard dictionary.

Layout of a store: `dictionary/` (one row: dict_hash, content) and `blocks/`, whose rows hold some megabytes of
consecutive documents in ascending doc_id order: the frames one after the other in `blob`, and arrays with each document's doc_id,
number of ids, place of its first id in the shard and frame offsets. A reader that wants one document prunes blocks by the statistics of
`first_doc` and `last_doc`, and decompresses one frame. Every block names the hash of the dictionary its frames need.

The dictionary is trained on the id arrays of at most SAMPLE_DOCS documents of at most SAMPLE_CHARS characters
(those with the smallest hash of doc_id; only ids and hashes are compared, and the chosen texts alone reach the driver): it changes sizes only, never ids. A sample too
small to train on is the dictionary's raw content itself; without any text it is empty. Ids take two bytes, or four where the vocabulary needs them. A null or empty text
holds the end id alone. A null doc_id sorts first; rows with one doc_id are ordered by a hash of their text. Repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, steps
from .tokens import Encoder, vocabulary, worker_encoder

#: Bounds of the dictionary and its sample; bytes of frames in a block.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, BLOCK_BYTES, LEVEL, END_ID = 1000, 20_000, 65_536, 4 << 20, 3, 0

BLOCKS = "shard int, block int, first_doc long, last_doc long, n_ids long, dict_hash string, id_bytes int, doc_ids array<long>, starts array<long>, counts array<long>, offsets array<long>, blob binary"


def _serialised(ids: np.ndarray, id_bytes: int) -> bytes:
    return ids.astype(f"<u{id_bytes}").tobytes()


def _id_bytes(tokenizer) -> int:
    return 2 if max(tokenizer.get_vocab().values(), default=0) < 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary for id arrays; the sample's arrays themselves where they are too few to train on."""
    import zstandard

    texts = documents(docs).where(F.length("text").between(1, SAMPLE_CHARS)).withColumn("t", F.xxhash64("text"))
    # SAMPLE_DOCS narrow rows, joined back to their texts.
    chosen = texts.select("doc_id", "t").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(SAMPLE_DOCS).withColumnsRenamed({"doc_id": "id_", "t": "t_"})
    rows = texts.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_"))).dropDuplicates(["doc_id", "t"]).orderBy(F.xxhash64("doc_id"), "doc_id", "t").select("text").collect()
    encoder = Encoder(vocabulary(tokenizer))
    ids, offs = encoder.encode([r.text for r in rows])
    id_bytes = _id_bytes(encoder.tokenizer)  # it reads the whole vocabulary
    parts = [_serialised(ids[a:b], id_bytes) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    raw = b"".join(parts)[:DICTIONARY_BYTES]
    if len(rows) < 50:
        return raw
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return raw


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of all texts to the store at `path`, one shard for each range of doc_ids."""
    spark = docs.sparkSession
    content = train_dictionary(docs, tokenizer)
    name = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(name, bytearray(content))], "dict_hash string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = worker_encoder(tokenizer, 2_000_000)
        id_bytes = _id_bytes(encoder.tokenizer)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content) if content else None, write_content_size=True, write_checksum=True)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        names, starts, counts, frames = [], [], [], []

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            known = [x for x in names if x is not None]
            row = [shard, block, min(known, default=None), max(known, default=None), sum(counts), name, id_bytes, list(names), list(starts), list(counts), offsets, b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 4, pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split(" ")[0] for c in BLOCKS.split(", ")])
            for x in (names, starts, counts, frames):
                x.clear()
            return out

        held = 0
        for batch in steps(batches):
            ids, offs = encoder.encode(batch.column("text").to_pylist())
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                frame = pack.compress(_serialised(np.append(ids[a:b], np.uint32(end_id)), id_bytes))
                names.append(doc_id)
                starts.append(start)
                counts.append(b - a + 1)
                frames.append(frame)
                start += b - a + 1
                held += len(frame) + 32
                if held >= BLOCK_BYTES:
                    yield flush()
                    block, held = block + 1, 0
        if names:
            yield flush()

    dealt = documents(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of a store, decompressed; start counts the ids of all documents before it."""
    return _read(spark, path, "doc_id long, shard int, at long, n_tokens long, ids array<long>", lambda ids: ids.tolist()).withColumnRenamed("at", "start").drop("shard")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """read_store with the CRC-32 of the ids as little-endian unsigned 32-bit integers in their place."""
    return _read(spark, path, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark: SparkSession, path: str, schema: str, of_ids) -> DataFrame:
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One dictionary of DICTIONARY_BYTES at most.
    dictionaries = {r.dict_hash: bytes(r.content) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    kind = pa.int64() if "crc32" in schema else pa.list_(pa.int64())
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        readers: dict = {}
        for batch in batches:
            for row in range(batch.num_rows):
                shard, name, id_bytes, doc_ids, starts, counts, offsets = (batch.column(c)[row].as_py() for c in ("shard", "dict_hash", "id_bytes", "doc_ids", "starts", "counts", "offsets"))
                if name not in readers:
                    content = dictionaries[name]
                    readers[name] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
                blob = memoryview(batch.column("blob")[row].as_buffer())
                values = []
                for a, b, n in zip(offsets[:-1], offsets[1:], counts, strict=True):
                    ids = np.frombuffer(readers[name].decompress(blob[a:b]), f"<u{id_bytes}")
                    if len(ids) != n:
                        raise ValueError("a frame holds another number of ids than its index says")
                    values.append(of_ids(ids))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([shard] * len(doc_ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, kind)], columns)

    # A row for each shard file: their number is the number of write tasks, whatever the input.
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = totals.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("before"))
    return stored.select("shard", "dict_hash", "id_bytes", "doc_ids", "starts", "counts", "offsets", "blob").mapInArrow(documents_of, schema).join(F.broadcast(before), "shard").withColumn("at", F.col("at") + F.col("before")).drop("before")


def token_checksums(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write a store of all documents to the shared folder and read it back: (doc_id, start, n_tokens, ids_crc32)."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer)
    return read_checksums(docs.sparkSession, path).select("doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32")
