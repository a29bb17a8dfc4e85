"""Binary token files: ids of whole documents, each compressed on its own with one shared zstandard dictionary.

A file is a row of blocks, and a block is a header (see HEADER), one index row for each document (see INDEX) and the compressed id arrays. Documents are in ascending order
of doc_id (nulls first; among equal ids as df gives them), over blocks, files and parts, which are numbered in that order too. A block holds about BLOCK_BYTES of text (a
document is never cut), a file BLOCKS of them at most, so neither memory nor a file grows with the table. The header names the SHA-256 of the dictionary, which lies
beside the files, and the block's size, so one document can be read with the headers, its index row and the dictionary alone. Spark's own writers and
readers move the bytes, so any store that Spark reaches will do; the text writer adds a newline after each block, which readers skip.

Null text counts as empty text: its ids are the end id alone. Rows with equal or null doc_id are all kept; equal rows are dealt over several parts like any others. Texts
are encoded whole. An empty table gives no blocks. Columns besides the two named ones can have any name. df must give the same rows in the same order when it is read
again, as files and written tables do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm import common, tokens

MAGIC = b"RMTOKEN1"
HEADER = np.dtype([("magic", "S8"), ("part", "<u4"), ("block", "<u4"), ("n_docs", "<u8"), ("n_tokens", "<u8"), ("data_bytes", "<u8"), ("dictionary", "S64")])
#: offset: of the compressed ids, from the end of the index; has_id is 0 where doc_id is null.
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<u4"), ("n_tokens", "<u4"), ("offset", "<u8"), ("size", "<u8"), ("raw_crc32", "<u8")])
#: Text bytes for a block, about, blocks in a file, and text bytes in a part (which is one task's work and one file or more).
BLOCK_BYTES, BLOCKS, PART_BYTES = 2_000_000, 16, 16_000_000
#: Parts whose totals are summed up in one row.
PARTS_AT_ONCE = 1024
#: The dictionary is trained on this many documents (those of least hash of doc_id) and is at most so large.
SAMPLE_DOCS, DICTIONARY_BYTES = 512, 64_000
#: Characters of a document that the training takes at most (encoding takes whole texts): what comes to the driver is bounded whatever the texts.
SAMPLE_CHARS = 100_000
LEVEL = 1


def _serialised(ids: np.ndarray, bytes_per_id: int) -> bytes:
    return ids.astype(f"<u{bytes_per_id}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str | None = None, sample: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from the id arrays of the beginnings of at most `sample` documents; empty if they are too few to train on."""
    import zstandard

    def encode(batches):
        enc = tokens.encoder(tokenizer)
        for batch, texts in common.slices(batches, most=tokens.SLICE_BYTES):
            ids, offsets = enc.encode(texts)
            yield pa.record_batch({"ids": [_serialised(ids[a:b], 2 if ids.max(initial=0) < 65536 else 4) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]})

    # Hashes of ids alone are sorted; texts of the chosen documents only leave the scan. Of equal ids the texts' hashes decide, so the sample is repeatable.
    hashed = docs.select("text", F.xxhash64("doc_id").alias("h"))
    last = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(last if last is not None else 0)).orderBy("h", F.xxhash64("text")).limit(sample).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    samples = [bytes(r.ids) for r in chosen.mapInArrow(encode, "ids binary").collect()]  # at most `sample` rows
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT) if dictionary else None
    if d:
        d.precompute_compress(level=LEVEL)  # once, not for each document
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write(df: DataFrame, path: str, tokenizer: str | None = None, end_id: int = tokens.END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text of df and write files and dictionary below path."""
    spark = df.sparkSession
    docs = common.as_text(df, id_col, text_col)
    dictionary = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(dictionary).hexdigest().encode()
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, -(-text_bytes // PART_BYTES))

    def encode(batches):
        enc, zstd = tokens.encoder(tokenizer), _compressor(dictionary)
        part, block, text, rows, blobs, offset = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            index = np.array(rows, INDEX)
            header = np.array([(MAGIC, part, block, len(rows), index["n_tokens"].sum(), offset, digest)], HEADER)
            return pa.record_batch({"value": pa.array([b"".join([header.tobytes(), index.tobytes(), *blobs])], pa.binary())})

        for batch, texts in common.slices(batches, most=tokens.SLICE_BYTES):
            ids, offsets = enc.encode(texts)
            sizes = np.asarray(pc.binary_length(texts)).tolist()
            wide = max(end_id, ids.max(initial=0)) > 65535
            for doc_id, a, b, size in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], sizes, strict=True):
                if rows and text + size > BLOCK_BYTES:
                    yield close()
                    block, text, rows, blobs, offset = block + 1, 0, [], [], 0
                own = np.append(ids[a:b], np.uint32(end_id))
                width = 4 if wide and own.max() > 65535 else 2
                blob = zstd.compress(_serialised(own, width))
                blobs.append(blob)
                rows.append((doc_id or 0, doc_id is not None, len(own), offset, len(blob), common.crc32(own) << 8 | width))
                offset, text = offset + len(blob), text + size
        if rows:
            yield close()

    keyed = docs.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    ordered = keyed.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(encode, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", BLOCKS).text(f"{path}/files")


def dictionary_of(spark, path: str) -> bytes:
    return bytes(spark.read.schema("dictionary binary").parquet(f"{path}/dictionary").first().dictionary)


def blocks(content: bytes):
    """(header, where its index begins) of each block of a file."""
    at = 0
    while at < len(content):
        header = np.frombuffer(content, HEADER, 1, at)[0]
        if header["magic"] != MAGIC:
            raise ValueError("not a token file")
        yield header, at + HEADER.itemsize
        at += HEADER.itemsize + int(header["n_docs"]) * INDEX.itemsize + int(header["data_bytes"]) + 1  # and the newline


def decode_block(content: bytes, header: np.void, at: int, dictionary: bytes, wanted: set[int] | None = None):
    """(index row, ids) of each document of a block, or of those wanted only: their bytes alone are decompressed."""
    zstd = _decompressor(dictionary)
    if header["dictionary"] != hashlib.sha256(dictionary).hexdigest().encode():
        raise ValueError("another dictionary")
    index = np.frombuffer(content, INDEX, int(header["n_docs"]), at)
    data = at + index.nbytes
    for row in index:
        if wanted is None or int(row["doc_id"]) in wanted:
            width = int(row["raw_crc32"]) & 255
            a = data + int(row["offset"])
            ids = np.frombuffer(zstd.decompress(content[a : a + int(row["size"])], max_output_size=int(row["n_tokens"]) * width), f"<u{width}").astype(np.uint32)
            if common.crc32(ids) != int(row["raw_crc32"]) >> 8:
                raise ValueError(f"damaged ids of document {row['doc_id']}")
            yield row, ids


def decode_file(content: bytes, dictionary: bytes, wanted: set[int] | None = None):
    """(index row, ids) of each document of a file, or of those wanted only."""
    for header, at in blocks(content):
        yield from decode_block(content, header, at, dictionary, wanted)


def read(spark, path: str) -> DataFrame:
    """part, block, position in it, doc_id, ids of every document."""
    dictionary = dictionary_of(spark, path)

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                content = content.as_py()
                for header, at in blocks(content):
                    found = list(decode_block(content, header, at, dictionary))
                    for a in range(0, len(found), 500):
                        part = found[a : a + 500]
                        yield pa.record_batch({"part": pa.array([int(header["part"])] * len(part), pa.int32()), "block": pa.array([int(header["block"])] * len(part), pa.int32()), "position": pa.array(range(a, a + len(part)), pa.int64()), "doc_id": pa.array([int(r["doc_id"]) if r["has_id"] else None for r, _ in part], pa.int64()), "ids": pa.array([x.astype(np.int32) for _, x in part], pa.list_(pa.int32()))})

    return _files(spark, path).select("content").mapInArrow(decode, "part int, block int, position long, doc_id long, ids array<int>")


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/files").where("length > 0")


def digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: their ids are decompressed and summed up where they are read."""
    dictionary = dictionary_of(spark, path)

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                content = content.as_py()
                for header, at in blocks(content):
                    found = [(int(r["doc_id"]) if r["has_id"] else None, len(ids), common.crc32(ids)) for r, ids in decode_block(content, header, at, dictionary)]
                    ids, n, crc = zip(*found, strict=True)
                    before = np.concatenate([[0], np.cumsum(n)[:-1]])
                    yield pa.record_batch({"part": pa.array([int(header["part"])] * len(n), pa.int32()), "block": pa.array([int(header["block"])] * len(n), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "before": pa.array(before, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    rows = common.materialise(_files(spark, path).select("content").mapInArrow(decode, "part int, block int, doc_id long, before long, n_tokens long, ids_crc32 long"), "digests")

    def before(totals: DataFrame, name: str, order: str, *within: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(order)
        return totals.withColumn(name, F.sum("total").over(w) - F.col("total"))

    # Totals of blocks, of parts and of PARTS_AT_ONCE parts: no task sums up more than one level's share.
    some = (F.col("part") / PARTS_AT_ONCE).cast("int").alias("some")
    of_blocks = common.materialise(rows.groupBy("part", "block").agg(F.sum("n_tokens").alias("total")), "totals")
    of_parts = of_blocks.groupBy(some, "part").agg(F.sum("total").alias("total"))
    of_some = of_parts.groupBy("some").agg(F.sum("total").alias("total"))
    parts = before(of_parts, "in_some", "part", "some").join(before(of_some, "base", "some").select("some", "base"), "some").select("part", (F.col("base") + F.col("in_some")).alias("base"))
    starts = common.materialise(before(of_blocks, "in_part", "block", "part").join(parts, "part").select("part", "block", (F.col("base") + F.col("in_part")).alias("base")), "starts")
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
