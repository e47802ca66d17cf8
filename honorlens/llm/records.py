"""Length-delimited binary records of token ids, with a separate offset index.

A shard file is a run of records, one a sequence:

    uint64 length | uint32 masked CRC of the length | payload | uint32 masked CRC of the payload

all little-endian; the payload is the ids as ``uint16`` where the vocabulary allows
it, else ``uint32``. The CRC is CRC-32 (zlib), masked by a rotation of 15 bits and a
constant, so that a checksum over data that holds checksums stays meaningful. The index
is a Parquet table (one row a sequence: key, file, byte offset, size, ids before it in
its file), so that any reader finds any sequence with one ranged read, in any order.

Files are written by the tasks that own a key range. A task that runs again writes a
new file, and the index names only the files of the tasks that were committed. Files go
through pyarrow's file systems, so the folder may lie on any store that these open
(a local or mounted path, HDFS, S3, GCS).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import shared_folder

INDEX_SCHEMA = "doc_id long, file_no int, file string, position long, size long, ids_before long, n_tokens long"
READ_SCHEMA = "doc_id long, file_no int, ids_before long, n_tokens long, ids_crc32 long"
HEAD, TAIL = 12, 4
#: Bytes that one ranged read asks for at most, unless a single record is longer.
READ_BYTES = 8 << 20


def masked_crc(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes | memoryview) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked_crc(length).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little")))


def unframed(data: memoryview, at: int = 0) -> memoryview:
    """The payload of the record that begins at ``at``; ValueError if a checksum doesn't hold."""
    length = bytes(data[at : at + 8])
    n = int.from_bytes(length, "little")
    if masked_crc(length) != int.from_bytes(data[at + 8 : at + HEAD], "little"):
        raise ValueError(f"wrong checksum of the length at byte {at}")
    payload = data[at + HEAD : at + HEAD + n]
    if len(payload) != n or masked_crc(payload) != int.from_bytes(data[at + HEAD + n : at + HEAD + n + TAIL], "little"):
        raise ValueError(f"wrong checksum of the payload at byte {at}")
    return payload


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1) -> str:
    """Writes the ids of every document and ``end_id`` to shard files below ``folder``; returns the index's path.

    Shards hold ranges of doc_id in ascending order (null first; equal ids in the order
    of their texts). Null and empty texts become a record with the end id alone; equal
    rows a record each; other columns aren't read. No rows give an empty index.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .text_units import blocks, encoder, utf8

        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.tokenizer.get_vocab_size(True), end_id + 1) <= 1 << 16 else "<u4"
        no, out, position, before = TaskContext.get().partitionId(), None, 0, 0
        files, top = _file_system(folder)
        name = f"shard-{no:06d}-{uuid.uuid4().hex}-{kind[1:]}.rec"
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for lo, hi in blocks(offsets):
                ids, at = enc.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                raw = memoryview(np.insert(ids, at[1:], end_id).astype(kind)).cast("B")
                at = at + np.arange(len(at))
                width = int(kind[-1])
                records = [framed(raw[width * a : width * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                if out is None:
                    files.create_dir(top, recursive=True)
                    out = files.open_output_stream(f"{top}/{name}")
                out.write(b"".join(records))
                n = np.diff(at)
                size = width * n + HEAD + TAIL
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": doc_ids.slice(lo, hi - lo),
                        "file_no": pa.array(np.full(hi - lo, no, dtype=np.int32)),
                        "file": pa.array([f"{folder}/{name}"] * (hi - lo)),
                        "position": pa.array(position + np.cumsum(size) - size),
                        "size": pa.array(size),
                        "ids_before": pa.array(before + np.cumsum(n) - n),
                        "n_tokens": pa.array(n),
                    }
                )
                position, before = position + int(size.sum()), before + int(n.sum())
        if out is not None:
            out.close()

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = f"{folder}/index"
    dealt.mapInArrow(write, INDEX_SCHEMA).write.parquet(index)
    return index


def read_records(spark: SparkSession, index: str, with_ids: bool = False) -> DataFrame:
    """The sequences that the index names, read from the shard files with their checksums verified.

    Gives doc_id, file_no, ids_before (ids in the file before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers) and, if asked for, the ids.
    Any subset or order of index rows works; neighbours in a file are read together.
    """
    return read_indexed(spark.read.schema(INDEX_SCHEMA).parquet(index), with_ids)


def read_indexed(rows: DataFrame, with_ids: bool = False) -> DataFrame:
    """read_records for given rows of the index (sampled, filtered or shuffled)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, source = None, None
        for batch in batches:
            names, position, size = batch.column("file").to_pylist(), batch.column("position").to_numpy(), batch.column("size").to_numpy()
            n_tokens, crc, ids = [], [], []
            lo, n = 0, len(names)
            while lo < n:
                hi = lo + 1
                while hi < n and names[hi] == names[lo] and position[hi] == position[hi - 1] + size[hi - 1] and position[hi] + size[hi] - position[lo] <= READ_BYTES:
                    hi += 1
                if names[lo] != open_name:
                    files, path = _file_system(names[lo])
                    open_name, source = names[lo], files.open_input_file(path)
                kind = "<" + open_name.rsplit("-", 1)[1].removesuffix(".rec")
                data = memoryview(source.read_at(int(position[hi - 1] + size[hi - 1] - position[lo]), int(position[lo])))
                for i in range(lo, hi):
                    wide = np.frombuffer(unframed(data, int(position[i] - position[lo])), dtype=kind).astype("<u4")
                    n_tokens.append(len(wide))
                    crc.append(zlib.crc32(wide))
                    if with_ids:
                        ids.append(wide.astype(np.int32))
                lo = hi
            out = {"doc_id": batch.column("doc_id"), "file_no": batch.column("file_no"), "ids_before": batch.column("ids_before"), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(read, READ_SCHEMA + (", ids array<int>" if with_ids else ""))


def global_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """``records`` with ``start``: the ids of all sequences before it, over all files in order."""
    files = index.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))  # one row a file
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return records.join(files, "file_no").withColumn("start", F.col("_base") + F.col("ids_before")).drop("_base")


def encode_to_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the records of all documents and reads them back: one row a document with its global start."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    index = write_records(docs, tokenizer, folder or shared_folder(spark, "records"), end_id)
    return global_starts(read_records(spark, index), spark.read.schema(INDEX_SCHEMA).parquet(index))
