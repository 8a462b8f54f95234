"""Length-delimited binary records of token ids, with a separate offset index for shuffled reads.

A record is framed as

    length of the payload   unsigned 64-bit, little-endian
    masked checksum of the 8 length bytes   unsigned 32-bit
    payload
    masked checksum of the payload   unsigned 32-bit

and its payload is a serialized sequence: one flag byte (1: the key is null), the key as a signed
64-bit integer, one byte with the width of an id (2 or 4) and the ids, little-endian. Checksums are
CRC-32 masked by a rotation and a constant, so that a checksum of bytes that hold checksums stays
sound. The index has an entry of three unsigned 64-bit integers for each record: its offset in the
file, its length with framing, and the ids in the file before it. Any record can thus be read on its
own, in any order.

Keys ascend through the files: part 0 has the smallest. Rows of null key come first, rows of equal
key are ordered by a digest of their text, a null text is an empty text. Rows are sorted by range of (key, digest), so
a key of any number of rows is spread. An empty table gives no files and no rows. Texts of any length are one record each, encoded whole. Only
the key and the text are read: other columns may have any name. Each attempt of a task writes files of its own name, and the manifest names those of the attempt
that Spark kept, so a repeated or speculative task takes nothing away from another.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import fresh_path, parts_for, settle
from brindle.llm.tokens import encoder

ENTRY = "<QQQ"
HEAD = struct.Struct("<BqB")
#: Records a reading task takes at a time.
RECORDS_A_READ = 4096
#: Bytes a writing task holds before it passes them on.
FLUSH = 1 << 22


def masked(data: bytes) -> int:
    """CRC-32, rotated right by 15 bits, plus a constant."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one framed record; raises ValueError if a checksum doesn't hold."""
    length, (sum_length,) = record[:8], struct.unpack("<I", record[8:12])
    if masked(length) != sum_length:
        raise ValueError("the checksum of a record's length does not hold")
    (n,) = struct.unpack("<Q", length)
    payload = record[12 : 12 + n]
    if len(payload) != n or masked(payload) != struct.unpack("<I", record[12 + n : 16 + n])[0]:
        raise ValueError("the checksum of a record does not hold")
    return payload


def serialize(key: int | None, ids: bytes, width: int) -> bytes:
    """ids: little-endian unsigned 32-bit."""
    body = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids
    return HEAD.pack(key is None, key or 0, width) + body


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, key, width = HEAD.unpack_from(payload)
    return None if null else key, np.frombuffer(payload, f"<u{width}", offset=HEAD.size).astype("<u4")


#: Schemes of Hadoop's addresses by the names that Arrow has for the same stores. ``hdfs`` needs Hadoop's native library on the executors.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gcs": "gs"}


def arrow_address(address: str) -> str:
    """A Hadoop address as Arrow's file systems take it; a plain path is absolute and stays."""
    scheme, colon, rest = address.partition(":")
    if not colon or "/" in scheme:
        return address
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def store_of(address: str):
    """(file system, path) of an address. One that Arrow cannot open raises ValueError that says what can be."""
    from pyarrow import ArrowException, fs

    try:
        return fs.FileSystem.from_uri(arrow_address(address))
    except (ArrowException, OSError, ValueError) as e:
        raise ValueError(f"record files are written to local paths, s3a, gs, abfs and hdfs (with libhdfs) addresses, not to {address}: {e}") from e


def write_records(docs: DataFrame, out: str, tokenizer: str, word_ends: bool, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write record files under ``out``.

    ``out`` is a folder all executors can write (any address that pyarrow's file systems open).
    Returns the manifest: a row per file with part, records, tokens, bytes and the two paths.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(t).alias("digest"), t.alias("text"))

    store_of(out)  # an address that tasks could not open fails here

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, where = task.partitionId(), None
        enc = encoder(tokenizer, word_ends)
        end, width = np.asarray([end_id], "<u4").tobytes(), 2 if max(enc.vocabulary, end_id + 1) <= 1 << 16 else 4
        records = tokens = size = 0
        held: list[bytes] = []
        entries: list[bytes] = []
        waiting = 0
        for batch in batches:
            if where is None and batch.num_rows:
                store, where = store_of(out)
                store.create_dir(where, recursive=True)
                names = [f"part-{part:06d}-{task.taskAttemptId()}.{kind}" for kind in ("records", "index")]
                files = [store.open_output_stream(f"{where}/{x}") for x in names]
            for k, own in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(2).to_pylist()), strict=True):
                ids = own + end
                record = frame(serialize(k, ids, width))
                entries.append(struct.pack(ENTRY, size, len(record), tokens))
                held.append(record)
                records, tokens, size, waiting = records + 1, tokens + len(ids) // 4, size + len(record), waiting + len(record)
                if waiting > FLUSH:
                    files[0].write(b"".join(held))
                    files[1].write(b"".join(entries))
                    held, entries, waiting = [], [], 0
        if where is not None:
            files[0].write(b"".join(held))
            files[1].write(b"".join(entries))
            for f in files:
                f.close()
            root = out.rstrip("/")
            yield pa.RecordBatch.from_pydict({"part": [part], "records": [records], "tokens": [tokens], "bytes": [size], "path": [f"{root}/{names[0]}"], "index_path": [f"{root}/{names[1]}"]})

    ranged = rows.repartitionByRange(parts_for(docs), "key", "digest").sortWithinPartitions("key", "digest", "text")
    return settle(ranged.mapInArrow(write, "part long, records long, tokens long, bytes long, path string, index_path string"), "manifest")


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read the files back, whole and checked: key, start (ids of all records before), ids.

    Each task takes runs of records by the offset index, so a file of any size is read by many tasks.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    runs = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    runs = runs.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(RECORDS_A_READ).cast("long"))))
    runs = runs.select("path", "index_path", "before", "first", F.least(F.lit(RECORDS_A_READ), F.col("records") - F.col("first")).alias("n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                store, path = store_of(run["path"])
                _, index = store_of(run["index_path"])
                with store.open_input_file(index) as f:
                    f.seek(run["first"] * struct.calcsize(ENTRY))
                    entries = list(struct.iter_unpack(ENTRY, f.read(run["n"] * struct.calcsize(ENTRY))))
                with store.open_input_file(path) as f:
                    rows: list[tuple] = []
                    held = 0
                    for offset, length, before in entries:
                        f.seek(offset)
                        k, ids = deserialize(unframe(f.read(length)))
                        rows.append((k, run["before"] + before, ids.tobytes()))
                        held += length
                        if held > FLUSH:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return runs.repartition(n, "path", "first").mapInArrow(read, "key long, start long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, starts, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["key", "start", "ids"])


def op7_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_records(docs, fresh_path(spark, "records"), public_tokenizers.path("word_bpe_49k.json"), True, 1)
    # Spark's crc32 is the unsigned one of the ids as they stand
    return read_records(spark, manifest).select(F.col("key").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
