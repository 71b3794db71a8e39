"""Token-ID / binary output: Arrow files of equal-length sequences and masks.

A file is an Arrow IPC file whose batches hold fixed-size lists: ``ids`` (``length`` ids), ``mask`` (``length``
booleans; false: padding). Its ids are one stream, padded only in the file's last sequence, so the id at place p of the
file is at ``p % length`` of sequence ``p // length``, and a memory-mapped file gives any sequence without a copy. Two
plain list columns say which documents begin in a sequence (``doc_ids``) and where (``doc_starts``).

Documents are dealt to files by ranges of ``doc_id`` and sorted in each, so the files in order hold the documents in order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import byte_bpe
from .common import new_path, only, utf8, written

MANIFEST = "part int, file string, n_tokens long, n_docs long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def open_fs(uri: str):
    """A pyarrow file system and the path in it; ``file:``, ``hdfs:``, ``s3:`` and the like."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Appends documents' ids to one file. Holds ``rows`` sequences at most, besides the ids it is given."""

    def __init__(self, uri: str, dtype: np.dtype, length: int, rows: int = 64):
        self.length, self.rows, self.dtype = length, rows, dtype
        ids = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32()))])
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.sink = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.held, self.begins = 0, []
        self.n_tokens, self.n_docs = 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.begins.append((doc_id, self.held))
        self.ids.append(ids)
        self.held += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1
        if self.held >= self.rows * self.length:
            self._flush(self.held // self.length)

    def _flush(self, rows: int) -> None:
        flat = np.concatenate(self.ids) if self.ids else np.zeros(0, self.dtype)
        size = rows * self.length
        mask = np.ones(size, bool)
        mask[len(flat) :] = False
        now = np.zeros(size, self.dtype)
        now[: len(flat)] = flat[:size]
        here = [x for x in self.begins if x[1] < size]
        row = np.array([p // self.length for _, p in here], np.int64)
        offsets = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(now), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length), pa.ListArray.from_arrays(offsets, pa.array([d for d, _ in here], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array([p % self.length for _, p in here], pa.int32()))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        rest = flat[size:]
        self.ids, self.held = [rest], len(rest)
        self.begins = [(d, p - size) for d, p in self.begins if p >= size]

    def close(self) -> None:
        if self.held:
            self._flush(-(-self.held // self.length))
        self.writer.close()
        self.sink.close()


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file: id and token ids. Sequences are views of the mapped file where it is local."""
    fs, path = open_fs(uri)
    source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
    with source, pa.ipc.open_file(source) as reader:
        doc, parts = None, []
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            ids = batch.column(0).flatten().to_numpy()
            mask = batch.column(1).flatten()
            ids = ids[: mask.true_count]  # padding ends the stream
            length = batch.column(0).type.list_size
            starts = batch.column(3)
            rows = np.repeat(np.arange(len(batch)), np.diff(starts.offsets.to_numpy()))
            at = rows * length + starts.flatten().to_numpy()
            docs = batch.column(2).flatten().to_pylist()
            edges = [*at.tolist(), len(ids)]
            parts.append(ids[: edges[0]])
            for d, a, b in zip(docs, edges[:-1], edges[1:], strict=True):
                if doc is not None:
                    yield doc[0], np.concatenate(parts)
                doc, parts = (d,), [ids[a:b]]
        if doc is not None:
            yield doc[0], np.concatenate(parts)


def write_sequences(docs: DataFrame, tokenizer: str, out_dir: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """Writes the token ids of ``docs(doc_id, text)`` and returns the manifest: a row for each file.

    A null or empty text is just ``end_id``; null ids come first; rows of one id come in order of text; repeated rows stay.
    An empty table gives no file. Other columns are not read. A task that is run again writes a new file; the manifest
    names only the files of tasks that ended well.
    """

    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bpe, writer = byte_bpe(tokenizer), None
        uri = f"{out_dir}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for lo, ids, counts in bpe.column(batch.column(1)):
                at = 0
                for i, n in enumerate(counts.tolist()):
                    writer = writer or SequenceWriter(uri, bpe.dtype, length)
                    writer.add(ids_of[lo + i], np.append(ids[at : at + n], bpe.dtype.type(end_id)))
                    at += n
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": uri, "n_tokens": writer.n_tokens, "n_docs": writer.n_docs}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

    d = only(docs, "doc_id", "text").select("doc_id", F.coalesce(utf8("text"), F.lit(b"")).alias("text"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(d.mapInArrow(encode, MANIFEST), "manifest")


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, read back from the files: where its ids start in the whole stream, how many, their CRC-32.

    The driver holds one manifest row per file, no more.
    """
    files, base = [], 0
    for r in manifest.orderBy("part").collect():
        files.append((r.file, base))
        base += r.n_tokens
    if not files:
        return spark.createDataFrame([], DOCUMENTS)

    def read(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["base"], []
                for doc, ids in read_file(row["file"]):
                    out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(out) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    dealt = spark.createDataFrame(spark.sparkContext.parallelize(files, len(files)), "file string, base long")
    return dealt.mapInArrow(read, DOCUMENTS)


def tokens_on_disk(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """Writes the files into the shared folder and reads every document back from them."""
    spark = docs.sparkSession
    return read_documents(spark, write_sequences(docs, tokenizer, new_path(spark, "sequences"), length, end_id))
