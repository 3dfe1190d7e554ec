"""Token ids in Arrow files of equal-length sequences.

``write`` orders documents by id over range partitions.  Each partition becomes
one Arrow file whose record batches hold ``sequence_length`` ids and a mask per
row (fixed-size lists), packed without gaps; only the last row of a file is
filled up, with mask false.  All batches but the last have ``BATCH_ROWS`` rows,
so row k is row k % BATCH_ROWS of batch k // BATCH_ROWS, read from a memory map
without a copy.  A second file beside it lists each document's first id and
number of ids.  Files get their name when they are whole; a task that runs
again writes the same rows under the same name.

Null texts are empty: they hold the end id alone.  Null ids come first; rows of
one id are ordered by text.  An empty table gives no files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteval.llm.common import slices, text_of
from siteval.llm.tokens import bpe
from siteval.operators.ranking import shuffle_width

SEQUENCE_LENGTH = 2_048
BATCH_ROWS = 256
FILE_FIELDS = "path string, docs_path string, part long, n_docs long, n_tokens long"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _source(path: str):
    """A memory map where files are local, else ranged reads."""
    fs, at = _open(path)
    return pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)


def sequence_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Packer:
    """Cuts a stream of ids into rows of equal length."""

    def __init__(self, writer, dtype, length: int):
        self.writer, self.dtype, self.length = writer, dtype, length
        self.held: list[np.ndarray] = []
        self.n = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        full = self.length * BATCH_ROWS
        if self.n >= full:
            flat = np.concatenate(self.held)
            for at in range(0, len(flat) - full + 1, full):
                self._batch(flat[at:at + full], full)
            self.held = [flat[len(flat) - len(flat) % full:]]
            self.n = len(self.held[0])

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(columns, schema=sequence_schema(self.dtype, self.length)))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._batch(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.writer.close()


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          sequence_length: int = SEQUENCE_LENGTH, files: int | None = None) -> list[dict]:
    """Write the files and return one record per file, in order of ids.

    Only these records (their number is the number of files) reach the driver;
    ``start`` in them is the number of ids in all files before.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    docs = docs.repartitionByRange(files or shuffle_width(docs.sparkSession), "_id").sortWithinPartitions("_id", "_text")

    def save(batches):
        enc, part = bpe(tokenizer), TaskContext.get().partitionId()
        parts = (s for b in batches for s in slices(b, "_text"))
        first = next(parts, None)
        if first is None:
            return
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        names = [f"{base}/part-{part:06d}{kind}.arrow" for kind in ("", ".docs")]
        temporary = [f"{n}.{TaskContext.get().taskAttemptId()}" for n in names]
        schemas = [sequence_schema(enc.dtype, sequence_length),
                   pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])]
        sinks = [fs.open_output_stream(t) for t in temporary]
        seqs, spans = (pa.ipc.new_file(s, schema) for s, schema in zip(sinks, schemas))
        packer, n_docs = _Packer(seqs, enc.dtype, sequence_length), 0
        end = np.array([end_id], dtype=enc.dtype)

        for b in chain([first], parts):
            starts, sizes = [], []
            for raw in enc.encode_texts(b.column("_text").to_pylist()):
                ids = np.concatenate([np.frombuffer(raw, enc.dtype), end])
                starts.append(packer.total)
                sizes.append(len(ids))
                packer.add(ids)
            n_docs += b.num_rows
            spans.write_batch(pa.record_batch(
                [b.column("_id"), pa.array(starts, pa.int64()),
                 pa.array(sizes, pa.int64())], schema=schemas[1]))
        packer.close()
        spans.close()
        for s, t, n in zip(sinks, temporary, names):
            s.close()
            fs.move(t, n)
        paths = [f"{folder}/{n.rsplit('/', 1)[1]}" for n in names]
        yield pa.RecordBatch.from_pydict({"path": [paths[0]], "docs_path": [paths[1]], "part": [part], "n_docs": [n_docs],
                                          "n_tokens": [packer.total]})

    found = sorted((r.asDict() for r in docs.mapInArrow(save, FILE_FIELDS).collect()), key=lambda r: r["part"])
    start = 0
    for r in found:
        r["start"], start = start, start + r["n_tokens"]
    return found


class TokenFile:
    """Random access to the sequences and ids of one file."""

    def __init__(self, path: str):
        self.source = _source(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def batch(self, i: int) -> pa.RecordBatch:
        if i != self._at:
            self._at, self._batch = i, self.reader.get_batch(i)
        return self._batch

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of row k; the ids are a view of the file's bytes."""
        b, at = self.batch(k // BATCH_ROWS), k % BATCH_ROWS * self.length
        ids = b.column("ids").values[at:at + self.length].to_numpy(zero_copy_only=True)
        return ids, b.column("mask").values[at:at + self.length].to_numpy(zero_copy_only=False)

    def spans(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids [start, start + n)."""
        full = BATCH_ROWS * self.length
        while n > 0:
            ids = self.batch(start // full).column("ids").values
            take = ids[start % full:min(start % full + n, len(ids))]
            yield take.to_numpy(zero_copy_only=True)
            start, n = start + len(take), n - len(take)

    def close(self) -> None:
        self._batch = None
        self.source.close()


def read_documents(spark: SparkSession, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of each document, from the files."""
    fields = "path string, docs_path string, start long"
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    names = spark.createDataFrame([(f["path"], f["docs_path"], f["start"]) for f in files], fields)
    names = names.repartition(min(len(files), 4 * spark.sparkContext.defaultParallelism), "path")

    def load(batches):
        for b in batches:
            for path, docs_path, base in zip(*(b[c].to_pylist() for c in ("path", "docs_path", "start"))):
                ids, source = TokenFile(path), _source(docs_path)
                index = pa.ipc.open_file(source)
                for i in range(index.num_record_batches):
                    rows = index.get_batch(i)
                    crcs = []
                    for start, n in zip(rows["start"].to_pylist(), rows["n_tokens"].to_pylist()):
                        crc = 0
                        for view in ids.spans(start, n):
                            crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    yield pa.record_batch([rows["doc_id"], pc.add(rows["start"], base), rows["n_tokens"],
                                           pa.array(crcs, pa.int64())],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])
                ids.close()
                source.close()

    return names.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")
