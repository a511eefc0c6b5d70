"""Token ids in Arrow files of fixed-size-list batches.

All documents' ids, each with its end token, lie end to end in ascending doc_id
order, cut into sequences of equal length. A file holds batches of `rows` sequences:
a fixed-size list of ids and one of mask bytes (0 in the padding after a file's last
id, else 1). Only a file's last sequence may have a mask of its own, so masks are kept
in a dictionary of such lists, by their number. As all lists have one size, sequence i
is found by arithmetic, and a memory-mapped file gives ids and mask without a copy. A second small file lists the
documents of the first: doc_id, place of the first id, number of ids.

A file is written under a name of its task attempt and then renamed, so a task that
is run again leaves the same files. Ids take two bytes where the vocabulary's largest
id allows, else four.

Defined results: a null text is empty and has its end token only; null doc_ids come
first; rows that tie in doc_id are ordered by a hash of their text, then by the text.
An empty table gives no files and an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from planecraft.llm.encoding import encoder
from planecraft.llm.jobs import partitions, prepare, scratch, stored

WRITTEN = "part long, path string, n_tokens long, n_docs long"
DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass(frozen=True)
class Format:
    """Ids of a sequence, sequences of a batch, bytes of an id (2 or 4; 0: by the vocabulary)."""

    length: int = 2048
    rows: int = 64
    id_bytes: int = 0

    def schema(self) -> pa.Schema:
        kind = pa.uint16() if self.id_bytes == 2 else pa.uint32()
        return pa.schema([pa.field("ids", pa.list_(kind, self.length)), pa.field("mask", pa.dictionary(pa.int32(), pa.list_(pa.uint8(), self.length)))])

    def holding(self, largest: int) -> Format:
        """This format with ids wide enough for the largest one."""
        needed = 2 if largest < 1 << 16 else 4
        if self.id_bytes and self.id_bytes < needed:
            raise ValueError(f"ids up to {largest} don't fit into {self.id_bytes} bytes")
        return replace(self, id_bytes=self.id_bytes or needed)


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or a local path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file:" + uri.removeprefix("file:"))


class SequenceWriter:
    """Takes ids bit by bit, and writes full batches."""

    def __init__(self, sink, form: Format):
        self.form, self.writer = form, pa.ipc.new_file(sink, form.schema(), options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.dtype = np.uint16 if form.id_bytes == 2 else np.uint32
        self.held, self.size, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.size += len(ids)
        self.total += len(ids)
        batch = self.form.rows * self.form.length
        if self.size >= batch:
            ids = np.concatenate(self.held)
            for a in range(0, self.size - batch + 1, batch):
                self.write(ids[a : a + batch], batch)
            rest = ids[self.size - self.size % batch :]
            self.held, self.size = [rest.copy()], len(rest)

    def write(self, ids: np.ndarray, valid: int) -> None:
        n, rest = self.form.length, valid % self.form.length
        masks = np.arange(n)[None, :] < np.array([n, rest] if rest else [n])[:, None]
        number = np.zeros(len(ids) // n, np.int32)
        number[-1] = 1 if rest else 0
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x in (ids, masks.ravel().view(np.uint8))]
        mask = pa.DictionaryArray.from_arrays(pa.array(number), lists[1])
        self.writer.write_batch(pa.record_batch([lists[0], mask], schema=self.form.schema()))

    def close(self) -> None:
        if self.size:
            ids = np.concatenate(self.held)
            self.write(np.concatenate((ids, np.zeros(-len(ids) % self.form.length, self.dtype))), len(ids))
        self.writer.close()


class SequenceFile:
    """Random access to a file's sequences and to runs of ids; local files are memory-mapped, and `sequence` gives views of them."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.source = pa.memory_map(path) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def n_tokens(self) -> int:
        """Ids in the file, by the masks: only the last sequence has padding."""
        last = self.reader.num_record_batches - 1
        if last < 0:
            return 0
        rows = self.reader.get_batch(last).num_rows
        return (last * self.rows + rows - 1) * self.length + int(self.mask(last, rows - 1).sum())

    def mask(self, b: int, row: int) -> np.ndarray:
        column = self.reader.get_batch(b).column("mask")
        masks = column.dictionary.flatten().to_numpy(zero_copy_only=True).view(bool)
        at = column.indices[row].as_py() * self.length
        return masks[at : at + self.length]

    def batch_ids(self, b: int) -> np.ndarray:
        if self.held[0] != b:
            self.held = (b, self.reader.get_batch(b).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self.held[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i, as views."""
        b, row = divmod(i, self.rows)
        return self.batch_ids(b)[row * self.length : (row + 1) * self.length], self.mask(b, row)

    def ids(self, start: int, n: int) -> np.ndarray:
        batch, found = self.rows * self.length, []
        while n:
            b, a = divmod(start, batch)
            found.append(self.batch_ids(b)[a : a + n])
            n -= len(found[-1])
            start += len(found[-1])
        return np.concatenate(found) if found else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.held = (-1, np.zeros(0))
        self.source.close()


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, kind: str = "byte", form: Format = Format()) -> DataFrame:
    """Encode all documents and write them to the folder; returns (part, path, n_tokens, n_docs) of the files."""
    spark = docs.sparkSession
    prepare(spark)
    form = form.holding(max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        part, encode = TaskContext.get().partitionId(), encoder(path, kind)
        name, own = f"{root}/part-{part:06d}", f"{root}/.{uuid.uuid4().hex}"
        n_docs, writer = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink, listed = system.open_output_stream(own + ".arrow"), system.open_output_stream(own + ".docs.arrow")
                writer, index = SequenceWriter(sink, form), pa.ipc.new_file(listed, DOCUMENTS)
            starts, counts = [], []
            for ids in encode(batch.column("text")):
                starts.append(writer.total)
                counts.append(len(ids) + 1)
                writer.add(np.append(ids, np.uint32(end_id)))
            index.write_batch(pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=DOCUMENTS))
            n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            listed.close()
            system.move(own + ".arrow", name + ".arrow")
            system.move(own + ".docs.arrow", name + ".docs.arrow")
            where = f"{folder.rstrip('/')}/part-{part:06d}"
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [where], "n_tokens": [writer.total], "n_docs": [n_docs]})

    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs), "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return stored(rows.mapInArrow(run, WRITTEN), "token-files")


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Each document of the files: doc_id, place of its first id in the whole stream, number of ids, and their crc32."""
    prepare(spark)
    n_files = max(1, files.count())
    # one task for a row of each file; `partitions` bounds their number
    placed = files.select("path", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                ids, listed = SequenceFile(path + ".arrow"), pa.ipc.open_file(opened(path)[0].open_input_file(opened(path)[1] + ".docs.arrow"))
                valid = ids.n_tokens()
                for b in range(listed.num_record_batches):
                    found = listed.get_batch(b)
                    starts, counts = found.column("start").to_numpy(), found.column("n_tokens").to_numpy()
                    if len(starts) and starts[-1] + counts[-1] > valid:
                        raise ValueError(f"{path}: documents beyond the file's mask")
                    crcs = [zlib.crc32(ids.ids(a, n).astype("<u4").tobytes()) for a, n in zip(starts.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_pydict({"doc_id": found.column("doc_id"), "start": starts + before, "n_tokens": counts, "ids_crc32": pa.array(crcs, pa.int64())})
                ids.close()

    return placed.repartition(min(n_files, 10_000), "path").mapInArrow(run, DIGESTS)


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write all documents to a new folder of the shared storage, and read them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch(spark, "tokens"), path, end_id))
