"""Token-ID output: Arrow stream files whose batches are fixed-size lists, so equal-length sequences and masks are read without a copy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findloom.llm.common import saved, scratch, table
from findloom.llm.tokens import chunks, encoder

#: Ids in a sequence, and sequences in a batch.
LENGTH, BATCH = 2048, 256


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class SequenceWriter:
    """Packs ids into sequences of `length` and writes `batch` of them at a time; the last sequence is padded with 0 under a mask of 0. A mask is a list of bytes too, a bit for each id from the lowest up, so it is read in place; unmasked() spreads it."""

    def __init__(self, path: str, length: int = LENGTH, batch: int = BATCH, dtype=np.uint16):
        self.fs, self.path = _open(path)
        assert length % 8 == 0
        self.length, self.batch, self.dtype = length, batch, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(self.path)
        self.out = pa.ipc.new_stream(self.file, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.length * self.batch:
            flat = np.concatenate(self.parts)
            step = self.length * self.batch
            whole = len(flat) // step * step
            for at in range(0, whole, step):
                self._write(flat[at : at + step], step)
            self.parts, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray, n: int) -> None:
        rows = -(-n // self.length)
        flat, mask = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, np.uint8)
        flat[:n], mask[:n] = ids, 1
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(i).type) for i, x in enumerate((flat, np.packbits(mask, bitorder="little")))]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.parts), self.held)
        self.out.close()
        self.file.close()


def read_sequences(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, mask) of each batch, as arrays of sequences; both are views of the file's memory where it can be mapped."""
    fs, at = _open(path)
    source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
    with pa.ipc.open_stream(source) as stream:
        for batch in stream:
            yield tuple(c.flatten().to_numpy(zero_copy_only=True).reshape(-1, c.type.list_size) for c in batch.columns)


def unmasked(mask: np.ndarray) -> np.ndarray:
    """A bool for each id of masks as they're stored."""
    return np.unpackbits(mask, axis=-1, bitorder="little").astype(bool)


class Sequences:
    """Random access to a mapped stream file: every batch but the last has as many rows, so a sequence's place is arithmetic. Opening it reads the batches'
    headers alone; ids and masks are views, paged in when they're used."""

    def __init__(self, path: str):
        self.batches = list(read_sequences(path))
        self.rows = len(self.batches[0][0]) if self.batches else 1

    def __len__(self) -> int:
        return sum(len(ids) for ids, _ in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batches[i // self.rows]
        return ids[i % self.rows], mask[i % self.rows]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Writes ids of docs, in ascending doc_id order over files in the order of `file`, and returns the manifest: file, path, n_docs, n_ids.

    Each text is encoded whole (null and empty: no ids) and end_id follows it. Rows with one doc_id stand in the order of a hash of their texts, null doc_ids
    first. Rows are dealt by ranges of doc_id and that hash, so rows that share a doc_id, or have none, spread too, and a task writes one data file and one file of (doc_id, n_ids) rows under names of its own attempt, so a
    task that runs again never disturbs a file; the manifest, written once, names the files that count. An empty table gives an
    empty manifest. Only doc_id and text are read, whatever else docs has. A task holds one Arrow batch and one batch of sequences.
    """
    key = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    id_type = pa.string() if dict(key.dtypes)["doc_id"] == "string" else pa.int64()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(tokenizer), TaskContext.get()
        dtype = np.uint16 if encode.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        name = f"{path}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        out = rows = None
        n_docs = n_ids = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = SequenceWriter(f"{name}.arrows", length, dtype=dtype)
                fs, at = _open(f"{name}.docs.arrows")
                rows = pa.ipc.new_stream(file := fs.open_output_stream(at), rows_schema(id_type))
            counts = []
            for _, part in chunks(batch.column(1)):
                ids = encode.encode(part)
                ends = ids.offsets.to_numpy()
                out.add(np.insert(ids.values.to_numpy().astype(dtype), ends[1:], end_id))
                counts.append(np.diff(ends) + 1)
            counts = np.concatenate(counts).astype(np.int64)
            rows.write_batch(pa.record_batch([batch.column(0).cast(id_type), pa.array(counts, pa.int64())], schema=rows_schema(id_type)))
            n_docs, n_ids = n_docs + len(counts), n_ids + int(counts.sum())
        if out is not None:
            out.close()
            rows.close()
            file.close()
            yield pa.RecordBatch.from_pydict({"file": [context.partitionId()], "path": [name], "n_docs": [n_docs], "n_ids": [n_ids]}, pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = key.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return saved(dealt.mapInArrow(write, "file int, path string, n_docs long, n_ids long"), "manifest")


def rows_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("n_ids", pa.int64())])


def read_tokens(manifest: DataFrame, doc_type: str = "long") -> DataFrame:
    """A row for each document of the files, in their order: doc_id, start (ids before it), n_tokens, ids_crc32 (of all its ids as little-endian unsigned 32-bit integers)."""
    order = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # a row a file: as few as there were tasks
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(row["path"], row["start"])

    n = max(1, manifest.count())
    return files.repartition(n, "file").mapInArrow(read, f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long")


def _documents(path: str, start: int) -> Iterator[pa.RecordBatch]:
    flat = (ids.reshape(-1)[: int(unmasked(mask).sum())] for ids, mask in read_sequences(f"{path}.arrows"))
    held = np.empty(0, np.uint16)
    fs, at = _open(f"{path}.docs.arrows")
    with fs.open_input_file(at) as source, pa.ipc.open_stream(source) as docs:
        for batch in docs:
            starts, sums = [], []
            for n in batch.column(1).to_pylist():
                while len(held) < n:
                    held = np.concatenate([held, next(flat)])
                sums.append(zlib.crc32(held[:n].astype("<u4").tobytes()))
                starts.append(start)
                held, start = held[n:], start + n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), batch.column(1), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "tokens"))
    return read_tokens(manifest)
