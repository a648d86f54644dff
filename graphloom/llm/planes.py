"""Token files: ids in fixed-size blocks, each transposed into byte planes and compressed.

File layout, all integers little-endian:

    magic            8 bytes  "GLPLANE1"
    blocks           for each block of ``BLOCK`` ids (the last may be shorter) four planes: all
                     lowest bytes, then all second bytes, and so on, each its own zstandard frame
    chunk index      for each block: ids uint32, then four times frame start uint64, length uint32
    document index   zstandard frame: doc_id int64 x n, null flag uint8 x n, ids uint32 x n
    footer           blocks uint64, documents uint64, chunk index start uint64,
                     document index start uint64, magic

High planes of small ids are constant and all but vanish.  The chunk index lets a reader fetch
any range of ids without touching the other blocks.  Files are named by partition, partitions
are ranges of doc_id, so the order of names is the order of documents.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import tokens, workspace

MAGIC = b"GLPLANE1"
BLOCK = 65_536
PLANES = 4
_INDEX = np.dtype([("n", "<u4")] + [(f"{w}{p}", k) for p in range(PLANES) for w, k in (("start", "<u8"), ("length", "<u4"))])
_FOOTER = "<QQQQ8s"
_FOOTER_SIZE = struct.calcsize(_FOOTER)


def to_planes(ids: np.ndarray) -> list[bytes]:
    return [plane.tobytes() for plane in ids.astype("<u4").view(np.uint8).reshape(-1, PLANES).T]


def from_planes(planes: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").reshape(-1)


class Writer:
    """Writes one file block by block; at most a block of ids and the indexes are in memory."""

    def __init__(self, out, level: int = 3) -> None:
        import zstandard

        self.out, self.packer, self.at = out, zstandard.ZstdCompressor(level=level), 0
        self.waiting, self.n = [], 0
        self.index: list[tuple] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n += len(ids) // 4
        if self.n >= BLOCK:
            self._blocks(self.n - self.n % BLOCK)

    def _blocks(self, n: int) -> None:
        whole = np.frombuffer(b"".join(self.waiting), "<u4")
        for k in range(0, n, BLOCK):
            block = whole[k : min(k + BLOCK, n)]
            entry = [len(block)]
            for plane in to_planes(block):
                frame = self.packer.compress(plane)
                entry += [self._put(frame), len(frame)]
            self.index.append(tuple(entry))
        self.waiting, self.n = [whole[n:].tobytes()], self.n - n

    def close(self) -> None:
        self._blocks(self.n)
        index_at = self._put(np.array(self.index, _INDEX).tobytes())
        ids = np.array([x or 0 for x in self.doc_ids], "<i8").tobytes()
        nulls = np.array([x is None for x in self.doc_ids], "u1").tobytes()
        docs_at = self._put(self.packer.compress(ids + nulls + np.array(self.sizes, "<u4").tobytes()))
        self._put(struct.pack(_FOOTER, len(self.index), len(self.doc_ids), index_at, docs_at, MAGIC))


class Reader:
    """Reads a file's indexes at once and its blocks one by one."""

    def __init__(self, file) -> None:
        import zstandard

        self.file, self.opener = file, zstandard.ZstdDecompressor()
        end = file.size()
        blocks, documents, index_at, docs_at, magic = struct.unpack(_FOOTER, self._get(end - _FOOTER_SIZE, _FOOTER_SIZE))
        if magic != MAGIC or self._get(0, 8) != MAGIC:
            raise ValueError("not a token file, or one cut short")
        self.index = np.frombuffer(self._get(index_at, docs_at - index_at), _INDEX)
        if len(self.index) != blocks:
            raise ValueError("the chunk index doesn't fit the footer")
        raw = self.opener.decompress(self._get(docs_at, end - _FOOTER_SIZE - docs_at))
        self.doc_ids = np.frombuffer(raw, "<i8", documents)
        self.nulls = np.frombuffer(raw, "u1", documents, 8 * documents).astype(bool)
        self.sizes = np.frombuffer(raw, "<u4", documents, 9 * documents)

    def _get(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def block(self, k: int) -> np.ndarray:
        entry = self.index[k]
        return from_planes([self.opener.decompress(self._get(int(entry[f"start{p}"]), int(entry[f"length{p}"]))) for p in range(PLANES)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the file, from the blocks that hold them."""
        first = start // BLOCK
        parts = [self.block(k) for k in range(first, -(-stop // BLOCK))]
        return np.concatenate(parts)[start - first * BLOCK : stop - first * BLOCK] if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, start in the file, number of ids and their crc32; one block at a time."""
        held, k, start = b"", 0, 0
        for doc_id, null, size in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.sizes.tolist()):
            crc, missing = 0, 4 * size
            while missing:
                if not held:
                    held, k = self.block(k).tobytes(), k + 1
                crc = zlib.crc32(held[:missing], crc)
                taken = min(missing, len(held))
                held, missing = held[taken:], missing - taken
            yield None if null else doc_id, start, size, crc
            start += size


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, level: int = 3, files: int | None = None) -> DataFrame:
    """Encode documents and write one file for each range of doc_id; returns the manifest.

    Manifest: part, file, documents, ids, bytes, first_id (ids in all files before).  A task writes
    under a name of its own and renames when it is done, so a repeated or lost task leaves no
    half file; the manifest names the finished ones.  ``path`` is opened by pyarrow, which must know
    its scheme (file, hdfs, viewfs, s3, gs).  A null text is just ``end_id``.  Null ids
    come first; repeated rows are all written; other columns are ignored; an empty table gives no file.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(vocabulary), end_id.to_bytes(4, "little")
        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}.planes"
        mine = f"{root}/.{name}.{task.taskAttemptId()}"
        writer = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    out = store.open_output_stream(mine)
                    writer = Writer(out, level)
                writer.add(doc_id, encoder.encode(text.as_py()) + end)
        if writer is None:
            return
        writer.close()
        out.close()
        store.move(mine, f"{root}/{name}")
        row = [[task.partitionId()], [name], [len(writer.sizes)], [sum(writer.sizes)], [writer.at]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "file", "documents", "ids", "bytes"])

    # a draw beside the id, so that many rows of one id, or of null, can be cut into several files
    drawn = docs.select("doc_id", "text", F.rand(7).alias("_r"))
    ordered = drawn.repartitionByRange(files, "doc_id", "_r").sortWithinPartitions("doc_id", "_r").drop("_r")
    manifest = workspace.keep(ordered.mapInArrow(run, "part int, file string, documents long, ids long, bytes long"), "planes-manifest")
    # One row for each file: small enough to be summed in one place.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def read(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{file}") as opened:
                    found = Reader(opened).documents()
                    while rows := [(d, first + s, n, crc) for d, s, n, crc in itertools.islice(found, 8192)]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    spread = manifest.select("file", "first_id").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


workspace.ship("graphloom.llm.tokens", __name__)
