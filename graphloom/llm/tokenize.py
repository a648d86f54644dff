"""Token ids of a documents table, cut into pieces, without a shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphloom.llm import tokens, workspace

workspace.ship("graphloom.llm.tokens")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, seat long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row for each piece of at most ``capacity`` ids of each document.

    ids are the text's, then ``end_id``.  ``part`` is the task's partition and ``seat`` the
    number of earlier pieces of the same length in it, so (part, length, seat) tells pieces
    apart.  ``ids`` is null unless ``with_ids``.  A null text counts as empty; repeated rows
    and null ids are kept as they are; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        end = end_id.to_bytes(4, "little")
        part, step, seats = TaskContext.get().partitionId(), 4 * capacity, {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                for k in range(0, len(ids), step):
                    one = ids[k : k + step] if len(ids) > step else ids
                    length = len(one) // 4
                    seat = seats.get(length, 0)
                    seats[length] = seat + 1
                    rows.append((doc_id, k // step, k // 4, length, zlib.crc32(one), one if with_ids else None, part, seat))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
