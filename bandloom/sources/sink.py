"""A file written by its tasks, each piece at its own place.

The driver makes a file beside the target, of full size and with what it knows already (headers, directories). Tasks write
their pieces (at, data) into it by position. A task that runs twice writes the same bytes to the same places, so neither lost
executors nor speculation do harm. When all have ended, their commit messages must add up to the pieces expected; the
file then gets the target's name in one step. Otherwise it goes, and what stood at the target before stays. The driver
copies nothing.

The target must lie in a folder that driver and executors share.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from bandloom.plans.ship import ship


@dataclass
class Written(WriterCommitMessage):
    pieces: int
    size: int


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.temporary, self.target, self.pieces = options["temporary"], options["target"], int(options["pieces"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        pieces = size = 0
        out = os.open(self.temporary, os.O_WRONLY)
        try:
            for batch in iterator:
                for at, data in zip(batch.column("at").to_pylist(), batch.column("data")):
                    view = memoryview(data.as_buffer())
                    pieces, size = pieces + 1, size + len(view)
                    while len(view):  # a write may be short
                        n = os.pwrite(out, view, at)
                        at, view = at + n, view[n:]
            os.fsync(out)
        finally:
            os.close(out)
        return Written(pieces, size)

    def commit(self, messages: list[Written | None]) -> None:
        found = sum(m.pieces for m in messages if m is not None)
        if found != self.pieces:
            self.abort(messages)
            raise ValueError(f"{found} pieces of {self.pieces} were written to {self.target}")
        os.replace(self.temporary, self.target)

    def abort(self, messages: list[Written | None]) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(self.temporary)


class PieceSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bandloom_pieces"

    def schema(self) -> str:
        return "at long, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options)


def write_pieces(pieces: DataFrame, path: str, size: int, known: Sequence[tuple[int, bytes]] = (), count: int | None = None) -> None:
    """A file of a size from pieces(at long, data binary), `count` of them, and what is known here."""
    spark = pieces.sparkSession
    ship(spark)
    count = pieces.count() if count is None else count
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(temporary, "wb") as f:
            f.truncate(size)
            for at, data in known:
                f.seek(at)
                f.write(data)
        spark.dataSource.register(PieceSink)
        rows = pieces.select("at", "data")
        rows.write.format("bandloom_pieces").option("temporary", temporary).option("target", path).option("pieces", str(count)).mode("append").save()
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(temporary)
