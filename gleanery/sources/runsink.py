"""A run's rows as a table that appears whole or not at all.

Tasks write files into a hidden folder of the run and report them; the driver's commit moves
that folder to the run's name, or to the first `name (k)` that is free, in one rename. A
rename onto a folder that holds something fails, so of two runs that end at once one gets the
next name. A failed job's abort deletes what its tasks have written; files of attempts that
lost are not among the reported ones and go before the rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MOST_NAMES = 10_000


class Written(WriterCommitMessage):
    def __init__(self, file: str, rows: int):
        self.file, self.rows = file, rows


class RunWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: Any):
        self.path, self.run_name = options["path"], options["name"]
        self.hidden = f".{uuid.uuid4().hex}"
        system, folder = self._folder()
        system.create_dir(f"{folder}/{self.hidden}")  # by the driver alone: a task that begins after an abort finds no place to write to

    def _folder(self) -> tuple[Any, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One file of a task, under a name that no other attempt has; no file without a row."""
        import pyarrow.parquet as pq

        system, folder = self._folder()
        file, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if out is None:
                    sink = system.open_output_stream(f"{folder}/{self.hidden}/{file}")
                    out = pq.ParquetWriter(sink, batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
                sink.close()
        return Written(file if rows else "", rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, folder = self._folder()
        hidden = f"{folder}/{self.hidden}"
        told = [m for m in messages if m is not None and m.file]
        keep = {m.file for m in told}
        for info in system.get_file_info(fs.FileSelector(hidden)):
            if info.base_name not in keep:
                system.delete_file(info.path)
        with system.open_output_stream(f"{hidden}/_SUCCESS") as out:  # a run without rows is a folder that holds something, too
            out.write(json.dumps({"rows": sum(m.rows for m in told), "files": len(told)}).encode())
        for k in range(1, MOST_NAMES):
            name = self.run_name if k == 1 else f"{self.run_name} ({k})"
            if system.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:
                continue
            try:
                system.move(hidden, f"{folder}/{name}")
                return
            except OSError:  # another run has taken the name meanwhile
                if system.get_file_info(hidden).type == fs.FileType.NotFound:
                    raise
        raise OSError(f"no free name for {self.run_name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, folder = self._folder()
        if system.get_file_info(f"{folder}/{self.hidden}").type != fs.FileType.NotFound:
            system.delete_dir(f"{folder}/{self.hidden}")


class RunSink(DataSource):
    """df.write.format("run").options(path=..., name=...).mode("append").save(): a folder of parquet files with the run's name, suffixed where it is taken."""

    @classmethod
    def name(cls) -> str:
        return "run"

    def schema(self) -> str:
        return "row string"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("runs are never overwritten")
        return RunWriter(self.options, schema)


def register(spark) -> None:
    spark.dataSource.register(RunSink)
