"""Append-only pack files in the shared scratch space and range reads from them.

Executors reach the space through ``pyarrow.fs`` (local or mounted folders, HDFS,
S3, ...).  A file's name holds the task attempt, so that a repeated task never
writes into another's file; only rows of the attempt that Spark kept point to it.
"""

from __future__ import annotations

from collections import OrderedDict

from pyarrow import fs
from pyspark import TaskContext


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class PackWriter:
    """One file of a task, made at the first write."""

    def __init__(self, folder: str, suffix: str):
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        self.part = part
        self.path = f"{folder}/{part:06d}-{attempt}{suffix}"
        self.out = None
        self.size = 0

    def append(self, data: bytes) -> tuple[int, int]:
        """(offset, length) of the data in the file."""
        if self.out is None:
            system, path = place(self.path)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = system.open_output_stream(path, compression=None)
        self.out.write(data)
        self.size += len(data)
        return self.size - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class RangeReader:
    """Range reads that keep a few open files and, of each, one window that was read ahead."""

    def __init__(self, files: int = 16, window: int = 1 << 18):
        self.files, self.window = files, window
        self.open: OrderedDict[str, list] = OrderedDict()

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            system, p = place(path)
            self.open[path] = [system.open_input_file(p), 0, b""]
            if len(self.open) > self.files:
                self.open.popitem(last=False)[1][0].close()
        self.open.move_to_end(path)
        entry = self.open[path]
        if not (entry[1] <= offset and offset + length <= entry[1] + len(entry[2])):
            entry[1], entry[2] = offset, entry[0].read_at(max(length, self.window), offset)
        at = offset - entry[1]
        got = entry[2][at : at + length]
        if len(got) != length:
            raise OSError(f"{path} ends before {offset + length}")
        return got

    def close(self) -> None:
        for entry in self.open.values():
            entry[0].close()
        self.open.clear()
