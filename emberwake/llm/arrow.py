"""Small helpers around Arrow batches shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Iterator

import pyarrow as pa

SLICE = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Short slices, so that only few texts at a time exist as Python objects. At the end, freed memory goes back to the system: workers live on."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until none of columns is equal to it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def trim() -> None:
    """Gives memory that the allocators hold back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_models: dict = {}


def held(make):
    """make(file), kept across tasks until the worker is asked for another model: workers outlive a stage, and would add up the memos of all."""

    @functools.wraps(make)
    def get(file: str):
        key = make.__module__, make.__qualname__, file
        if key not in _models:
            release()
            _models[key] = make(file)
        return _models[key]

    return get


def release() -> None:
    """Drops the model that is held, with its memos. The collector runs, as a model may be part of a cycle and would stay beside the next one."""
    if _models:
        _models.clear()
        gc.collect()
        trim()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Null counts as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """As texts(), in UTF-8."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


class Memo(dict):
    """Values by key, made on first use. Emptied beyond `most` entries: a memo, never a limit on results."""

    def __init__(self, make, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def summed(rows, value: str = "double", total_value: str | None = None):
    """rows(part int, counts binary) of equal-sized numpy arrays -> one row for each part, added up as they stream in."""
    import numpy as np

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for row in b.column("counts"):
                one = np.frombuffer(row.as_buffer(), value).astype(total_value or value)
                total = one.copy() if total is None else total + one
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    return rows.groupBy("part").applyInArrow(add, "part int, counts binary")
