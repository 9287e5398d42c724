"""Helpers for code that runs in Python workers."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, LocalFileSystem

_KEPT: dict = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """What this worker made last, for all its tasks that ask by the same key; for another key it gives way first."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def read_stored(files: tuple[str, ...]) -> pa.Table:
    """A written table (``session.store``, files: its ``inputFiles``) as the worker itself reads it from the shared folder: no row of it passes the driver."""
    parts = []
    for f in files:
        at = urlsplit(f)
        fs, path = (LocalFileSystem(), unquote(at.path)) if at.scheme in ("", "file") else FileSystem.from_uri(f)
        parts.append(pq.read_table(path, filesystem=fs, use_threads=False))
    return pa.concat_tables(parts)


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """For a batch that makes many small objects without cycles: reference counts free them, the cycle collector would only walk them again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
