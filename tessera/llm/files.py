"""Files in the shared folder, read and written from Python workers.

A path is a URI that pyarrow can resolve (file://, s3://, gs://, hdfs://). A
file gets its name only when it is complete, so a lost or repeated task leaves
either a whole file or none.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving memory back to the system when its batches end: workers live on and serve other stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else "file://" + uri)


@contextlib.contextmanager
def writing(uri: str):
    """A binary stream; its content appears at uri on success only."""
    store, path = resolve(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(part) as out:
            yield out
        store.move(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(part)
        raise


def write(uri: str, data: bytes) -> None:
    with writing(uri) as out:
        out.write(data)


def read(uri: str) -> bytes:
    store, path = resolve(uri)
    with store.open_input_file(path) as f:
        return f.read()


def opened(uri: str):
    store, path = resolve(uri)
    return store.open_input_file(path)


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name means a public tokenizer's file."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
