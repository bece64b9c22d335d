"""Files that executors write and read by themselves, in any store pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path inside it."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[5:]
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return fs.FileSystem.from_uri(uri)


def writer(uri: str):
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def reader(uri: str):
    store, path = open_store(uri)
    return store.open_input_file(path)
