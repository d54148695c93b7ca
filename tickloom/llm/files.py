"""Byte files below the shared folder, written and range-read by executors."""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=8)
def _store(scheme_and_host: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"{scheme_and_host}/")[0]


def split_uri(uri: str):
    """(file system, path) of a URI; a plain path is local."""
    if "://" not in uri:
        uri = "file://" + uri
    head, _, rest = uri.partition("://")
    host, slash, path = rest.partition("/")
    return _store(f"{head}://{host}"), slash + path if head == "file" else host + slash + path


def create(uri: str):
    """An output stream; folders are made as needed."""
    store, path = split_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_random(uri: str):
    """An input file for range reads (`seek`, `read`)."""
    store, path = split_uri(uri)
    return store.open_input_file(path)
