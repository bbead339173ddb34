"""Files in the shared folder, opened by URI from the driver or an executor."""

from __future__ import annotations

from pyarrow import fs


def _at(uri: str):
    return fs.FileSystem.from_uri(uri)


def open_out(uri: str):
    """A stream that makes the file, and its folder where the store has folders."""
    system, path = _at(uri)
    if "/" in path.rstrip("/"):
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def open_in(uri: str):
    """A seekable reader."""
    system, path = _at(uri)
    return system.open_input_file(path)
