"""Files that tasks write to and read from the shared store, whole or not at all."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = _place(uri)
    store.create_dir(path, recursive=True)


def list_folder(uri: str) -> list[str]:
    """The names of what a folder holds."""
    from pyarrow import fs

    store, path = _place(uri)
    return [f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True))]


@contextmanager
def output(uri: str):
    """A binary stream whose file takes its name once it is complete; a second attempt of a task replaces it."""
    store, path = _place(uri)
    draft = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft, compression=None) as out:
        yield out
    store.move(draft, path)


def input_stream(uri: str):
    store, path = _place(uri)
    return store.open_input_stream(path, compression=None)


def input_file(uri: str):
    """A file that can be read at any place."""
    store, path = _place(uri)
    return store.open_input_file(path)
