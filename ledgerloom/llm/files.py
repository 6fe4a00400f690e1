"""Binary files in the cluster's shared folder, written whole or not at all."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = _at(uri)
    store.create_dir(path, recursive=True)


class Output:
    """A file under a name that no other attempt of the same task uses; only named in results once closed."""

    def __init__(self, folder: str, label: str, suffix: str):
        self.uri = f"{folder}/{label}-{uuid.uuid4().hex[:12]}.{suffix}"
        store, path = _at(self.uri)
        self.stream = store.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends and returns the offset of what was written."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()


def open_input(uri: str):
    store, path = _at(uri)
    return store.open_input_file(path)


def remove(uri: str) -> None:
    store, path = _at(uri)
    store.delete_file(path)
