"""Files in the shared folder, from executors: local folders and any store that pyarrow's file systems reach."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Draft:
    """A file that gets its name only when it is whole; each attempt of a task writes a draft of its own."""

    def __init__(self, uri: str):
        self.system, self.path = locate(uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.sink = self.system.open_output_stream(self.draft)

    def publish(self) -> None:
        self.sink.close()
        self.system.move(self.draft, self.path)


def open_file(uri: str):
    """A file for random access, memory-mapped by systems that can."""
    system, path = locate(uri)
    if isinstance(system, fs.LocalFileSystem):
        return fs.LocalFileSystem(use_mmap=True).open_input_file(path)
    return system.open_input_file(path)


def open_stream(uri: str):
    system, path = locate(uri)
    return system.open_input_stream(path, compression=None)
