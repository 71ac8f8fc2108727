"""Random access to files by path or URI, on the driver and in tasks."""

from __future__ import annotations

import os


def filesystem(path: str):
    """(file system, path on it).  A plain path is local; any other scheme goes through Arrow's file systems."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def extension(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[2].lower()


class RandomAccess:
    """A file of known size, read by ranges."""

    def __init__(self, path: str):
        system, name = filesystem(path)
        self.path = path
        self.file = system.open_input_file(name)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(max(0, min(length, self.size - start)), start) if start < self.size else b""

    def __enter__(self) -> RandomAccess:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def exists(path: str) -> bool:
    from pyarrow import fs

    system, name = filesystem(path)
    return system.get_file_info(name).type == fs.FileType.File


def there(path: str) -> bool:
    """Whether there is a file or folder."""
    from pyarrow import fs

    system, name = filesystem(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def size_of(path: str) -> int:
    system, name = filesystem(path)
    info = system.get_file_info(name)
    if info.size is None:
        raise FileNotFoundError(path)
    return info.size


def size_below(path: str) -> int:
    """The bytes of a file, or of all files of a folder."""
    from pyarrow import fs

    system, name = filesystem(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.Directory:
        return sum(f.size or 0 for f in system.get_file_info(fs.FileSelector(name, recursive=True)))
    return info.size or 0


def write_bytes(path: str, data: bytes) -> None:
    system, name = filesystem(path)
    with system.open_output_stream(name) as out:
        out.write(data)
