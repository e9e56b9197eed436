"""Files as bytes that are fetched where they are looked at: a page at a time, whatever the file's size."""

from __future__ import annotations

import hashlib
import struct
from collections import OrderedDict
from urllib.parse import quote

from pyarrow import fs

PAGE, PAGES = 1 << 16, 64
HASH_CHUNK = 1 << 20


def opened(path: str):
    """A random-access file of a path as Spark names it (``file:/...``, ``hdfs://...``, ``s3://...``, or a local path)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, at = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(at)


class FileBytes:
    """Enough of ``bytes`` for the readers: length, one byte, slices. At most ``PAGES`` pages are held."""

    def __init__(self, path: str) -> None:
        self.file = opened(path)
        self.size = self.file.size()
        self.pages: OrderedDict[int, bytes] = OrderedDict()

    def __len__(self) -> int:
        return self.size

    def _page(self, number: int) -> bytes:
        found = self.pages.pop(number, None)
        if found is None:
            found = self.file.read_at(min(PAGE, self.size - number * PAGE), number * PAGE)
            if len(self.pages) >= PAGES:
                self.pages.popitem(last=False)
        self.pages[number] = found
        return found

    def __getitem__(self, key):
        if isinstance(key, int):
            if not 0 <= key < self.size:
                raise IndexError(key)
            return self._page(key // PAGE)[key % PAGE]
        start, stop, _ = key.indices(self.size)
        if stop <= start:
            return b""
        if stop - start > PAGE:
            return self.file.read_at(stop - start, start)
        first, last = start // PAGE, (stop - 1) // PAGE
        data = self._page(first) if first == last else self._page(first) + self._page(last)
        return data[start - first * PAGE : stop - first * PAGE]

    def close(self) -> None:
        self.file.close()


def at(form: str, data, offset: int) -> tuple:
    """``struct.unpack_from`` for anything that has slices."""
    return struct.unpack(form, data[offset : offset + struct.calcsize(form)])


def digest(path: str) -> tuple[int, str]:
    """(bytes read, SHA-256) in one pass of bounded memory."""
    found, size = hashlib.sha256(), 0
    with opened(path) as file:
        while chunk := file.read(HASH_CHUNK):
            found.update(chunk)
            size += len(chunk)
    return size, found.hexdigest()
