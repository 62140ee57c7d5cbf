"""Structure of TIFF and BigTIFF files, read by byte ranges: only the header, the directories and the entries that are asked for."""

from __future__ import annotations

import struct
from collections.abc import Callable

#: Fixed values of the TIFF standard: format and size of each field type.
_TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Bytes that a range reader fetches at least, so that a header and its directory come in one read.
LEAST_READ = 4096
#: Directories that are followed from the first one.
MOST_DIRECTORIES = 64

Read = Callable[[int, int], bytes]


class Held:
    """Byte ranges of a file in memory."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def __call__(self, at: int, size: int) -> bytes:
        return self.data[at : at + size]


class Ranges:
    """Byte ranges of a file by its path or URI, through ``pyarrow.fs`` (local files, HDFS and object stores); counts the bytes it fetches."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        if uri.startswith("file:"):
            uri = "/" + uri.removeprefix("file:").lstrip("/")
        system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        self.file = system.open_input_file(path)
        self.fetched, self._near = 0, (0, b"")

    def __call__(self, at: int, size: int) -> bytes:
        start, near = self._near
        if not start <= at <= at + size <= start + len(near):
            start, near = self._near = at, self.file.read_at(max(size, LEAST_READ), at)
            self.fetched += len(near)
        return near[at - start : at - start + size]


class Directory:
    """One image of a file: its tags, whose values are read when they are asked for."""

    def __init__(self, read: Read, order: str, big: bool, at: int) -> None:
        self.read, self.order = read, order
        head, entry, place = ("Q", "HHQ", 12) if big else ("H", "HHI", 8)
        head_size, size = struct.calcsize(order + head), struct.calcsize(order + entry) + (8 if big else 4)
        (n,) = struct.unpack(order + head, read(at, head_size))
        rows = read(at + head_size, n * size + (8 if big else 4))
        self.entries: dict[int, tuple[str, int, int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + entry, rows, k * size)
            if kind == 2:
                code = "c"
            elif (code := _TYPES.get(kind)) is None:
                continue
            inside = at + head_size + k * size + place
            if struct.calcsize(order + code) * count > (8 if big else 4):
                (inside,) = struct.unpack_from(order + ("Q" if big else "I"), rows, k * size + place)
            self.entries[tag] = code, count, inside
        (self.next,) = struct.unpack_from(order + ("Q" if big else "I"), rows, n * size)

    def __contains__(self, tag: int) -> bool:
        return tag in self.entries

    def count(self, tag: int) -> int:
        return self.entries[tag][1]

    def values(self, tag: int, default: tuple = (), first: int = 0, count: int | None = None) -> tuple:
        """Values of a tag, or ``count`` of them from ``first`` on without fetching the others."""
        if tag not in self.entries:
            return default
        code, n, at = self.entries[tag]
        size = struct.calcsize(self.order + code)
        count = n - first if count is None else min(count, n - first)
        return struct.unpack(f"{self.order}{count}{code}", self.read(at + first * size, count * size))

    def value(self, tag: int, default=None):
        found = self.values(tag, count=1)
        return found[0] if found else default

    def text(self, tag: int) -> str:
        return b"".join(self.values(tag)).split(b"\0")[0].decode("latin-1")


def is_tiff(start: bytes) -> bool:
    return start[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+")


def directories(read: Read) -> list[Directory]:
    """The directories of a file in their order: the image itself, its overviews and masks, further pages."""
    start = read(0, 16)
    if not is_tiff(start):
        raise ValueError("not a TIFF file")
    order = "<" if start[:2] == b"II" else ">"
    big = 43 in start[2:4]
    (at,) = struct.unpack_from(order + ("Q" if big else "I"), start, 8 if big else 4)
    found, seen = [], set()
    while at and at not in seen and len(found) < MOST_DIRECTORIES:
        seen.add(at)
        found.append(Directory(read, order, big, at))
        at = found[-1].next
    return found


def overviews(images: list[Directory]) -> list[Directory]:
    """The image and its reduced copies, largest first; masks and further pages are left out."""
    return [images[0], *sorted((d for d in images[1:] if d.value(254, 0) & 5 == 1), key=lambda d: -d.value(256))]


def georeference(image: Directory) -> tuple[list[float] | None, int | None]:
    """Transform a, b, c, d, e, f from pixel corners to map coordinates, and the EPSG code of these coordinates.

    Read from the scale and tie point or the matrix, and the GeoKeys; codes 32767 (user defined) and absent ones give None. Where pixels
    are points, the transform is moved by half a pixel.
    """
    scale, tie, matrix = image.values(33550), image.values(33922), image.values(34264)
    if len(matrix) >= 8:
        place = [matrix[0], matrix[1], matrix[3], matrix[4], matrix[5], matrix[7]]
    elif len(scale) >= 2 and len(tie) >= 5:
        place = [scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1]]
    else:
        return None, None
    keys = image.values(34735)
    key = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    if key.get(1025) == 2:
        a, b, c, d, e, f = place
        place = [a, b, c - (a + b) / 2, d, e, f - (d + e) / 2]
    code = key.get(3072) if key.get(1024) == 1 else key.get(2048) if key.get(1024) == 2 else None
    return [float(x) for x in place], None if code in (None, 0, 32767) else code
