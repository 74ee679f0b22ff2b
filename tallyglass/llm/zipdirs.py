"""Directories of ZIP files, read by byte ranges: the end record, ZIP64 records, the central directory, members' places.

Nothing is extracted: of an archive only its tail, its directory and the local headers asked for are read. Sizes and
places come from the central directory, as members that were streamed have none in their local headers.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

#: Signatures, layouts and limits of the format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_FORM, END64_FORM, LOCATOR64_FORM, ENTRY_FORM, LOCAL_FORM = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL", "<4s6H3L5H2L", "<4s5H3L2H"
MOST_COMMENT, FULL_32, EXTRA_64 = 65_535, 0xFFFFFFFF, 1
STORED, DEFLATED = 0, 8


class BadArchive(ValueError):
    """The bytes are not a whole ZIP archive of the kind that can be read by ranges."""


class Member(NamedTuple):
    name: str
    method: int
    encrypted: bool
    packed: int  #: bytes in the archive
    size: int
    header: int  #: where its local header is


class Range(io.RawIOBase):
    """Bytes [start, end) of a seekable file as a file of their own."""

    def __init__(self, file: BinaryIO, start: int, end: int):
        self.file, self.at, self.end = file, start, end

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        self.file.seek(self.at)
        data = self.file.read(min(len(buffer), self.end - self.at))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def _at(file: BinaryIO, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) < size:
        raise BadArchive("the archive ends too early")
    return data


def directory(file: BinaryIO, size: int) -> tuple[int, int, int, int]:
    """(start, size, entries of the central directory, bytes before the archive's own beginning)."""
    tail_at = max(0, size - MOST_COMMENT - struct.calcsize(END_FORM))
    tail = _at(file, tail_at, size - tail_at)
    k = len(tail)
    while (k := tail.rfind(END, 0, k)) >= 0:
        if len(tail) - k >= struct.calcsize(END_FORM):
            *_, entries, length, start, comment = struct.unpack_from(END_FORM, tail, k)
            if k + struct.calcsize(END_FORM) + comment == len(tail):
                break
    else:
        raise BadArchive("no end of a central directory")
    end = tail_at + k
    locator = end - struct.calcsize(LOCATOR64_FORM)
    if locator >= 0:  # ZIP64 records hold the full numbers wherever they stand
        mark, _, at, _ = struct.unpack(LOCATOR64_FORM, _at(file, locator, struct.calcsize(LOCATOR64_FORM)))
        if mark == LOCATOR64:
            own = locator - struct.calcsize(END64_FORM)  # where it is if bytes stand before the archive
            for end in (at, own):
                mark, *_, entries, length, start = struct.unpack(END64_FORM, _at(file, end, struct.calcsize(END64_FORM)))
                if mark == END64:
                    break
            else:
                raise BadArchive("no ZIP64 end record")
    before = end - length - start
    if before < 0:
        raise BadArchive("the central directory is cut off")
    return start + before, length, entries, before


def members(file: BinaryIO, size: int) -> Iterator[Member]:
    """The entries of the central directory, in its order, a piece of it in memory at a time."""
    start, length, entries, before = directory(file, size)
    data = io.BufferedReader(Range(file, start, start + length), 1 << 16)
    for _ in range(entries):
        fixed = data.read(struct.calcsize(ENTRY_FORM))
        if len(fixed) < struct.calcsize(ENTRY_FORM) or fixed[:4] != ENTRY:
            raise BadArchive("a damaged entry in the central directory")
        _, _, _, flags, method, _, _, _, packed, full, n_name, n_extra, n_comment, _, _, _, header = struct.unpack(ENTRY_FORM, fixed)
        name, extra, _ = data.read(n_name), data.read(n_extra), data.read(n_comment)
        if FULL_32 in (packed, full, header):
            wide = iter(_wide(extra))
            full, packed, header = (next(wide, x) if x == FULL_32 else x for x in (full, packed, header))
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, bool(flags & 1), packed, full, header + before)


def _wide(extra: bytes) -> list[int]:
    """The 64-bit numbers of a ZIP64 field: those of size, packed size and place that do not fit elsewhere, in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == EXTRA_64:
            return [x for (x,) in struct.iter_unpack("<Q", extra[at + 4 : at + 4 + n - n % 8])][:3]
        at += 4 + n
    return []


def place(file: BinaryIO, member: Member) -> int:
    """Where a member's bytes begin."""
    head = _at(file, member.header, struct.calcsize(LOCAL_FORM))
    mark, *_, n_name, n_extra = struct.unpack(LOCAL_FORM, head)
    if mark != LOCAL:
        raise BadArchive(f"{member.name}: no local header")
    return member.header + len(head) + n_name + n_extra


def stored(file: BinaryIO, member: Member) -> tuple[int, int]:
    """[start, end) of a stored member."""
    if member.method != STORED or member.encrypted:
        raise BadArchive(f"{member.name}: compressed or encrypted, so it has no ranges of its own")
    start = place(file, member)
    return start, start + member.size


def content(file: BinaryIO, member: Member) -> BinaryIO:
    """A member's content as a stream; stored and deflated ones can be read."""
    if member.encrypted or member.method not in (STORED, DEFLATED):
        raise BadArchive(f"{member.name}: encrypted, or compressed in another way")
    start = place(file, member)
    raw = Range(file, start, start + member.packed)
    return io.BufferedReader(raw if member.method == STORED else _Inflated(raw))


class _Inflated(io.RawIOBase):
    def __init__(self, raw: Range):
        self.raw, self.inflate, self.held = raw, zlib.decompressobj(-15), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held and not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.raw.read(1 << 16)
            self.held = self.inflate.decompress(data, 1 << 16) if data else self.inflate.flush()
            if not data:
                break
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n
