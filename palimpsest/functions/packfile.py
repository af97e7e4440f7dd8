"""Pack files: blobs one after the other, a header that lists them, and the header's length in the last four bytes.

Blobs and header are sealed pieces: 16 bytes in front and 16 behind belong to the encryption, which is outside this library.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

from palimpsest.model import ENTRY_COMPRESSED, ENTRY_PLAIN, HEADER_LENGTH, OVERHEAD

# The first byte of a header's entry.
KINDS = {0: ("data", False), 1: ("tree", False), 2: ("data", True), 3: ("tree", True)}

#: offset, length, plain length if compressed, type, id
Blob = tuple[int, int, int | None, str, str]


def unsealed(piece: bytes) -> bytes:
    """The content of a piece whose encryption is no more than its frame."""
    return piece[OVERHEAD // 2 : -(OVERHEAD // 2)]


def sealed(content: bytes) -> bytes:
    return bytes(OVERHEAD // 2) + content + bytes(OVERHEAD // 2)


def header_size(blobs: list[Blob]) -> int:
    return OVERHEAD + sum(ENTRY_PLAIN if b[2] is None else ENTRY_COMPRESSED for b in blobs)


def header(pack: bytes, opened: Callable[[bytes], bytes] = unsealed) -> list[Blob]:
    """What a pack's header lists; ValueError if it can't be read."""
    if len(pack) < HEADER_LENGTH:
        raise ValueError("no header")
    n = struct.unpack("<I", pack[-HEADER_LENGTH:])[0]
    if n + HEADER_LENGTH > len(pack) or n < OVERHEAD:
        raise ValueError("the header has no place in the pack")
    data, at, offset, out = opened(pack[-HEADER_LENGTH - n : -HEADER_LENGTH]), 0, 0, []
    while at < len(data):
        if data[at] not in KINDS:
            raise ValueError("an entry of an unknown kind")
        kind, compressed = KINDS[data[at]]
        width = ENTRY_COMPRESSED if compressed else ENTRY_PLAIN
        if at + width > len(data):
            raise ValueError("an entry is cut off")
        length, *plain = struct.unpack("<II" if compressed else "<I", data[at + 1 : at + width - 32])
        out.append((offset, length, plain[0] if plain else None, kind, data[at + width - 32 : at + width].hex()))
        at, offset = at + width, offset + length
    return out


def built(blobs: list[tuple[str, bytes]], compress: Callable[[bytes], bytes] | None = None) -> bytes:
    """A pack of blobs (type, content)."""
    body, entries = b"", b""
    number = {v: k for k, v in KINDS.items()}
    for kind, content in blobs:
        piece = sealed(compress(content) if compress else content)
        sizes = struct.pack("<II", len(piece), len(content)) if compress else struct.pack("<I", len(piece))
        body, entries = body + piece, entries + bytes([number[kind, compress is not None]]) + sizes + hashlib.sha256(content).digest()
    return body + sealed(entries) + struct.pack("<I", len(entries) + OVERHEAD)


def _plain(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def findings(pack_id: str, pack: bytes, listed: list[Blob], opened: Callable[[bytes], bytes] = unsealed) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """kind, blob_id, expected, actual of what is wrong in a pack whose blobs, by offset, the index lists."""
    size = header_size(listed)
    whole = sum(b[1] for b in listed) + size + HEADER_LENGTH
    if len(pack) != whole:
        yield "PackSizeMismatch", None, str(whole), str(len(pack))
        return
    if (found := hashlib.sha256(pack).hexdigest()) != pack_id:
        yield "PackHashMismatch", None, pack_id, found
        return
    if (n := struct.unpack("<I", pack[-HEADER_LENGTH:])[0]) != size:
        yield "PackHeaderLengthMismatch", None, str(size), str(n)
        return
    try:
        inside = header(pack, opened)
    except ValueError as e:
        yield "ErrorReadingPack", None, None, str(e)
        return
    if inside != listed:
        yield "PackHeaderMismatchIndex", None, None, None
        return
    for offset, length, plain, _, i in listed:
        try:
            content = opened(pack[offset : offset + length])
            content = content if plain is None else _plain(content)
        except Exception as e:  # whatever the opener or the decompressor raises is a finding
            yield "ErrorReadingPack", i, None, str(e)
            continue
        if plain is not None and len(content) != plain:
            yield "PackBlobLengthMismatch", i, str(plain), str(len(content))
        if (found := hashlib.sha256(content).hexdigest()) != i:
            yield "PackBlobHashMismatch", i, i, found
