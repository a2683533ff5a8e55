"""Small book files for queries and tests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib


def png(width: int = 1, height: int = 1, animated: bool = False) -> bytes:
    """A grey image."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    body = zlib.compress(b"".join(b"\0" + b"\x80" * width for _ in range(height)))
    extra = chunk(b"acTL", struct.pack(">II", 1, 0)) if animated else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + extra + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def comic(seed: int = 0, info: str | None = None) -> bytes:
    """An archive whose pages are out of order, named against their type, beside what is to be ignored."""
    info = info or f'<?xml version="1.0"?><ComicInfo><Title>Book &amp; {seed}</Title><Writer>W{seed}</Writer><LanguageISO>ja</LanguageISO><Manga>YesAndRightToLeft</Manga><Pages><Page Image="0" Type="Deleted"/><Page Image="1" Type="FrontCover"/></Pages></ComicInfo>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, data in (("pages/10.bin", png(2, 3)), ("pages/2.png", png(1 + seed, 1)), ("pages/1.png", png()), ("__MACOSX/pages/._2.png", b"fork"), ("notes.txt", b"text"), ("ComicInfo.xml", info.encode())):
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()
