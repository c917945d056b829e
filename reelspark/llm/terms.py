"""Words of texts as decontamination and ranked search take them: runs of letters, digits and characters beyond ASCII,
with A-Z in lower case. Texts are handled as UTF-8 bytes, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

BLOCK = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _kept(b: int) -> bool:
    return b >= 0x80 or chr(b).isalnum()


_TABLE = bytes(ord(chr(b).lower()) if b < 0x80 and _kept(b) else b if _kept(b) else 0x20 for b in range(256))


def normal(text: bytes) -> bytes:
    """The text with A-Z in lower case and a blank for every byte outside words; byte positions stay."""
    return text.translate(_TABLE)


def blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a normal text, in lists of about a block; no word is cut."""
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + BLOCK) if len(text) - at > BLOCK else len(text)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def words(text: str) -> Column:
    """The same words as a column of arrays; none for null."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
