"""Terms of a text: maximal runs of wanted bytes, A-Z lower-cased.

Every byte of a multi-byte UTF-8 sequence is wanted, so a run of bytes is a run of code points.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split at once; a run that is longer is never cut.
PIECE = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_table(wanted: str) -> bytes:
    """For ``bytes.translate``: the wanted ASCII characters and all further bytes stay, the rest becomes a blank."""
    keep = set(wanted.encode())
    return bytes((b + 32 if 65 <= b <= 90 else b) if b in keep or b >= 128 else 32 for b in range(256))


LETTERS = term_table(UPPER + LOWER)
ALPHANUMERIC = term_table(UPPER + LOWER + "0123456789")


def terms(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of those of about ``PIECE`` bytes."""
    clean = text.translate(table)
    if len(clean) <= PIECE:
        yield clean.split()
        return
    lo = 0
    while lo < len(clean):
        hi = len(clean) if lo + PIECE >= len(clean) else clean.find(b" ", lo + PIECE)
        hi = len(clean) if hi < 0 else hi
        yield clean[lo:hi].split()
        lo = hi
