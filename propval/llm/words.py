"""Words of texts as bytes: every separator of the word-based operators is ASCII, so UTF-8 bytes split like characters."""

from __future__ import annotations

# A word is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
OUTSIDE = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = bytes(range(256)).lower()  # bytes.lower changes A-Z only
FOLD = bytes(0x20 if any(a <= b <= z for a, z in OUTSIDE) else b for b in _LOWER)


def words(data: bytes | None) -> list[bytes]:
    """The words of a text's UTF-8 bytes, lower-cased; none for a null."""
    return data.translate(FOLD).split() if data else []
