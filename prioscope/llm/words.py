"""Words of whole texts as UTF-8 bytes, inside tasks."""

from __future__ import annotations

# A-Z become lower case; digits, a-z and all bytes of characters beyond ASCII stay; the rest separates words.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))


def letter_bytes(text: bytes) -> bytes:
    """Same length as `text`, words separated by spaces."""
    return text.translate(_LETTERS)


def letter_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return text.translate(_LETTERS).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, which is what `bytes.split` separates at."""
    return text.split()
