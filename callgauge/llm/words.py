"""Lower-case words of digits, letters and anything beyond ASCII.

On UTF-8 bytes the words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lowering A-Z are the
same as on characters, as all bytes of a character beyond ASCII are 0x80 or more.
"""

from __future__ import annotations


def _target(byte: int) -> int:
    if ord("A") <= byte <= ord("Z"):
        return byte + 32
    word = byte >= 0x80 or ord("0") <= byte <= ord("9") or ord("a") <= byte <= ord("z")
    return byte if word else ord(" ")


TARGETS = bytes(map(_target, range(256)))


def split(raw: bytes | None) -> list[bytes]:
    return raw.translate(TARGETS).split() if raw else []
