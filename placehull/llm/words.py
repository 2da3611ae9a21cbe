"""Words and word hashes of byte strings, for code that runs inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

CACHE = 1 << 19  # words whose hash a task remembers


class Hashes(dict):
    """Word -> 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text: runs of bytes other than space, tab, line feed, vertical tab, form feed and return; A-Z in lower case."""
    return text.lower().split() if text else []


def hashes_of(words: list[bytes], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


PIECE = 1 << 16  # bytes of a text whose words are digested in one go
BLANK = re.compile(rb"[\x09-\x0D\x20]")
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
POWERS = np.cumprod(np.append(np.uint64(1), np.full(PIECE, BASE, np.uint64)))
INVERSES = np.cumprod(np.append(np.uint64(1), np.full(PIECE, pow(BASE, -1, 1 << 64), np.uint64)))
VALUES = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, np.uint64)
VALUES[np.arange(65, 91)] = VALUES[np.arange(97, 123)]
VALUES[[*range(9, 14), 32]] = 0  # between words


def digests(text: bytes | None) -> np.ndarray:
    """64-bit digests of ``words_of(text)``, made for all words of a piece at once.

    A word's digest is a polynomial of its bytes, taken from running sums over the piece, then mixed.
    """
    found, at = [], 0
    while text and at < len(text):
        blank = BLANK.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = blank.start() if blank else len(text)
        if end - at > PIECE:
            # the last blank up to PIECE, or else a word that is longer
            cut = max(text.rfind(b, at, at + PIECE) for b in (b" ", b"\t", b"\n", b"\x0b", b"\f", b"\r"))
            end = cut if cut > at else end
        found.append(_digests(text[at:end]) if end - at <= PIECE else np.array([_long(w) for w in text[at:end].split()], np.uint64))
        at = end
    return mix(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _digests(piece: bytes) -> np.ndarray:
    values = VALUES[np.frombuffer(piece, np.uint8)]
    inside, sums = np.zeros(len(values) + 2, bool), np.zeros(len(values) + 1, np.uint64)
    np.not_equal(values, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    values *= POWERS[: len(values)]
    np.cumsum(values, out=sums[1:])
    return (sums[edges[1::2]] - sums[edges[::2]]) * INVERSES[edges[::2]]


def _long(word: bytes) -> int:
    total = 0
    for at in range(0, len(word), PIECE):
        values = VALUES[np.frombuffer(word[at : at + PIECE], np.uint8)]
        total += int((values * POWERS[: len(values)]).sum()) * pow(BASE, at, 1 << 64)
    return total % (1 << 64)
