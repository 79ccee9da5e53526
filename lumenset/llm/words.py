"""Words of texts as arrays of 64-bit hashes, inside tasks.

A word is a run of bytes other than space and 0x09-0x0D, or what a given ``split`` makes of a segment. Texts are hashed in
segments of about a megabyte, cut at white space, so memory follows the words of one batch and not the bytes.
"""

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np

SEGMENT = 1 << 20
NEXT_SPACE = re.compile(b"[\x20\x09-\x0d]")

KNOWN_WORDS = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
        if size > 8 * SEGMENT:  # for one very long text: not kept
            return _powers.pop("up")[: n + 1], _powers.pop("down")[: n + 1]
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Cryptographic 64-bit hashes of words; those of frequent words are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


_hashes = _Hashes()


def segments_of(text: bytes, split: Callable[[bytes], list[bytes]] = bytes.split) -> Iterator[list[bytes]]:
    """The words of a text in lists, one for about a megabyte of it."""
    at = 0
    while len(text) - at > SEGMENT:
        found = NEXT_SPACE.search(text, at + SEGMENT)
        end = found.start() if found else len(text)
        yield split(text[at:end])
        at = end
    yield split(text[at:] if at else text)


def hash_words(texts: list[bytes], split: Callable[[bytes], list[bytes]] = bytes.split) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and how many each text has."""
    counts = np.zeros(len(texts), dtype=np.int64)
    hashes, get = [], _hashes.__getitem__
    for number, text in enumerate(texts):
        for words in segments_of(text, split):
            counts[number] += len(words)
            hashes.append(np.fromiter(map(get, words), np.uint64, len(words)))
    return (np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)), counts


def window_hashes(words: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hashes of the runs words[start : start + length], for many runs at once."""
    up, down = powers(len(words))
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], dtype=np.uint64, out=total[1:])
    return mix((total[start + length] - total[start]) * down[start] + np.asarray(length).astype(np.uint64))


def shingles(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and the text each belongs to; a shorter text is one shingle."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    many = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    of = np.repeat(np.arange(len(counts)), many)
    within = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    start = offsets[:-1][of] + within
    return window_hashes(words, start, np.minimum(counts, n)[of]), of


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def encoded(texts) -> list[bytes]:
    """UTF-8 bytes; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t or b"") for t in texts]
