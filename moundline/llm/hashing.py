"""Hashes of words by mixed blocks of eight bytes, for all words of a text at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes that are looked at together, however long a text is.
BLOCK = 1 << 18
R = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one.
LONG = 64
_ENDS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the runs of bytes from ``start`` to ``stop``: eight bytes after another are mixed in, in as many rounds as the longest run of up to LONG bytes has blocks."""
    size = stop - start
    out = mixed(size.astype(np.uint64) * R + np.uint64(salt))
    blocks = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    left = np.flatnonzero((size > 0) & (size <= LONG))
    done = 0
    while len(left):
        block = np.ascontiguousarray(blocks[start[left] + done]).view("<u8")[:, 0] & _ENDS[np.minimum(size[left] - done, 8)]
        out[left] = mixed((out[left] ^ block) * R)
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > LONG):
        out[i] = long_hash(data[start[i] : stop[i]], salt)
    return out


def long_hash(word: np.ndarray, salt: int = 0) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(np.ascontiguousarray(word), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "<u8")[0]


def pieces(text: np.ndarray, inside: np.ndarray) -> Iterator[np.ndarray]:
    """A text of any length in blocks of at most BLOCK bytes, cut where ``inside[byte]`` is false; a word of more bytes is a block of its own."""
    at = 0
    while len(text) - at > BLOCK:
        gap = np.flatnonzero(~inside[text[at : at + BLOCK]])
        if len(gap):
            cut = at + int(gap[-1]) + 1
        else:
            cut = at + BLOCK
            while cut < len(text) and not len(gap):
                gap = np.flatnonzero(~inside[text[cut : cut + BLOCK]])
                cut += int(gap[0]) if len(gap) else len(text[cut : cut + BLOCK])
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words (runs of bytes that are not ASCII white space), in order."""
    out = []
    for part in pieces(text, ~_SPACE):
        out.append(hashes(part, *runs(~_SPACE[part])))
    return out[0] if len(out) == 1 else np.concatenate(out)


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """The set of hashes of each n words in a row, sorted; of all words if there are fewer; empty without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = mixed(h * R + words[j : len(words) - n + 1 + j])
    return np.unique(h)
