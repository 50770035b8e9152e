"""Words and five-word shingles as 64-bit hashes, in numpy, for use inside tasks.

Words are runs of anything but ASCII white space, A-Z lower-cased. A hash stands for its word or shingle: of n
different ones in a corpus about n * n / 2**65 pairs may coincide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WIDTH = 5
#: Bytes of text worked on at once; a longer text is taken alone.
CHUNK = 512 << 10
#: Bytes from which a word is hashed by itself.
LONG_WORD = 4096
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xBF58476D1CE4E5B9)
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\x0b\x0c\r")] = True
#: Masks of a word's first 0 to 8 bytes.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def hashed_words(joined: bytes, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of some bytes begin, how long they are, and their hashes; blanks says which bytes part words.

    Eight bytes of all words at a time are mixed in, so words of up to eight bytes never share a hash.
    """
    raw = np.frombuffer(joined + bytes(8), np.uint8)
    blank = blanks[raw]
    blank[-8:] = True
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edges = np.concatenate(([0], edges))
    begin, size = edges[::2], edges[1::2] - edges[::2]
    left = size
    eight = np.ndarray(len(joined) + 1, "<u8", raw, strides=(1,))
    found = left.astype(np.uint64) * FACTOR
    for w in np.flatnonzero(left >= LONG_WORD):
        found[w] = xxhash.xxh64_intdigest(joined[begin[w] : begin[w] + left[w]])
    words = np.flatnonzero(left < LONG_WORD)
    at, left = begin[words], left[words]
    while len(words):
        found[words] = mixed(found[words] ^ (eight[at] & MASKS[np.minimum(left, 8)]) * FACTOR)
        more = left > 8
        words, at, left = words[more], at[more] + 8, left[more] - 8
    return begin, size, found


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, and where each text's begin (one more than texts)."""
    begin, _, found = hashed_words(b"\n".join(t or b"" for t in texts).lower(), BLANK)
    starts = np.cumsum([0, *[len(t or b"") + 1 for t in texts]])
    return found, np.searchsorted(begin, starts)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIXER
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text in order of place, and where each text's begin.

    A text of fewer than WIDTH words has one shingle, all its words; one without words has none.
    """
    sizes = np.diff(first)
    h = words.copy()
    for k in range(1, WIDTH):
        h[:-k] = h[:-k] * FACTOR + words[k:]
    counts = np.where(sizes >= WIDTH, sizes - WIDTH + 1, np.minimum(sizes, 1))
    keep = np.zeros(len(words) + 1, np.int32)
    np.add.at(keep, first[:-1], (counts > 0).astype(np.int32))
    np.add.at(keep, first[:-1] + counts, -(counts > 0).astype(np.int32))
    places = np.cumsum(keep[:-1]) > 0
    for i in np.flatnonzero((sizes > 0) & (sizes < WIDTH)):
        value = np.uint64(sizes[i])
        for w in words[first[i] : first[i + 1]]:
            value = value * FACTOR + w
        h[first[i]] = value
    return mixed(h[places]), np.concatenate(([0], np.cumsum(counts)))


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or b"") > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(text or b"")
    if texts:
        yield start, len(texts)


def sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, in order."""
    for a, b in chunks(texts):
        with np.errstate(over="ignore"):
            hashes, first = shingle_hashes(*word_hashes(texts[a:b]))
        for i in range(b - a):
            own = np.sort(hashes[first[i] : first[i + 1]])
            yield own[np.concatenate((own[:1] == own[:1], own[1:] != own[:-1]))]
