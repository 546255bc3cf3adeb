"""Hashes of all words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

#: Bytes that are hashed together, about; a longer text is hashed alone.
CHUNK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
#: The increment, the multipliers and the shifts of the splitmix64 generator.
P = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = np.ones(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = False
_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[97:123] = _LETTERS[128:] = True

#: Which bytes belong to words, after lowering A-Z: all but white space; or digits, a-z and what is beyond ASCII.
BY_SPACE, BY_LETTER = _SPACES, _LETTERS

#: The low n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = np.atleast_1d(x)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def _of_words(eights: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: eight at a time, each mixed with what came before, so that no two blocks add up alike."""
    out = mix(sizes.astype(np.uint64) * np.uint64(P))
    at = np.flatnonzero(sizes <= LONG)
    for done in range(0, LONG, 8):
        at = at[sizes[at] > done]
        if not len(at):
            break
        block = eights[starts[at] + done].view("<u8").ravel() & _FIRST[np.minimum(sizes[at] - done, 8)]
        out[at] = mix(out[at] ^ block) + np.uint64(P)
    for i in np.flatnonzero(sizes > LONG):
        out[i] = int.from_bytes(blake2b(flat[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of CHUNK bytes about."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(texts: list[bytes], words: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of texts in order, index of the first word of each text and the number of all).

    With prefixes, the hashes have a row more for the words' first bytes of each such number.
    """
    flat = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]  # a line's end belongs to no word
    inside = words[flat]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([flat, np.zeros(8, np.uint8)]), 8)
    sizes = [ends - starts, *[np.minimum(ends - starts, n) for n in prefixes]]
    rows = [mix(_of_words(eights, flat, starts, n) + np.uint64(i)) for i, n in enumerate(sizes)]
    hashes = np.stack(rows) if prefixes else rows[0]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(starts, begins)
