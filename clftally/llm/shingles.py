"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Words per shingle.
WIDTH = 5
# Texts are taken together up to about so many bytes.
BLOCK_BYTES = 1 << 18

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
# Its inverse modulo 2^64, by Newton's iteration.
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, as many as were ever needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, length: int) -> None:
        if length > len(self.up):
            size = 1 << int(length - 1).bit_length()
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, by, np.uint64))))
                for by in (_BASE, _INVERSE)
            )


_powers = Powers()


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes; equal for equal stretches wherever they lie."""
    _powers.reach(len(data) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * _powers.up[: len(data)], dtype=np.uint64)))
    found = (sums[ends] - sums[starts]) * _powers.down[starts]
    return mixed(found + (ends - starts).astype(np.uint64))


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in blocks: number of the first, bytes of all, and where each starts, with the end of the last."""
    texts = texts.cast(pa.large_binary())
    lengths = np.array([len(t) if t is not None else 0 for t in (v.as_py() for v in texts)], np.int64)
    first, total = 0, 0
    for i, length in enumerate([*lengths, BLOCK_BYTES]):
        if total and (total + length > BLOCK_BYTES or i == len(lengths)) or i == len(lengths) > first:
            joined = b"".join([v.as_py() or b"" for v in texts[first:i]])
            yield first, np.frombuffer(joined, np.uint8), np.concatenate(([0], np.cumsum(lengths[first:i])))
            first, total = i, 0
        total += length


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Shingle hashes of each text of a block, in order and with repeats.

    A text with fewer words than a shingle has one shingle of all its words; without words it has none.
    """
    blank = _BLANK[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = blank[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~blank & edge[:-1])
    edge[:-1] = blank
    edge[offsets] = True
    ends = np.flatnonzero(~blank & edge[1:]) + 1
    words = stretch_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    runs = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for step in range(WIDTH):
        runs = runs * _BASE + words[step : step + len(runs)]
    runs = mixed(runs)
    found = []
    for a, b in zip(first, first[1:]):
        if b - a >= WIDTH:
            found.append(runs[a : b - WIDTH + 1])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for word in words[a:b]:
                    whole = whole * _BASE + word
            found.append(mixed(np.array([whole], np.uint64)))
        else:
            found.append(runs[:0])
    return found
