"""Word shingles as sorted arrays of 64-bit hashes, computed for whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about so many bytes.
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(7)
_odd = lambda n: _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _odd(256)
_PLACE = _odd(64)
_BASE = 0xBF58476D1CE4E5B9
_BACK = pow(_BASE, -1, 2**64)
_cache: dict[int, np.ndarray] = {}


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them; another one for each seed."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _cache.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)
        _cache[base] = have
    return have[:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of consecutive texts with their first index; nulls become empty."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // SLICE_BYTES
    starts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(starts, starts[1:], strict=False):
        yield a, texts.slice(a, b - a)


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, n = parts.flatten(), len(texts)
    owner = pc.list_parent_indices(parts).to_numpy()
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    full = offsets[1:] > offsets[:-1]
    start, end = offsets[:-1][full], offsets[1:][full]
    counts = np.bincount(owner[full], minlength=n)
    if not len(start):
        return np.zeros(0, np.uint64), counts
    data = np.frombuffer(flat.buffers()[2], np.uint8)[: offsets[-1]]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
        h = (sums[end] - sums[start]) * _power(_BACK, len(data) + 1)[start]
    return mix(h), counts


def shingle_sets(texts: pa.Array, width: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Each text's set of ``width``-word shingles, sorted; a shorter text is one shingle, one without words has none."""
    out = []
    for _, part in slices(texts):
        words, counts = word_hashes(part, lower)
        ends = np.cumsum(counts)
        with np.errstate(over="ignore"):
            if len(words) >= width:
                h = words[: len(words) - width + 1] * _PLACE[0]
                for k in range(1, width):
                    h = h + words[k : len(words) - width + 1 + k] * _PLACE[k]
                h = mix(h, 1)
            for e, n in zip(ends.tolist(), counts.tolist(), strict=True):
                if n >= width:
                    out.append(np.unique(h[e - n : e - width + 1]))
                elif n:
                    out.append(mix(np.array([int((words[e - n : e] * _PLACE[:n]).sum())], np.uint64), 2 + n))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out
