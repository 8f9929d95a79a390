"""Vectorised text kernels on Arrow batches: words, shingles and lines as 64-bit hashes.

A batch of texts is one byte buffer with offsets; every step works on whole arrays. Texts are taken
in slices of half a MB, so temporary arrays stay small however many rows a batch has; a longer text
is a slice of its own and is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE2 = _U(0xD6E8FEB86659FD93 | 1)
_INV = {int(b): _U(pow(int(b), -1, 1 << 64)) for b in (_BASE, _BASE2)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Fixed by the contracts: white space is \x20 and \x09-\x0D, lower case is A-Z only.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(raw: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``most`` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            have = tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (base, _INV[int(base)]))
        if size <= 4 * SLICE_BYTES:
            _POWERS[int(base)] = have
    return have


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span. ``second``: with another base, for 128 bits together."""
    if not len(starts):
        return np.zeros(0, _U)
    base = _BASE2 if second else _BASE
    power, inverse = _powers(len(raw) + 1, base)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, _U)
        np.cumsum((raw.astype(_U) + _U(1)) * power[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mix(h + mix((ends - starts).astype(_U) * base))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of the words of each text; a word never crosses two texts."""
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges < len(raw))]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    last[edges - 1] = inside[edges - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each word in order, A-Z lower-cased."""
    starts, ends, doc = word_spans(raw, offsets)
    return span_hashes(LOWER[raw], starts, ends), doc


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each run of ``size`` words; of the whole sequence of a text with fewer words."""
    count = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        weight = mix(np.arange(1, size + 1, dtype=_U) * _BASE) | _U(1)
        out = np.zeros(max(0, len(words) - size + 1), _U)
        for k in range(size):
            out += words[k : k + len(out)] * weight[k]
        whole = doc[: len(out)] == doc[size - 1 : size - 1 + len(out)] if len(out) else np.zeros(0, bool)
        hashes, owner = mix(out[whole]), doc[: len(out)][whole]
        few = np.flatnonzero((count > 0) & (count < size))
        if len(few):
            short = np.zeros(len(few), _U)
            for k in range(size - 1):
                has = count[few] > k
                short[has] += words[first[few[has]] + k] * weight[k]
            hashes = np.concatenate([hashes, mix(short + count[few].astype(_U))])
            owner = np.concatenate([owner, few])
    return hashes, owner


def distinct_shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each of at most 256 texts, ascending, of 56 bits each."""
    n = len(offsets) - 1
    words, doc = word_hashes(raw, offsets)
    hashes, owner = shingle_hashes(words, doc, n, size)
    packed = np.unique((owner.astype(_U) << _U(56)) | (hashes >> _U(8)))
    bounds = np.searchsorted(packed, np.arange(n, dtype=_U) << _U(56))
    return packed & _U((1 << 56) - 1), np.append(bounds, len(packed))
