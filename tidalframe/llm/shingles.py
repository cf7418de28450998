"""Vectorised word shingles over a batch of whole texts.

A word is a maximal run of characters other than space and U+0009..U+000D; A-Z
are lower-cased first.  Everything works on the UTF-8 bytes of a whole batch at
once, so the cost is a few array passes a byte and no Python step a word.
Words and shingles are known by 64-bit hashes: two different shingles of a
corpus of 10^8 share a hash with a chance of about 10^-3 in all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _R)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text, first byte of each word in the joined buffer).

    The hash of a word is its polynomial in an odd base modulo 2^64, mixed: it
    comes from differences of one running Horner-like sum that restarts for
    every text, so equal words hash alike wherever they stand.
    """
    joined = b"\n".join(texts) + b"\n"
    raw = _FOLD[np.frombuffer(joined, dtype=np.uint8)]
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.cumsum(lengths)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds, side="left"))))
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), counts, starts
    # Position within the word picks an odd multiplier; words are short, so few of these are made.
    width = ends - starts
    place = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    power = _powers(int(width.max()))
    value = _BYTE[raw[~space]] * power[place]
    sums = np.add.reduceat(value, np.cumsum(width) - width)
    return mix(sums + width.astype(np.uint64)), counts, starts


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    step = np.uint64(1)
    base = _R | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(min(n, 64)):
            out[i] = step
            step = step * base
        for i in range(64, n, 64):  # later places from earlier ones
            k = min(64, n - i)
            out[i : i + k] = out[:k] * step
            step = step * out[63] * base
    return out


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes text by text, number of shingles of each text, repeats included).

    A text of fewer than k words, but at least one, has one shingle: all its words.
    """
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64), n
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    span = np.repeat(np.minimum(counts, k), n)
    total = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(k, dtype=np.uint64)])
    base = _R
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            part = padded[at + j] * power
            total += part if j == 0 else np.where(span > j, part, np.uint64(0))
            power = power * base
        return mix(total + span.astype(np.uint64)), n


def distinct_sets(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes without repeats, ascending within each text, as signed 64-bit; number for each text)."""
    owner = np.repeat(np.arange(len(n)), n)
    signed = hashes.view(np.int64)
    order = np.lexsort((signed, owner))
    signed = signed[order]
    keep = np.ones(len(signed), dtype=bool)
    keep[1:] = (signed[1:] != signed[:-1]) | (owner[1:] != owner[:-1])
    return signed[keep], np.bincount(owner[keep], minlength=len(n)).astype(np.int64)


def sets_of(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text; null counts as empty."""
    words, counts, _ = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    return distinct_sets(*shingle_hashes(words, counts, k))


#: Characters of text worked on at once; the arrays for them take about 30 times as much.
CHUNK = 1 << 18


def chunks(texts: list[str | None], size: int = CHUNK):
    """(first, last) of runs of texts of about that many characters, at least one text each."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def text_chunks(column: pa.Array, size: int = CHUNK):
    """(first, last, texts) of runs of an Arrow column of about that many bytes, as Python strings only while they are worked on."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield first, last, column.slice(first, last - first).to_pylist()
        first = last


SIGNATURE_WORDS = 8


def signature_words(n: np.ndarray) -> np.ndarray:
    """Words of 64 bits of a set's signature: 8, doubled until it has 2 bits an element (a width for each band of sizes)."""
    k = np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / (32 * SIGNATURE_WORDS)))).astype(np.int64)
    return SIGNATURE_WORDS << k


def signatures(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words a set): a parity bitmap for each set, in which every element flips one bit.

    The bits in which two bitmaps of one width differ are at most as many as the elements
    that only one set has.  The halves of a bitmap XORed are its bitmap of half the width.
    """
    words = signature_words(n)
    bits = words * 64
    base = np.repeat(np.cumsum(bits) - bits, n)
    at = base + (mix(hashes.view(np.uint64) + _R) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64), words


def bits_apart(flat: np.ndarray, offset: np.ndarray, words: np.ndarray, p: np.ndarray, q: np.ndarray, other: np.ndarray | None = None, other_offset: np.ndarray | None = None, other_words: np.ndarray | None = None) -> np.ndarray:
    """In how many bits signature p differs from signature q, the wider one folded; q is of `other` if that is given."""
    other = flat if other is None else other
    q_offset, q_words = (offset, words) if other_offset is None else (other_offset, other_words)
    out = np.zeros(len(p), dtype=np.int64)
    wp, wq = words[p], q_words[q]
    for a, b in {*zip(wp.tolist(), wq.tolist(), strict=True)}:
        rows = np.flatnonzero((wp == a) & (wq == b))
        for lo in range(0, len(rows), max(1, (1 << 20) // max(a, b))):
            r = rows[lo : lo + max(1, (1 << 20) // max(a, b))]
            x = flat[offset[p[r], None] + np.arange(a)]
            y = other[q_offset[q[r], None] + np.arange(b)]
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            out[r] = np.bitwise_count((x ^ y).view(np.uint64)).sum(1)
    return out


def set_ids(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, 0 for the empty one."""
    out = np.zeros(len(n), dtype=np.uint64)
    some = n > 0
    if some.any():
        sums = np.add.reduceat(mix(hashes.view(np.uint64) ^ _M1), (np.cumsum(n) - n)[some])
        out[some] = mix(sums + n[some].astype(np.uint64) * _R)
    return out.view(np.int64)
