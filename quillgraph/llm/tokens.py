"""Word hashes of whole texts, computed over byte arrays rather than word by word.

A word's hash is a polynomial over a random table of bytes modulo 2**64, read off prefix sums, then mixed.
Two different words share a hash with a chance of about 2**-64; results that count or compare words by
their hashes are exact but for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BATCH_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BATCH_BYTES + 1024)
        base = _BASE if kind == "up" else _INVERSE
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * BATCH_BYTES:
            _powers[kind] = have
    return have


def batches(texts: list) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of texts of about ``BATCH_BYTES``; a longer text is a run of its own."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t)
        if run and size + len(b) > BATCH_BYTES:
            yield first, i, run
            run, size, first = [], 0, i
        run.append(b)
        size += len(b) + 1
    if run:
        yield first, len(texts), run


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, text after text, and where each text's begin.

    The second array has one entry more than there are texts.
    """
    raw = np.frombuffer(b"\n".join(run).lower() + b"\n", np.uint8)
    begins = np.zeros(len(run) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in run], out=begins[1:])
    blank = _BLANK[raw]
    edge = np.diff(np.concatenate(([True], blank)).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _power("up", len(raw))[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", len(raw))[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, begins)


def shingle_sets(run: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingle hashes of each text; of fewer words, the whole sequence; of none, empty."""
    h, at = word_hashes(run)
    out = []
    if len(h) >= k:
        rolled = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            rolled = mix(rolled * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - k + 1 + j] + np.uint64(j + 1))
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for w in h[a:b]:
                one = mix(np.array([one], np.uint64) * np.uint64(0xA24BAED4963EE407) + w)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
