"""Vectorised text fingerprints for the tasks (numpy only).

They select and group; strings made for it can share one (op1 decides by
``digests``). All fingerprints are polynomial sums over a buffer, modulo 2**64, whose byte
values come from a fixed random table, finished by a bit mixer.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = U(0xC2B2AE3D27D4EB4F)
_CACHE: dict = {}
TILE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def byte_values() -> np.ndarray:
    if "bytes" not in _CACHE:
        _CACHE["bytes"] = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    return _CACHE["bytes"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_CACHE.get("pow", ())) < n:
        size = max(n, TILE + (1 << 14))
        for key, b in (("pow", _BASE), ("inv", pow(_BASE, -1, 2**64))):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _CACHE[key] = np.cumprod(a, dtype=np.uint64)
    return _CACHE["pow"][:n], _CACHE["inv"][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """``h[i]``: the sum over the first ``i`` bytes; see ``span_hash``."""
    p, _ = powers(len(buf) + 1)
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(byte_values()[buf] * p[: len(buf)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the strings ``[start, end)`` (equal strings, equal values)."""
    _, inv = powers(len(h))
    return mix((h[end] - h[start]) * inv[start])


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2 digests of the strings ``[start, end)``, as rows of two uint64."""
    view, out = memoryview(buf), bytearray()
    for a, b in zip(start.tolist(), end.tolist()):
        out += hashlib.blake2b(view[a:b], digest_size=16).digest()
    return np.frombuffer(bytes(out), np.uint64).reshape(-1, 2)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values."""
    n = len(v)
    if n < w:
        return v[:0]
    a = np.full(-(-n // w) * w, U(2**64 - 1))
    a[:n] = v
    a = a.reshape(-1, w)
    pre = np.minimum.accumulate(a, axis=1).ravel()
    suf = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1: n])


def _word_bytes() -> np.ndarray:
    if "word" not in _CACHE:
        t = np.zeros(256, bool)
        t[128:] = True
        for r in (b"09", b"az", b"AZ", b"__"):
            t[r[0]: r[1] + 1] = True
        _CACHE["word"] = t
    return _CACHE["word"]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all ``texts`` in order, and each text's
    first index into them (one more at the end).

    A word is a maximal run of ASCII letters, digits, underscores and non-ASCII
    characters of the lower-cased text. Buffers are worked off in tiles that
    end between words, so memory stays bounded for very long texts.
    """
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    at = np.cumsum([0] + [len(p) + 1 for p in parts])
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    isw, hashes, starts = _word_bytes(), [], []
    pos, n = 0, len(buf)
    while pos < n:
        end = min(pos + TILE, n)
        while end < n:
            gap = np.flatnonzero(~isw[buf[end - 1: end - 1 + TILE]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + TILE, n)
        t = buf[pos:end]
        m = np.zeros(len(t) + 2, np.int8)
        m[1:-1] = isw[t]
        d = np.diff(m)
        s, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        hashes.append(span_hash(prefix_sums(t), s, e))
        starts.append(s + pos)
        pos = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, at[: len(parts) + 1])


def shingles(texts: list[str], n: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``n`` words of each text, repeats kept, and
    each text's first index. A text of 1 to n-1 words has one shingle of all
    its words if ``short``, else none."""
    h, at = word_hashes(texts)
    count = np.diff(at)
    full = np.maximum(count - n + 1, 0)
    k = np.where(full > 0, full, (count > 0) & short).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(k)])
    width = np.minimum(count, n)
    pos = np.arange(first[-1]) - np.repeat(first[:-1], k) + np.repeat(at[:-1], k)
    w = np.repeat(width, k)
    acc = w.astype(np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for j in range(n):
        acc = acc * _STEP + np.where(w > j, padded[pos + j], U(0))
        acc ^= acc >> U(29)
    return mix(acc), first


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text in ascending order, their counts, and each
    text's first index."""
    texts = len(first) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    idx = np.flatnonzero(new)
    counts = np.diff(np.append(idx, len(v)))
    return v[idx], counts, np.searchsorted(o[idx], np.arange(texts + 1))


def chunks(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Cut a list of texts into runs of about ``limit`` bytes."""
    out, i, total = [], 0, 0
    for j, s in enumerate(sizes):
        if j > i and total + s > limit:
            out.append((i, j))
            i, total = j, 0
        total += s
    if i < len(sizes):
        out.append((i, len(sizes)))
    return out
