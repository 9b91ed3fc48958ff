"""Vectorised word and n-gram hashes over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE, STEP = 0x9E3779B97F4A7C15, 1 << 20
U = np.uint64


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for one segment."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    with np.errstate(over="ignore"):
        for b in (BASE, inverse):
            p = np.full(STEP + 1, b, dtype=U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; null counts as empty."""
    a = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` bytes, or one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z alone; all other bytes stay."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))


def words(data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of all texts, and each text's bounds among them.

    ``data`` may be longer than a segment: it is then cut at blanks (or, within
    a word longer than a segment, hashed in parts that are combined in order).
    """
    power, inverse = tables
    n = len(data)
    if n <= STEP:
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        inside = ~blank(data)
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        after = np.concatenate([inside[1:], [False]]) if n else inside
        start = np.flatnonzero(inside & (first[:n] | ~before))
        end = np.flatnonzero(inside & (first[1:] | ~after))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U), np.cumsum((lower(data).astype(U) + U(1)) * power[:n], dtype=U)])
            h = (total[end + 1] - total[start]) * inverse[start]
            h = mix(h + (end - start + 1).astype(U) * U(0xD1342543DE82EF95))
        return h, np.searchsorted(start, offsets)
    out, at, carry = [], 0, None  # one long text
    while at < n:
        to = min(n, at + STEP)
        if to < n:
            cut = np.flatnonzero(blank(data[at:to]))
            to = at + int(cut[-1]) + 1 if len(cut) else to
        part, _ = words(data[at:to], np.array([0, to - at]), tables)
        if carry is not None and blank(data[at : at + 1])[0]:  # the word ended with its segment
            out.append(np.array([carry], dtype=U))
        elif carry is not None:
            with np.errstate(over="ignore"):
                part[0] = mix(carry * U(0xA0761D6478BD642F) + part[0])
        carry = part[-1] if to < n and len(part) and not blank(data[to - 1 : to])[0] else None
        out.append(part[:-1] if carry is not None else part)
        at = to
    h = np.concatenate(out)
    return h, np.array([0, len(h)])


COEF = [0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xE7037ED1A0B428DB]


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer words has its whole sequence as its one shingle; one
    without words has none.
    """
    coef = [U(COEF[i % len(COEF)] + 2 * (i // len(COEF))) for i in range(k)]
    n = len(h)
    with np.errstate(over="ignore"):
        s = np.zeros(max(0, n - k + 1), dtype=U)
        for i, c in enumerate(coef):
            s += h[i : i + len(s)] * c
        s = mix(s)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            with np.errstate(over="ignore"):
                x = np.zeros(1, U) + U(b - a)
                for i, c in enumerate(coef[: b - a]):
                    x = x + h[a + i : a + i + 1] * c
            out.append(mix(x))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def segments(data: np.ndarray, offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and text numbers of stretches of at most ``most`` bytes.

    A longer text comes in several stretches, cut after a blank where there is one.
    """
    for a, b in spans(offsets, most):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= most:
            yield data[lo:hi], offsets[a : b + 1] - lo, np.arange(a, b)
            continue
        while lo < hi:
            to = min(hi, lo + most)
            if to < hi and len(cut := np.flatnonzero(blank(data[lo:to]))):
                to = lo + int(cut[-1]) + 1
            yield data[lo:to], np.array([0, to - lo]), np.array([a])
            lo = to
