"""Prefix polynomial hashes of byte strings: anchors, runs of windows, and a hash-compared suffix sort."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time.
CHUNK = 1 << 17
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The two primes below 2^31 and the bases of the hash of whole runs.
PRIMES = (2147483647, 2147483629)
_PRIME_TABLES = [t % np.uint64(p - 1) + np.uint64(1) for t, p in zip((_TABLE, _TABLE >> np.uint64(20)), PRIMES, strict=True)]
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1), np.uint64)
        out[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have = out
    return have[:n]


def base_of(seed: int) -> int:
    """The odd base of the hashes of one attempt."""
    return ((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) | 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Polynomial hash of any substring in constant time: (H[b] - H[a]) * base^-a, modulo 2^64."""

    def __init__(self, data: np.ndarray, base: int = base_of(0), table: np.ndarray = _TABLE) -> None:
        n = len(data)
        self.inverse = _powers_of(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * _powers_of(base, n + 1)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


_prime_powers: dict[tuple[int, int], np.ndarray] = {}


def _prime_powers_of(base: int, prime: int, n: int) -> np.ndarray:
    have = _prime_powers.get((base, prime))
    if have is None or len(have) < n:
        out = np.empty(max(n, 1), np.uint64)
        out[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
            done += step
        _prime_powers[base, prime] = have = out
    return have[:n]


class PrimeHash:
    """Polynomial hash of any substring of at most ``CHUNK`` + 2^20 bytes modulo two primes, as one number of 62 bits.

    Unlike one modulo 2^64 it has no strings that collide whatever the base.
    """

    def __init__(self, data: np.ndarray, seed: int) -> None:
        self.parts = []
        for prime, table in zip(PRIMES, _PRIME_TABLES, strict=True):
            base = base_of(seed) % (prime - 3) + 2
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * _prime_powers_of(base, prime, len(data) + 1)[: len(data)] % np.uint64(prime), out=sums[1:])
            self.parts.append((np.uint64(prime), sums, _prime_powers_of(pow(base, -1, prime), prime, len(data) + 1)))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        (p, a, x), (q, b, y) = self.parts
        return ((a[stop] - a[start]) % p * x[start] % p << np.uint64(31)) | ((b[stop] - b[start]) % q * y[start] % q)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    if done < width:
        x = np.minimum(x[: len(x) - (width - done)], x[width - done :])
    return x


def runs(data: np.ndarray, ends: np.ndarray, width: int, gram: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Cut the windows of ``width`` bytes into runs that share their anchor, the window's least ``gram``-byte
    string by hash. Equal windows have equal anchors at equal places.

    ``ends``: where each document ends. Returns arrays over runs: first window, last window (both
    inclusive), hash of the anchor, hash of the run (its anchor's place, length and bytes), and the
    distance from the first window to the anchor.
    """
    found: list[tuple[np.ndarray, ...]] = []
    n = len(data)
    for lo in range(0, max(0, n - width + 1), CHUNK):
        part = data[lo : min(n, lo + CHUNK + width - 1)]
        first = np.arange(len(part) - width + 1)
        ph = PrefixHash(part, base_of(seed))
        at = np.arange(len(part) - gram + 1)
        grams = mix(ph.of(at, at + gram))
        low = np.uint64((1 << 21) - 1)
        packed = sliding_min((grams & ~low) | at.astype(np.uint64), width - gram + 1)
        anchor = (packed & low).astype(np.int64)
        doc_end = ends[np.searchsorted(ends, first + lo, "right")] - lo
        valid = first + width <= doc_end
        new = np.empty(len(first), bool)
        new[:1] = True
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (doc_end[1:] != doc_end[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(first)) - 1
        a, b = a[valid[a]], b[valid[a]]
        body = PrimeHash(part, seed).of(a, b + width)
        with np.errstate(over="ignore"):
            run = mix(body + mix((b - a).astype(np.uint64) * np.uint64(1 << 32) + (anchor[a] - a).astype(np.uint64)))
        # anchors are least hashes and so lie low; mixed again they spread evenly
        found.append((a + lo, b + lo, mix(grams[anchor[a]] ^ np.uint64(base_of(0))), run, anchor[a] - a))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def common_prefix(ph: PrefixHash, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Longest common prefix of the suffixes at ``a`` and ``b``, up to ``most``, by binary search over hashes."""
    low = np.zeros(len(a), np.int64)
    high = np.full(len(a), most, np.int64)
    sum_a, sum_b, inverse_a, inverse_b = ph.sums[a], ph.sums[b], ph.inverse[a], ph.inverse[b]
    # halving ``most`` + 1 answers; those settled early compare their own prefix again, which changes nothing
    for _ in range(most.bit_length()):
        mid = (low + high + 1) // 2
        same = (ph.sums[a + mid] - sum_a) * inverse_a == (ph.sums[b + mid] - sum_b) * inverse_b
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)
    return low


def _before(data: np.ndarray, ph: PrefixHash, a: np.ndarray, b: np.ndarray, most: int, ties: bool) -> np.ndarray:
    """Whether the suffix at ``a`` sorts before the one at ``b`` (``ties``: or equals it)."""
    same = common_prefix(ph, a, b, most)
    full = same == most
    at = np.where(full, 0, same)
    return np.where(full, ties, data[a + at] < data[b + at])


def suffix_sort(data: np.ndarray, ph: PrefixHash, suffixes: np.ndarray, groups: np.ndarray, most: int) -> np.ndarray:
    """Mergesort of suffixes within groups by their first ``most`` bytes; order of equal ones is kept.

    ``groups`` are sorted. All merges of one width go on at once: each suffix of a right run finds its place
    in the left one by binary search, and each comparison is a logarithmic one over prefix hashes. Those of
    the left run move by the number of right ones that come before them.
    Returns the order as indexes into ``suffixes``.
    """
    n = len(suffixes)
    order = np.arange(n)
    if not n:
        return order
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    size = np.diff(np.append(first, n))
    base = np.repeat(first, size)
    total = np.repeat(size, size)
    width = 1
    while width < size.max():
        at = np.flatnonzero(total > width)
        place = at - base[at]
        odd = place // width % 2 == 1
        right, left = at[odd], at[~odd]
        run = place[odd] // width * width
        # left runs that have a sibling are full
        start = base[right] + run - width
        lo, hi = start.copy(), start + width
        mine = suffixes[order[right]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            # of equal suffixes those of the left run come first
            goes = _before(data, ph, suffixes[order[mid]], mine[open_], most, True)
            lo[open_] = np.where(goes, mid + 1, lo[open_])
            hi[open_] = np.where(goes, hi[open_], mid)
        # right ones that stand before the left one at a place: those whose own place is at most that
        count = np.bincount(lo, minlength=n + 1)
        upto = np.cumsum(count)
        run_start = base[left] + place[~odd] // width * width
        moved = upto[left] - upto[run_start] + count[run_start]
        new = order.copy()
        new[lo + place[odd] - run] = order[right]
        new[left + moved] = order[left]
        order = new
        width *= 2
    return order


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Direct comparison of spans, byte by byte."""
    out = np.ones(len(a), bool)
    some = 5_000
    for lo in range(0, len(a), some):
        n = length[lo : lo + some]
        which = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        differ = data[a[lo : lo + some][which] + k] != data[b[lo : lo + some][which] + k]
        out[lo : lo + some][which[differ]] = False
    return out


def equal_windows(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Direct comparison of windows, byte by byte."""
    out = np.empty(len(a), bool)
    step = np.arange(width)
    for lo in range(0, len(a), 10_000):
        out[lo : lo + 10_000] = (data[a[lo : lo + 10_000, None] + step] == data[b[lo : lo + 10_000, None] + step]).all(axis=1)
    return out
