"""Repetition in texts of any length: character n-grams, consecutive patterns."""

from __future__ import annotations

import contextlib
import re
import signal
import threading
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import has_ngram_over


def most_repeated(text: str | None, n: int) -> int:
    """The count of the commonest n-gram; the last start position is left out."""
    if not text or len(text) <= n:
        return 0
    return max(Counter(text[i : i + n] for i in range(len(text) - n)).values())


def hashed_most_repeated(text: str | None, n: int) -> int:
    """most_repeated by 64-bit hashes of the n-grams (m of them: about m^2 / 2^65 wrong counts expected)."""
    if not text or len(text) <= n:
        return 0
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(u) - n, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + u[j : j + len(h)]
        h ^= h >> np.uint64(29)
    h.sort()
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    return int(np.diff(new).max())


def ngram_count(text: Column, n: int) -> Column:
    """The count of the commonest n-gram of each text, in Arrow batches (counts of whole texts are many times dearer as a column
    expression; repeats, which filters ask only of rows that are left, is one)."""

    @F.pandas_udf(T.IntegerType())
    def count(xs: pd.Series) -> pd.Series:
        return pd.Series([hashed_most_repeated(x, n) for x in xs], dtype="int32")

    return count(text)


def repeats(text: Column, n: int = 20, most: int = 20) -> Column:
    return has_ngram_over(text, n, most)


#: Two primes and their bases, by which parts of a text are compared (62 bits in all).
PRIMES, BASES = (2**31 - 1, 2**31 - 19), (911382323, 972663749)
#: Places that are probed at once.
CHUNK = 1 << 17


class Parts:
    """Prefix hashes of a text: how far it agrees with itself from two places on, for many pairs of places at once."""

    def __init__(self, text: str):
        self.code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.n = len(self.code)
        self.powers, self.sums = [], []
        for p, base in zip(PRIMES, BASES, strict=True):
            powers = np.ones(self.n + 1, np.int64)
            size, step = 1, base
            while size <= self.n:
                powers[size : 2 * size] = powers[:size][: self.n + 1 - size] * step % p
                size, step = 2 * size, step * step % p
            self.powers.append(powers)
            self.sums.append(np.concatenate([[0], np.cumsum((self.code + 1) * powers[:-1] % p)]) % p)

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        ok = np.ones(len(i), bool)
        for p, powers, sums in zip(PRIMES, self.powers, self.sums, strict=True):
            ok &= (sums[i + size] - sums[i]) % p * powers[j - i] % p == (sums[j + size] - sums[j]) % p
        return ok

    def extent(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The longest common part from i and j on (or up to them), of `most` characters at most: by halving."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i - mid, j - mid, mid) if back else self.equal(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def probes(n: int, times: int, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and units (i, k), in chunks: of each unit from `least` to n / times every (times - 1) k-th place. A run of unit k agrees
    with itself shifted by k over (times - 1) k characters, so that it covers one of them. n log n / times in all."""
    k = np.arange(least, n // times + 1)
    count = (n - k - 1) // ((times - 1) * k) + 1
    start = 0
    while start < len(k):
        end = max(start + 1, int(np.searchsorted(np.cumsum(count[start:]), CHUNK, "right")) + start)
        units = np.repeat(k[start:end], count[start:end])
        first = np.repeat(np.cumsum(count[start:end]) - count[start:end], count[start:end])
        yield (np.arange(len(units)) - first) * (times - 1) * units, units
        start = end


def steps_of(n: int, times: int = 20, least: int = 1) -> int:
    """How many places has_runs probes in a text of n characters: the same on every machine."""
    k = np.arange(least, n // times + 1)
    return int(((n - k - 1) // ((times - 1) * k) + 1).sum())


def cleaned(text: str) -> str:
    return text.replace("\n", "").replace("<ret>", "")


def has_runs(text: str | None, times: int = 20, least: int = 1) -> bool | None:
    """Whether any unit of `least` characters or more stands `times` times in a row or more, newlines and <ret> left out; null for
    null. In n log^2 n steps, whatever the text.

    Units are shortest ones. (Counting the longest unit of each run instead, as a rule that tries long units first does,
    never gives more than 3: a unit that stands four times is half of one that stands twice.)
    """
    return None if text is None else _has_runs(cleaned(text), times, least)


#: Texts of up to that many characters are looked through letter by letter: arrays cost more than what is done with them.
SHORT = 192


def _short_runs(t: str, times: int, least: int) -> bool:
    """_has_runs at the same places."""
    n = len(t)
    for k in range(least, n // times + 1):
        need = (times - 1) * k
        for i in range(0, n - k, need):
            if t[i] == t[i + k]:
                a, b = i, i + 1
                while a and t[a - 1] == t[a - 1 + k]:
                    a -= 1
                while b < n - k and t[b] == t[b + k]:
                    b += 1
                if b - a >= need:
                    return True
    return False


def _has_runs(t: str, times: int, least: int) -> bool:
    if len(t) < times * least:
        return False
    if len(t) <= SHORT:
        return _short_runs(t, times, least)
    code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, parts = len(code), None
    half = ((times - 1) * least + 1) // 2  # a run reaches at least half its length to one side of its place
    for i, k in probes(n, times, least):
        for side in (min(2, half), min(16, half)):
            right, left = i + k + side <= n, i >= side
            for d in range(side):
                right &= code[np.minimum(i + d, n - 1)] == code[np.minimum(i + k + d, n - 1)]
                left &= code[np.maximum(i - 1 - d, 0)] == code[np.maximum(i + k - 1 - d, 0)]
            i, k = i[right | left], k[right | left]
        if not len(i):
            continue
        parts = parts or Parts(t)
        need = (times - 1) * k
        after = parts.extent(i, i + k, np.minimum(need, n - k - i))
        before = parts.extent(i, i + k, np.minimum(need, i), back=True)
        for a, u in zip((i - before)[before + after >= need].tolist(), k[before + after >= need].tolist(), strict=True):
            if np.array_equal(code[a : a + (times - 1) * u], code[a + u : a + times * u]):
                return True
    return False


class OutOfTime(Exception):
    pass


@contextlib.contextmanager
def time_limit(seconds: float | None) -> Iterator[None]:
    """Raises OutOfTime in its body after that many seconds of the wall clock (where a signal can be had: a worker's main thread)."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise OutOfTime

    was = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, was)


def consecutive(text: Column, steps: int | None = None) -> Column:
    """has_runs of a column. With a budget of steps a text, struct(repeats, spent): a text whose length takes more steps than that
    is not searched and counts as repeating."""
    if steps is None:

        @F.pandas_udf(T.BooleanType())
        def check(xs: pd.Series) -> pd.Series:
            return pd.Series([has_runs(x) for x in xs], dtype="object")

        return check(text)

    @F.pandas_udf("repeats boolean, spent boolean")
    def limited(xs: pd.Series) -> pd.DataFrame:
        spent = [x is not None and steps_of(len(cleaned(x))) > steps for x in xs]
        return pd.DataFrame([(s or has_runs(x), s) for x, s in zip(xs, spent, strict=True)], columns=["repeats", "spent"], dtype="object")

    return limited(text)


def repeats_pattern(text: Column, times: int = 5, least: int = 5) -> Column:
    """Whether a unit of `least` characters or more stands `times` times in a row within a line (a back-reference would look for
    it in a time without bound)."""

    @F.pandas_udf(T.BooleanType())
    def check(xs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else any(_has_runs(line, times, least) for line in re.split("[\n\r\x85\u2028\u2029]", x)) for x in xs], dtype="object")

    return check(text)


def squares(t: str) -> np.ndarray:
    """At each place the longest unit that stands twice from there on (0: none). Every square of unit k covers a multiple of k, from
    which the text agrees with itself shifted by k to both sides; spans of starts are painted from the longest unit down, each
    place once."""
    if len(t) <= SHORT // 4:
        return np.array([next((k for k in range((len(t) - i) // 2, 0, -1) if t[i] == t[i + k] and t[i : i + k] == t[i + k : i + 2 * k]), 0) for i in range(len(t))], np.int64)
    parts = Parts(t)
    n = parts.n
    best, spans = np.zeros(n, np.int64), []
    for i, k in probes(n, 2):
        right = parts.extent(i, i + k, np.minimum(k, n - k - i))
        left = parts.extent(i, i + k, np.minimum(k - 1, i), back=True)
        ok = left + right >= k
        if ok.any():
            spans.append(np.unique(np.stack([k[ok], (i - left)[ok], (i + right - k)[ok]]), axis=1))
    free = list(range(n + 1))  # the next place that is not painted, by halved paths

    def next_free(x: int) -> int:
        while free[x] != x:
            free[x] = free[free[x]]
            x = free[x]
        return x

    for k, low, high in np.concatenate(spans, axis=1)[:, ::-1].T.tolist() if spans else []:
        x = next_free(low)
        while x <= high:
            best[x], free[x] = k, x + 1
            x = next_free(x + 1)
    return best


def longest_runs(text: str | None) -> list[tuple[str, int]] | None:
    """Units that stand twice or more in a row and how often, left to right, newlines and <ret> left out: at each place the longest
    such unit, then on from the end of its run. In n log^2 n steps."""
    if text is None:
        return None
    t = cleaned(text)
    best, out, i = squares(t).tolist(), [], 0
    while i < len(t):
        k, times = best[i], 1
        while k and t.startswith(t[i : i + k], i + times * k):
            times += 1
        if k:
            out.append((t[i : i + k], times))
        i += max(1, k * times)
    return out


def consecutive_runs(text: Column) -> Column:
    """Array of struct(unit, times) as of longest_runs."""

    @F.pandas_udf("array<struct<unit:string,times:int>>")
    def found(xs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"unit": u, "times": k} for u, k in longest_runs(x)] for x in xs], dtype="object")

    return found(text)


def too_many(runs: Column) -> Column:
    """Whether a run of consecutive_runs is one of 20 units or more (which 25 of 30 characters and 30 of 10 are too)."""
    return F.exists(runs, lambda r: r["times"] >= 20)
