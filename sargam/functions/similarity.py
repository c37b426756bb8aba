"""Sequence similarities that have no built-in: Arrow-batched, worked out once per distinct pair of a batch."""

from __future__ import annotations

import difflib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity 2 M / T of two strings."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def opening_similarity(a: str, b: str, window: bool = False, least: int = 1, most: int = 12) -> float:
    """Similarity of the first n letters, n the shorter length up to ``most``; with ``window`` at any offset into a."""
    n = min(len(a), len(b), most)
    if n < least:
        return 0.0
    offsets = range(max(1, len(a) - n + 1)) if window else (0,)
    return max((ratio(a[i : i + n], b[:n]) for i in offsets), default=0.0) if n else 0.0


def block_overlap(a: str, b: str, least: int = 6, most: int = 30) -> float | None:
    """Share of the first n letters that lie in common blocks in order; null where one is shorter than ``least``."""
    n = min(len(a), len(b), most)
    if n < least:
        return None
    return sum(m.size for m in difflib.SequenceMatcher(None, a[:n], b[:n]).get_matching_blocks()) / n


def best_window(needle: str, hay: str) -> float:
    """Best similarity of the needle with a piece of the hay of its length; a shorter hay is compared once, whole."""
    if needle and needle in hay:
        return 1.0
    n = len(needle)
    return max(ratio(needle, hay[i : i + n]) for i in range(max(1, len(hay) - n + 1)))


def needle_relevance(needles: list[tuple[str, int]], hays: list[str], marked: bool, full: int = 10, few_words: int = 4) -> float:
    """Best ``best_window`` of (needle, words of its title) in the hays, rounded to 2 places.

    A needle shorter than ``full`` letters counts only where it stands unchanged, and if its title has under
    ``few_words`` words only with a marker in the hay's record.
    """
    best = 0.0
    for needle, words in needles:
        score = max((best_window(needle, h) for h in hays), default=0.0)
        if len(needle) < full and (score < 1.0 or (words < few_words and not marked)):
            score = 0.0
        best = max(best, score)
    return round(best, 2)


def _letter_bits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of letter numbers from 1 on (0 after the end): a number with a bit for the first, second, third and fourth letter of each of 16 kinds, and
    how many letters there are beyond those. Letters that share a kind count as one."""
    bits, counted = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.int64)
    for kind in range(16):
        n = np.minimum(((codes > 0) & (codes % 16 == kind)).sum(axis=1), 4)
        bits |= ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)) << np.uint64(4 * kind)
        counted += n
    return bits, (codes > 0).sum(axis=1) - counted


def best_openings(asked: list[str], lines: list[str], least: float, letters: int) -> list[tuple[int, int, float]]:
    """(place in asked, place in lines, ratio) of the line whose opening, as long as the asked text, is most like it, from ``least`` on; the first of equals.

    Every pair is tried, each in the cheapest way that decides it: by the letters that both have (bits of one number), then by the longest
    common subsequence (bits of a row, Hyyro 2004), which the matched letters of the ratio never exceed, and the ratio only while it can still be the best.
    """
    if not asked or not lines:
        return []
    if letters > 64:
        raise ValueError("openings of more than 64 letters")
    word = np.uint16 if letters <= 16 else np.uint64
    split = lambda texts: np.array([x[:letters] for x in texts], dtype=f"U{letters}").view(np.uint32).reshape(len(texts), letters)
    q, s = split(asked), split(lines)
    alphabet = np.setdiff1d(np.concatenate([q.ravel(), s.ravel()]), [0])  # sorted
    small = np.uint8 if len(alphabet) < 256 else np.uint32
    number = lambda raw: np.where(raw == 0, 0, np.searchsorted(alphabet, raw) + 1).astype(small)
    q, s = number(q), number(s)
    order = np.lexsort(s.T[::-1])  # openings of any length stand side by side
    s = s[order]
    q_bits, q_beyond = _letter_bits(q)
    lengths, found = (q > 0).sum(axis=1), []
    for n in np.unique(lengths):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:, :n] != s[:-1, :n]).any(axis=1)
        starts = np.flatnonzero(new)
        first = np.minimum.reduceat(order, starts)  # the first line of each opening
        both = n + (s[starts, :n] > 0).sum(axis=1)
        need = np.ceil(least * both / 2 - 1e-9).astype(np.uint8)
        kept = both - n >= need
        first, both, need, opening = first[kept], both[kept], need[kept], s[starts[kept], :n]
        bits, columns = _letter_bits(opening)[0], np.ascontiguousarray(opening.T)
        for at in np.flatnonzero(lengths == n):
            own_need = np.maximum(need.astype(np.int64) - q_beyond[at], 0).astype(np.uint8) if q_beyond[at] else need
            near = np.flatnonzero(np.bitwise_count(q_bits[at] & bits) >= own_need)
            places = np.zeros(len(alphabet) + 1, word)
            for k in range(n):
                places[q[at, k]] |= word(1 << k)
            full = word((1 << int(n)) - 1)
            v = np.full(len(near), full, word)
            for column in columns:
                u = v & places[column[near]]
                v = (v + u) | (v - u)
            common = int(n) - np.bitwise_count(v & full).astype(np.int64)
            fit = common >= need[near]
            near, bound = near[fit], 2.0 * common[fit] / both[near[fit]]
            best, where = 0.0, -1
            for k in np.lexsort((first[near], -bound)):
                if bound[k] < max(best, least):
                    break
                if bound[k] == best and first[near[k]] > where:
                    continue
                r = ratio(lines[first[near[k]]][:n], asked[at][:n])
                if r >= least and (r > best or r == best and first[near[k]] < where):
                    best, where = r, int(first[near[k]])
            if where >= 0:
                found.append((int(at), where, best))
    return found


def near_openings(asked: list[str], others: list[str], need: dict[int, int], letters: int, longer: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places (in asked, in others) of all pairs of an asked opening of n letters and another as long or longer (longer only, with ``longer``) whose first n
    letters have a common subsequence of ``need[n]``; none for an n without need. Every pair is tried as in ``best_openings``."""
    if letters > 64:
        raise ValueError("openings of more than 64 letters")
    word = np.uint16 if letters <= 16 else np.uint32 if letters <= 32 else np.uint64
    split = lambda texts: np.array([x[:letters] for x in texts], dtype=f"U{letters}").view(np.uint32).reshape(len(texts), letters)
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not asked or not others:
        return i[0], j[0]
    q, s = split(asked), split(others)
    alphabet = np.setdiff1d(np.concatenate([q.ravel(), s.ravel()]), [0])  # sorted
    small = np.uint8 if len(alphabet) < 256 else np.uint32
    number = lambda raw: np.where(raw == 0, 0, np.searchsorted(alphabet, raw) + 1).astype(small)
    q, s = number(q), number(s)
    lengths, s_lengths = (q > 0).sum(axis=1), (s > 0).sum(axis=1)
    q_bits, q_beyond = _letter_bits(q)
    order = np.argsort(-s_lengths, kind="stable")  # the longest first, so that those long enough are a beginning
    s, s_lengths = s[order], s_lengths[order]
    columns, bits_to, bits = np.ascontiguousarray(s.T), 0, None
    for n in np.unique(lengths):
        if int(n) not in need:
            continue
        fit = int(np.searchsorted(-s_lengths, -n, side="left" if longer else "right"))
        if bits_to < n:  # letters up to the next multiple of 4: a little more than the n compared, which loses none
            bits_to = min(letters, -(-int(n) // 4) * 4)
            bits = _letter_bits(s[:fit, :bits_to])[0]
        full = word((1 << int(n)) - 1)
        for at in np.flatnonzero(lengths == n):
            near = np.flatnonzero(np.bitwise_count(q_bits[at] & bits[:fit]) >= np.uint8(max(0, need[int(n)] - int(q_beyond[at]))))
            if not len(near):
                continue
            places = np.zeros(len(alphabet) + 1, word)
            for k in range(n):
                places[q[at, k]] |= word(1 << k)
            v = np.full(len(near), full, word)
            for column in columns[:n]:
                u = v & places[column[near]]
                v = (v + u) | (v - u)
            near = near[int(n) - np.bitwise_count(v & full).astype(np.int64) >= need[int(n)]]
            i.append(np.full(len(near), at, np.int64))
            j.append(order[near])
    return np.concatenate(i), np.concatenate(j)


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")


def opening_udf(window: bool = False, least: int = 1, most: int = 12):
    @F.pandas_udf(T.DoubleType())
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([opening_similarity(x or "", y or "", window, least, most) for x, y in zip(a, b)], dtype="float64")

    return similarity


@F.pandas_udf(T.DoubleType())
def block_overlap_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([block_overlap(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def relevance_udf(needles: pd.Series, words: pd.Series, hays: pd.Series, marked: pd.Series) -> pd.Series:
    """needles: array<string>, words: array<int>, hays: array<string>, marked: boolean."""
    return pd.Series([needle_relevance(list(zip(n, w)), list(h), bool(m)) for n, w, h, m in zip(needles, words, hays, marked)], dtype="float64")
