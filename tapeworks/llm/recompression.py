"""Locally consistent parsing of word sequences by rounds of recompression.

Every round joins runs of equal symbols and pairs of a left and a right symbol (a symbol's side in a round is a bit of its
name's hash), and names what it joined by a hash of the names. Names so are global: equal word sequences get equal symbols
in their interior, in any text and any task, without a dictionary. For each symbol the range of words that decided
its shape, its context, is kept; where that range lies within a window, every other occurrence of the window has the same symbol there.
"""

from __future__ import annotations

import numpy as np

from tapeworks.llm.words import Words, mix

ROUNDS = 4
FAR = 1 << 40
NONE = np.uint64((1 << 64) - 1)


def anchors(words: Words, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of so many words of one text: the anchor that its own words choose.

    Returns the windows' first words, their anchors' names, and which window has a new anchor occurrence. An anchor is the cut between
    two symbols of the highest round whose context lies in the window (ties: smallest hash, then leftmost); its name is the hash of
    the context's words. Windows of equal words so have anchors of equal names. In round 0 every word is an anchor, so none is without.
    """
    n = len(words.hash)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    first, last = words.first[:-1][doc], words.first[1:][doc]
    windows = np.flatnonzero(np.arange(n) + window <= last) if n else np.zeros(0, np.int64)
    levels = _cuts(words, doc, rounds)
    sums = words.sums()
    best = np.full(n, NONE)
    kind = np.zeros(n, np.int64)
    spot = np.zeros(n, np.int64)
    todo = np.zeros(n, bool)
    todo[windows] = True
    bits = np.uint64(max(1, int(n).bit_length()))
    for level in range(len(levels) - 1, -1, -1):
        if not todo.any():
            break
        lo, hi = levels[level]
        open_ = np.concatenate([[0], np.cumsum(todo)])
        keep = (hi - lo <= window) & (lo >= 0) & (hi < FAR)
        lo, hi = lo[keep], hi[keep]
        keep = open_[lo + 1] > open_[np.maximum(hi - window, 0)]
        lo, hi = lo[keep], hi[keep]
        if not len(lo):
            continue
        rank = (mix(sums.of(lo, hi) + np.uint64(level)) >> bits << bits) | np.arange(len(lo), dtype=np.uint64)
        for back in range(window):
            at = lo - back
            fits = (at >= 0) & (hi <= at + window)
            at, mine = at[fits], rank[fits]
            fits = todo[at]
            np.minimum.at(best, at[fits], mine[fits])
        got = np.flatnonzero(todo & (best != NONE))
        chosen = (best[got] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        spot[got], kind[got] = lo[chosen], hi[chosen]
        todo[got] = False
    names = sums.of(spot[windows], kind[windows])
    new = np.ones(len(windows), bool)
    new[1:] = (spot[windows][1:] != spot[windows][:-1]) | (kind[windows][1:] != kind[windows][:-1])
    return windows, names, new


def _cuts(words: Words, doc: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each round, the context (first word, end) of each cut that is left; round 0 has the words themselves."""
    n = len(words.hash)
    name, start = words.hash, np.arange(n)
    lo, hi = np.arange(n), np.arange(n) + 1
    levels = [(lo, hi)]
    for k in range(1, rounds + 1):
        if len(name) < 2:
            break
        left = mix(name + np.uint64(k)) & np.uint64(1) == 0
        same = doc[start[1:]] == doc[start[:-1]]
        run = name[1:] == name[:-1]
        joined = np.concatenate([[False], same & (run | (left[:-1] & ~left[1:]))])
        inner = np.concatenate([[False], same])
        cut = np.flatnonzero(inner & ~joined)
        levels.append((np.minimum(lo[cut - 1], lo[cut]), np.maximum(hi[cut - 1], hi[cut])))
        head = np.flatnonzero(~joined)
        tail = np.concatenate([head[1:], [len(name)]]) - 1
        # a symbol's name: the names it joins, each times a power that its place in the symbol gives
        place = np.arange(len(name)) - np.repeat(head, tail - head + 1)
        fresh = np.add.reduceat(mix(name + np.uint64(0x632BE59BD9B4E019) * (place.astype(np.uint64) + np.uint64(1))), head)
        fresh = np.where(tail == head, name[head], mix(fresh + np.uint64(k)))
        wide_lo, wide_hi = np.minimum.reduceat(lo, head), np.maximum.reduceat(hi, head)
        before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, len(name) - 1)
        has_before, has_after = inner[head], np.concatenate([inner[head[1:]], [False]])
        next_lo = np.where(has_before, np.minimum(wide_lo, lo[before]), -FAR)
        next_hi = np.where(has_after, np.maximum(wide_hi, hi[after]), FAR)
        next_lo = np.where(has_after, np.minimum(next_lo, lo[after]), -FAR)
        next_hi = np.where(has_before, np.maximum(next_hi, hi[before]), FAR)
        name, start, lo, hi = fresh, start[head], next_lo, next_hi
    return levels
