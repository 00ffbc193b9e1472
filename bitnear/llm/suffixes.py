"""Suffix arrays by prefix doubling, over arrays of symbols with separators."""

import numpy as np


def first_ranks(symbols: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Ranks of single symbols. Separators come first and all differ, by place, so no two suffixes agree across one."""
    rank = np.empty(len(symbols), np.int64)
    n = int(separator.sum())
    rank[separator] = np.arange(n)
    _, order = np.unique(symbols[~separator], return_inverse=True)
    rank[~separator] = n + order
    return rank


def suffix_ranks(symbols: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """The rank of each suffix; the text must end with a separator."""
    rank, n, width = first_ranks(symbols, separator), len(symbols), 1
    while n:
        if rank.max() == n - 1 and width > 1:
            break
        behind = np.zeros(n, np.int64)
        behind[:-width or None] = rank[width:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        width *= 2
    return rank


def window_order(symbols: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, borders): the suffixes at the places, sorted by their first `width` symbols, all within the array; borders
    are where a suffix differs from the one before it. This is the suffix array, or the suffix tree, cut at that depth.

    As many symbols as fit are packed into a word, and the ranks of words of two or three times the width are made from
    ranks of words, until two that overlap make up the width.
    """
    there = np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
    there[symbols] = 1
    code = (np.cumsum(there) - 1)[symbols]
    bits = max(1, int(there.sum() - 1).bit_length())
    have = max(1, min(62 // bits, width))
    rank = code[: len(code) - have + 1].copy()
    for j in range(1, have):
        rank = (rank << bits) | code[j : len(code) - have + 1 + j]
    while 2 * have < width:
        _, rank = np.unique(rank, return_inverse=True)
        n, step = int(rank.max(initial=0)) + 1, have
        times = 3 if 3 * have <= width and n < 1 << 20 else 2
        size = len(rank) - (times - 1) * step
        key = rank[:size]
        for j in range(1, times):
            key = key * n + rank[j * step : j * step + size]
        rank, have = key, times * have
    if have < width:
        _, rank = np.unique(rank, return_inverse=True)
        key = rank[places] * (int(rank.max(initial=0)) + 1) + rank[places + width - have]
    else:
        key = rank[places]
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
