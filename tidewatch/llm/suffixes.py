"""Suffix sorting of bounded texts, for the indexes that tasks build."""

from __future__ import annotations

import numpy as np

from tidewatch.session import send_by_value

send_by_value(__name__)


def suffix_order(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling over those not yet
    told apart. The last symbol must occur nowhere else."""
    size, n = 1, len(text)
    key = text.astype(np.uint64)
    while size < 4 and n_symbols ** (2 * size) < 1 << 63:
        shifted = np.zeros(n, np.uint64)
        shifted[:-size] = key[size:]
        key = key * np.uint64(n_symbols**size) + shifted
        size *= 2
    order = np.argsort(key)
    rank, open_ = _ranked(key[order], np.arange(n))
    ranks = np.empty(n, np.int64)
    ranks[order] = rank
    todo = order[open_]
    slots = np.flatnonzero(open_)
    while len(todo):
        after = np.zeros(len(todo), np.int64)
        inside = todo + size < n
        after[inside] = ranks[todo[inside] + size] + 1
        key = ranks[todo].astype(np.uint64) * np.uint64(n + 1) + after.astype(np.uint64)
        by = np.argsort(key)
        todo = todo[by]
        order[slots] = todo
        rank, open_ = _ranked(key[by], slots)
        ranks[todo] = rank
        todo, slots = todo[open_], slots[open_]
        size *= 2
    return order


def _ranked(sorted_keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key (the slot of the first equal one) and whether others equal it."""
    new = np.empty(len(sorted_keys), bool)
    new[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    rank = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    alone = new.copy()
    alone[:-1] &= new[1:]
    return rank, ~alone
