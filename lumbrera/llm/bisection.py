"""Recursive graph bisection of documents by their terms.

A set of documents is split in two halves; documents of the two sides are exchanged while that lowers the sum of deg * log2(n / (deg + 1)) over
terms and sides, an estimate of the bits of the gaps of the posting lists. Each half is split in turn. Documents that share terms end up beside
each other.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from lumbrera.llm.common import ragged

ROUNDS = 6


class Docs(NamedTuple):
    """Term numbers of all documents, one after another; each document has a term at least."""

    starts: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray


def bits(degree: np.ndarray, n: int) -> np.ndarray:
    return degree * np.log2(n / (degree + 1))


def split(docs: Docs, members: np.ndarray, n_terms: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of the two halves, and how strongly each term speaks for the first (above 0) or the second (below)."""
    lengths = docs.lengths[members]
    codes = docs.terms[ragged(docs.starts[members], lengths)]
    used = np.zeros(n_terms, bool)
    used[codes] = True
    dense = (np.cumsum(used) - 1)[codes]
    width, begins = int(used.sum()), np.cumsum(lengths) - lengths
    n = len(members)
    right = np.arange(n) >= n // 2
    n_left, n_right = n // 2, n - n // 2
    every = np.bincount(dense, minlength=width).astype(float)
    for _ in range(rounds):
        at_right = np.repeat(right, lengths)
        r = np.bincount(dense[at_right], minlength=width).astype(float)
        l = every - r  # noqa: E741
        now = bits(l, n_left) + bits(r, n_right)
        to_right = now - bits(np.maximum(l - 1, 0), n_left) - bits(r + 1, n_right)
        to_left = now - bits(l + 1, n_left) - bits(np.maximum(r - 1, 0), n_right)
        gain = np.add.reduceat(np.where(at_right, to_left[dense], to_right[dense]), begins)
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        k = min(len(a), len(b))
        k = int((gain[a[:k]] + gain[b[:k]] > 1e-9).sum())
        if not k:
            break
        right[a[:k]], right[b[:k]] = True, False
    r = np.bincount(dense[np.repeat(right, lengths)], minlength=width).astype(float)
    side = np.zeros(n_terms)
    side[used] = np.log2((every - r + 1) / n_left) - np.log2((r + 1) / n_right)
    return members[~right], members[right], side


def order(docs: Docs, n_terms: int, leaf: int) -> np.ndarray:
    """The documents in the order of the recursion, down to sets of at most ``leaf``."""
    done, todo = [], [np.arange(len(docs.starts))]
    while todo:
        members = todo.pop()
        if len(members) <= leaf:
            done.append(members)
        else:
            left, right, _ = split(docs, members, n_terms)
            todo += [right, left]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def tree(docs: Docs, n_terms: int, depth: int) -> np.ndarray:
    """A row for each inner node, in heap order: how strongly each term speaks for its first half. A last column of 0 is for other terms."""
    out = np.zeros((2**depth - 1, n_terms + 1), np.float32)
    level = [np.arange(len(docs.starts))]
    for d in range(depth):
        below = []
        for k, members in enumerate(level):
            left, right, side = split(docs, members, n_terms)
            out[2**d - 1 + k, :-1] = side
            below += [left, right]
        level = below
    return out


def leaves(nodes: np.ndarray, lengths: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The leaf of each document, from 0 and from the left: at each node its terms decide."""
    at = np.zeros(len(lengths), np.int64)
    some = np.flatnonzero(lengths)
    begins = (np.cumsum(lengths) - lengths)[some]
    depth = (len(nodes) + 1).bit_length() - 1
    for _ in range(depth):
        votes = np.zeros(len(lengths))
        if len(some):
            votes[some] = np.add.reduceat(nodes[np.repeat(at, lengths), terms], begins)
        at = 2 * at + 1 + (votes < 0)
    return at - len(nodes)
