"""Two-stage suffix sorting in numpy, to a bounded depth, of chosen positions of one byte text.

A suffix is of kind B if it is smaller than its successor (the suffix that starts one byte later), else of kind A. Only B suffixes are sorted
directly, eight bytes at a time. A suffixes are induced: scanning the buckets of first bytes upwards, the predecessor of each suffix
met, if of kind A, is next in the bucket of its own first byte. Within a bucket, A suffixes come before B suffixes.
"""

from __future__ import annotations

import numpy as np

PAD = 64


def words_at(text: np.ndarray, kind: str = ">u8") -> np.ndarray:
    """The eight bytes at each position as an unaligned view (big-endian: in the order of the bytes)."""
    return np.ndarray((len(text) - 7,), kind, text.data, strides=(1,))


def kinds(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of kind A (larger than its successor); runs of equal bytes take the kind of their end."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    end = np.append(change, n - 1)
    down = np.append(text[change] > text[change + 1], True)  # the last run ends the text, and the empty suffix is smallest
    return np.repeat(down, np.diff(np.append(-1, end)))


def _sort_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    words = words_at(text)
    if not len(at):
        return at
    key = words[at].astype(np.uint64)
    order = np.argsort(key)
    at, key = at[order], key[order]
    group = np.cumsum(np.append(False, key[1:] != key[:-1]))
    tied = np.arange(len(at))
    for offset in range(8, depth, 8):
        g = group[tied]
        alike = np.zeros(len(tied), bool)
        alike[1:] = g[1:] == g[:-1]
        alike[:-1] |= alike[1:]
        tied, g = tied[alike], g[alike]
        if not len(tied):
            break
        own = at[tied]
        key = words[own + offset].astype(np.uint64)
        order = np.lexsort((key, g))
        own, key = own[order], key[order]
        at[tied] = own
        split = np.append(False, (key[1:] != key[:-1]) & (g[1:] == g[:-1]))
        # a finer group is told apart by its first place
        first = np.append(True, (g[1:] != g[:-1]) | split[1:])
        group[tied] = np.repeat(tied[first], np.diff(np.append(np.flatnonzero(first), len(tied))))
    return at


def sorted_suffixes(text: np.ndarray, chosen: np.ndarray, depth: int = 50) -> np.ndarray:
    """The chosen positions (a mask) in the order of their suffixes, as far as their first ``depth`` bytes tell. text ends with PAD zeros."""
    kind_a = kinds(text)
    # an A suffix needs its successors as far as the next B suffix
    need = chosen.copy()
    edge = np.flatnonzero(kind_a[1:] != kind_a[:-1]) + 1
    starts = np.append(0, edge)
    ends = np.append(edge, len(text))
    runs = kind_a[starts]
    starts, ends = starts[runs], ends[runs]
    wanted = np.flatnonzero(chosen & kind_a)
    if len(wanted):
        opens = np.zeros(len(text), np.int32)
        opens[starts] = 1
        run = np.cumsum(opens, dtype=np.int32)[wanted] - 1
        first = np.append(True, run[1:] != run[:-1])
        begin, run = wanted[first], run[first]
        stop = np.minimum(ends[run], len(text) - 1)
        cover = np.zeros(len(text) + 1, np.int32)
        cover[begin] += 1
        cover[stop + 1] -= 1
        need |= np.cumsum(cover[:-1]) > 0
    induce = need & kind_a
    last = len(text) - PAD // 2  # the padding at the end is one run of kind A: its suffixes are smallest, the shortest first
    tail = np.flatnonzero(need[last:] & kind_a[last:]) + last
    direct = _sort_directly(text, np.flatnonzero(need[: len(text) - PAD // 2] & ~kind_a[: len(text) - PAD // 2]), depth)
    heads = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if len(tail):
        waiting[0].append(tail[::-1][:1])  # the shortest is known; the others follow from it
    out = []
    for c in range(256):
        found = []
        front = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        waiting[c] = []
        while len(front):
            found.append(front)
            before = front[front > 0] - 1
            front = before[induce[before] & (text[before] == c)]
        here = np.concatenate([*found, direct[heads[c] : heads[c + 1]]])
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0] - 1
        before = before[induce[before] & (text[before] > c)]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cut = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for part in np.split(before, cut):
                waiting[int(text[part[0]])].append(part)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[chosen[order]]


def share_prefix(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place but the first: whether the suffix and the one before it share their first ``length`` (8 or more) bytes."""
    words = words_at(text, "<u8")
    same = np.arange(1, len(order))
    for offset in [*range(0, length - 7, 8), length - 8]:
        same = same[words[order[same] + offset] == words[order[same - 1] + offset]]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[same - 1] = True
    return out
