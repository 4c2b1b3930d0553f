"""Suffix sorting in numpy, for many short sequences laid end to end."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, ends: np.ndarray, depth: int, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane refinement: order all suffixes by their first `depth` symbols.

    symbols: integers laid end to end; ends: each position's sequence end (exclusive). A suffix stops at the end of its sequence. Returns (order, group): the positions sorted,
    and for each position the number of its group; suffixes that agree on `depth` symbols, or to the end
    of both, share one. Only groups with two or more members are sorted again when the depth doubles.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    first = np.empty(n, bool)
    first[0] = True
    s = symbols[order]
    first[1:] = s[1:] != s[:-1]
    starts = np.flatnonzero(first)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    h = width
    size = np.diff(np.append(starts, n))
    live = np.repeat(size > 1, size)  # by place in order
    while h < depth and live.any():
        places = np.flatnonzero(live)
        pos = order[places]
        ahead = pos + h
        inside = ahead < ends[pos]
        second = np.where(inside, group[np.minimum(ahead, n - 1)] + 1, 0)
        own = group[pos]
        by = np.lexsort((second, own))
        pos, own, second = pos[by], own[by], second[by]
        order[places] = pos
        new = np.empty(len(pos), bool)
        new[0] = True
        new[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(pos)))
        group[pos] = np.repeat(places[head], count)
        live[places] = np.repeat(count > 1, count)
        h *= 2
    return order, group


def kasai(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of neighbours in `order`, up to `limit`: out[i] is that of order[i-1] and order[i].

    Kasai's walk: from one position of a sequence to the next the common prefix with the left neighbour
    shrinks by one symbol at most. Of each sequence the first `walk` positions are walked (the rest of out
    stays 0). The sequences (starts, ends) are walked side by side, one numpy lane
    each, so a step costs one vector operation for all of them.
    """
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    end_of = np.repeat(ends, ends - starts)
    by = np.argsort(-walk, kind="stable")  # longest first: finished lanes fall off the end
    lane_start, lane_end = starts[by], ends[by]
    length = walk[by]
    h = np.zeros(len(by), np.int64)
    alive = len(by)
    for step in range(int(length[0]) if len(by) else 0):
        while alive and length[alive - 1] <= step:
            alive -= 1
        i = lane_start[:alive] + step
        at = place[i]
        has = at > 0
        j = order[np.maximum(at - 1, 0)]
        most = np.minimum(np.minimum(lane_end[:alive] - i, end_of[j] - j), limit)
        most[~has] = 0
        k = np.minimum(h[:alive], most)
        go = np.flatnonzero(k < most)
        while len(go):
            a = k[go]
            same = symbols[i[go] + a] == symbols[j[go] + a]
            go = go[same]
            k[go] += 1
            go = go[k[go] < most[go]]
        out[at] = k
        h[:alive] = np.maximum(k - 1, 0)
    return out
