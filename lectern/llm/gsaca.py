"""Suffix arrays by linear grouping construction, for many strings at once.

Phase 1 takes the groups of suffixes in descending order. A group's suffixes share a Lyndon prefix; each points to the
nearest suffix on its left that stands in a smaller group (its previous smaller one), and those, split by how many of the
group point to them, move to new groups right above their old ones. Phase 2 reads the array from the smallest suffix on:
the suffix one place to the left, and what its pointers lead to, take the next free places of their groups. Neither phase
sorts or renames anything again. All strings advance together, one group or place a step, as rows of flat numpy arrays.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(strings, longest) suffix arrays of the rows of `text`, padded with -1.

    text: (strings, longest) small positive integers; row k has lengths[k] of them, the last one being 0, which stands
    nowhere else in it.
    """
    rows, width = text.shape
    live = np.arange(width) < lengths[:, None]
    # Groups by first character; a group is named by its first place in the array.
    code = np.where(live, text, 256).astype(np.int16)
    order = np.argsort(code, axis=1, kind="stable")
    ranked = np.take_along_axis(code, order, axis=1)
    new = np.ones((rows, width), bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    start = np.maximum.accumulate(np.where(new, np.arange(width), 0), axis=1)
    group = np.empty((rows, width), np.int32)
    np.put_along_axis(group, order, start.astype(np.int32), axis=1)
    group[~live] = -9
    group = group.ravel()
    base = np.arange(rows) * width
    last = np.ones((rows, width), bool)
    last[:, :-1] = new[:, 1:]
    start_of_end, end_of_start = np.zeros(rows * width, np.int32), np.zeros(rows * width, np.int32)
    k, e = np.nonzero(last)
    start_of_end[k * width + e] = start[k, e]
    end_of_start[k * width + start[k, e]] = e
    before = np.full(rows * width, -1, np.int32)
    cur = start_of_end[base + lengths - 1].astype(np.int32)
    active = np.arange(rows)
    table = group.reshape(rows, width)
    while len(active):
        if len(active) == rows:
            hit = np.flatnonzero(table == cur[:, None])
        else:
            k, i = np.nonzero(table[active] == cur[active][:, None])
            hit = active[k] * width + i
        row = hit // width
        mine = cur[row]
        # Previous smaller: step left, jumping over groups above by their own pointers.
        at = (hit - base[row]).astype(np.int64) - 1
        todo = np.flatnonzero(at >= 0)
        while len(todo):
            j = base[row[todo]] + at[todo]
            g = group[j]
            up = g >= mine[todo]
            todo, j, g = todo[up], j[up], g[up]
            at[todo] = np.where(g > mine[todo], before[j], at[todo] - 1)
            todo = todo[at[todo] >= 0]
        before[hit] = at
        ok = at >= 0
        if ok.any():
            parent, times = np.unique(base[row[ok]] + at[ok], return_counts=True)
            prow, pg = parent // width, group[parent]
            key = (prow * width + pg) * (width + 1) + times
            by = np.argsort(key, kind="stable")
            parent, prow, pg, times = parent[by], prow[by], pg[by], times[by]
            n = len(parent)
            new_group = np.ones(n, bool)
            new_group[1:] = (prow[1:] != prow[:-1]) | (pg[1:] != pg[:-1])
            new_set = new_group.copy()
            new_set[1:] |= times[1:] != times[:-1]
            g_at = np.flatnonzero(new_group)
            g_size = np.diff(np.append(g_at, n))
            g_of = np.cumsum(new_group) - 1
            s_at = np.flatnonzero(new_set)
            s_size = np.diff(np.append(s_at, n))
            s_of = np.cumsum(new_set) - 1
            slot = prow[g_at] * width + pg[g_at]
            end = end_of_start[slot]
            # Sets with more pointers stand higher; the highest ends where the old group ended.
            s_start = end[g_of[s_at]] + 1 - (g_at[g_of[s_at]] + g_size[g_of[s_at]] - s_at)
            s_end = s_start + s_size - 1
            group[parent] = s_start[s_of]
            rest_end = end - g_size
            some = rest_end >= pg[g_at]
            end_of_start[slot[some]] = rest_end[some]
            start_of_end[prow[g_at][some] * width + rest_end[some]] = pg[g_at][some]
            r = prow[s_at] * width
            end_of_start[r + s_start] = s_end
            start_of_end[r + s_end] = s_start
        active = active[cur[active] > 0]
        nxt = np.full(rows, -5, np.int32)
        nxt[active] = start_of_end[base[active] + cur[active] - 1]
        cur = nxt
    out = np.full(rows * width, -1, np.int64)
    out[base] = lengths - 1
    free_at = np.zeros(rows * width, np.int32)  # by a group's first place: how many of its places are taken
    placed = np.zeros(rows * width, bool)
    placed[base + lengths - 1] = True
    for i in range(width):
        row = np.flatnonzero(lengths > i)
        if not len(row):
            break
        j = out[base[row] + i] - 1
        while True:
            ok = j >= 0
            row, j = row[ok], j[ok]
            spot = base[row] + j
            ok = ~placed[spot]
            row, j, spot = row[ok], j[ok], spot[ok]
            if not len(row):
                break
            g = base[row] + group[spot]
            out[g + free_at[g]] = j
            free_at[g] += 1
            placed[spot] = True
            j = before[spot].astype(np.int64)
    return out.reshape(rows, width)
