"""T-occurrence search over inverted lists with DivideSkip."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np

#: Weight of the cost of a binary probe against a heap step, for the number of long lists.
MU = 0.0085
#: Lists of at most so many records are always merged: a probe would cost more than their heap steps.
SHORT = 16


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(record, occurrences) for the records in at least ``least`` of the sorted ``lists``.

    A heap holds the front of each list. If the smallest record has too few occurrences, fronts are
    popped until ``least - 1`` are out, and their lists jump to the record then on top.
    """
    if least <= 0 or len(lists) < least:
        return
    at = [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= least:
        record, out = heap[0][0], []
        while heap and heap[0][0] == record:
            out.append(heapq.heappop(heap)[1])
        if len(out) >= least:
            yield record, len(out)
            target = record + 1
        else:
            while heap and len(out) < least - 1:
                out.append(heapq.heappop(heap)[1])
            if not heap:
                return
            target = heap[0][0]
        for i in out:
            at[i] = bisect_left(lists[i], target, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


def divide_skip(lists: Sequence[Sequence[int] | np.ndarray], least: int, mu: float = MU) -> Iterator[tuple[int, int]]:
    """(record, occurrences) for the records in at least ``least`` of the sorted ``lists``."""
    records, counts = divide_skip_arrays([np.asarray(x, dtype=np.int64) for x in lists], least, mu)
    return zip(records.tolist(), counts.tolist(), strict=True)


def divide_skip_arrays(lists: list[np.ndarray], least: int, mu: float = MU) -> tuple[np.ndarray, np.ndarray]:
    """Records in at least ``least`` of the sorted ``lists``, and in how many.

    The short lists are merged by a heap, to the records that reach ``least`` if all long lists hold
    them; the long lists are probed for these by binary search, and records that can't reach it any
    more drop out on the way.
    """
    none = np.zeros(0, np.int64)
    if least <= 0 or len(lists) < least:
        return none, none
    by_length = sorted(lists, key=len)
    n_long = min(least - 1, int(least / (mu * math.log2(max(2, len(by_length[-1]))) + 1)), sum(len(x) > SHORT for x in by_length))
    cut = len(lists) - n_long
    found = list(merge_skip([x.tolist() for x in by_length[:cut]], least - n_long))
    if not found:
        return none, none
    records, counts = (np.array(c, dtype=np.int64) for c in zip(*found, strict=True))
    for k, x in enumerate(by_length[cut:]):
        may = counts + (n_long - k) >= least
        if not may.all():
            records, counts = records[may], counts[may]
        if not len(records):
            break
        p = np.searchsorted(x, records)
        counts = counts + (x[np.minimum(p, len(x) - 1)] == records)
    reach = counts >= least
    return records[reach], counts[reach]
