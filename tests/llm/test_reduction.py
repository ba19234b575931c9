"""Fixed sets never raise the least number of sequences."""

import random
from collections import Counter
from functools import lru_cache

from dagstore.llm.packing import Plan, reduce_instance


@lru_cache(None)
def least(items, capacity):
    """By trying every set of items that can stand with the largest."""
    if not items:
        return 0
    best = len(items)

    def fill(room, k, rest):
        nonlocal best
        best = min(best, 1 + least(tuple(rest) + items[k:], capacity))
        for i in range(k, len(items)):
            if items[i] <= room and (i == k or items[i] != items[i - 1]):
                fill(room - items[i], i + 1, rest + list(items[k:i]))

    fill(capacity - items[0], 1, [])
    return best


def reduced(items):
    """Sequences fixed, and those needed at least with the rest."""
    plan = Plan(Counter(items), 52)
    n = reduce_instance(plan)
    return n, n + least(tuple(sorted((s for s, c in plan.left.items() for _ in range(c)), reverse=True)), 52)


def test_two_items_between_may_fit():
    items = (25, 23, 20, 20, 19, 16, 14, 13)
    assert least(items, 52) == 3
    assert reduced(items)[1] == 3


def test_reduction_keeps_the_optimum():
    r = random.Random(1)
    fixed = 0
    for _ in range(1500):
        items = tuple(sorted((r.randrange(10, 27) for _ in range(r.randrange(4, 10))), reverse=True))
        n, needed = reduced(items)
        fixed += n
        assert needed == least(items, 52), items
    assert fixed
