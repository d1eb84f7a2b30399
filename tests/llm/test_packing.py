from __future__ import annotations

import random
from collections import Counter, defaultdict

from tidewell.llm.packing import Remaining, pack, plan_bins


def _brute(sizes: list[int], capacity: int) -> list[int]:
    bins: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(bins) if r >= s]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


def test_tree_finds_the_tightest():
    tree = Remaining(20)
    assert tree.tightest(0) == -1
    for r in (3, 9, 20):
        tree.add(r, 1)
    assert [tree.tightest(k) for k in (0, 3, 4, 10, 20)] == [3, 3, 9, 20, 20]
    tree.add(20, -1)
    assert tree.tightest(10) == -1


def test_plan_equals_best_fit_decreasing():
    for seed in range(150):
        random.seed(seed)
        capacity = random.choice([1, 7, 20, 64, 100])
        sizes = [random.randint(1, capacity) for _ in range(random.randint(0, 150))]
        fill: Counter = Counter()
        for size, _, n, low, each in plan_bins(list(Counter(sizes).items()), capacity):
            for k in range(n):
                fill[low + k // each] += size
        assert sorted(capacity - v for v in fill.values()) == _brute(sizes, capacity)


def test_pack_places_every_token_once(spark):
    random.seed(3)
    sizes = {k: random.choice([0, 1, 5, 5, 5, 30, 64, 65, 128, 300]) for k in range(400)}
    rows = [(k, v, "x") for k, v in sizes.items()] + [(1000, None, "x"), (None, 9, "x")]
    items = spark.createDataFrame(rows, "id int, n int, container string")
    caps = spark.createDataFrame([("a", 64), ("a", 64), ("b", 100), ("none", None), ("zero", 0)], "pack_name string, capacity_tokens int")
    got = pack(items, caps, "id", "n", salts=3).collect()
    for name, capacity in (("a", 64), ("b", 100)):
        mine, bins = defaultdict(list), Counter()
        for r in got:
            if r.pack_name == name:
                mine[r.id].append((r.start, r.length))
                bins[r.container] += r.length
        assert {k for k, v in sizes.items() if v} == set(mine) and max(bins.values()) <= capacity
        for k, parts in mine.items():
            ends = 0
            for start, length in sorted(parts):
                assert start == ends
                ends += length
            assert ends == sizes[k] and (len(parts) == 1 or sizes[k] > capacity)
        rest = [v % capacity or capacity for v in sizes.values() if v and (v % capacity or v == capacity)]
        whole = [r for r in got if r.pack_name == name and r.container.startswith("bin")]
        assert len({r.container for r in whole}) == len(_brute(rest, capacity))
    assert {r.pack_name for r in got} == {"a", "b"}
    assert pack(items.limit(0), caps, "id", "n").count() == 0
    assert pack(items, caps.limit(0), "id", "n").count() == 0
