"""Alignment in little memory gives the path of the whole table of costs."""

import random
import tracemalloc

from chronoloom.operators.consensus import align


def table_path(a, b):
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    path, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            path.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            path.append((i, None))
        else:
            j -= 1
            path.append((None, j))
    return path[::-1]


def test_random_texts():
    draw = random.Random(4)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(0, 40))] for _ in range(2))
        assert align(a, b) == table_path(a, b)


def test_long_texts_need_little_memory():
    draw = random.Random(9)
    a = [f"w{draw.randrange(3000)}" for _ in range(20_000)]
    b = [w for w in a if draw.random() > 0.02]
    tracemalloc.start()
    path = align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    assert [i for i, _ in path if i is not None] == list(range(len(a))) and [j for _, j in path if j is not None] == list(range(len(b)))
    assert sum(i is None or j is None or a[i] != b[j] for i, j in path) <= len(a) - len(b)
