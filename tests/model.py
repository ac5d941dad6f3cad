"""An independent model of the algebra in plain Python, and small golden graphs."""

import itertools


def msb(x):
    return x.bit_length() - 1 if x > 1 else 0


def plus(x, y):
    return y if x == 0 else x if y == 0 else min(x, y)


def times(x, y):
    if x < -1 or y < -1:
        raise ValueError("undefined")
    if x == 0 or y == 0:
        return 0
    if x in (-1, 1) and y in (-1, 1):
        return x if x == y else 0
    if x in (-1, 1):
        return y
    if y in (-1, 1):
        return x if x % 2 == (0 if y == -1 else 1) else 0
    return int(bin(x)[2:] + bin(y)[3:], 2)


def matmul(a, b):
    out = [[0] * len(b[0]) for _ in a]
    for i, j, k in itertools.product(range(len(a)), range(len(b[0])), range(len(b))):
        out[i][j] = plus(out[i][j], times(a[i][k], b[k][j]))
    return out


def close(a):
    """Fixpoint by Floyd-Warshall; the diagonal stays as it is."""
    r = [row[:] for row in a]
    n = len(r)
    for k, i, j in itertools.product(range(n), range(n), range(n)):
        p = times(r[i][k], r[k][j])
        if i == j:
            if p not in (-1, 0, 1):
                raise ArithmeticError("cycle")
        else:
            r[i][j] = plus(r[i][j], p)
    return r


# Small graphs and their closures.
N5 = [[-1, 2, 3, 0, 0], [0, -1, 0, 2, 0], [0, 0, 1, 0, 0], [0, 0, 0, -1, 0], [2, 0, 0, 0, 1]]
N5_CLOSED = [[-1, 2, 3, 4, 0], [0, -1, 0, 2, 0], [0, 0, 1, 0, 0], [0, 0, 0, -1, 0], [2, 4, 5, 8, 1]]
C7 = [
    [-1, 0, 0, 2, 0, 3, 0],
    [0, -1, 0, 0, 0, 0, 0],
    [2, 0, 1, 0, 0, 0, 0],
    [0, 0, 0, -1, 0, 0, 0],
    [0, 2, 0, 0, -1, 0, 3],
    [0, 0, 0, 0, 0, 1, 0],
    [0, 0, 0, 0, 0, 0, 1],
]
C7_COMPONENTS = [0, 1, 0, 0, 1, 0, 1]
C7_CANONICAL = [2, 0, 3, 5, 4, 1, 6]
D4 = [[1, 2, 4, 0], [0, 1, 4, 0], [0, 0, 1, 8], [0, 0, 0, 1]]
D4_CLOSED = [[1, 2, 4, 32], [0, 1, 4, 32], [0, 0, 1, 8], [0, 0, 0, 1]]
T7_EDGES = [(0, 1, 2), (0, 2, 3), (1, 5, 2), (1, 6, 3), (2, 3, 2), (2, 4, 3)]
T7_ROW = {1: 2, 2: 3, 3: 6, 4: 7, 5: 4, 6: 5}


def cells(a):
    return {(i, j): v for i, row in enumerate(a) for j, v in enumerate(row) if v}


def collected(df):
    return {(r["i"], r["j"]): r["v"] for r in df.collect()}


def random_graph(rng, n, density=0.35):
    """Random parents with smaller ids: edges of 2 and 3, one of each."""
    a = [[0] * n for _ in range(n)]
    for i in range(n):
        a[i][i] = rng.choice((-1, 1))
    for i in range(1, n):
        for v, color in ((2, -1), (3, 1)):
            parents = [j for j in range(i) if a[j][j] == color]
            if parents and rng.random() < density * 2:
                a[i][rng.choice(parents)] = v
    return a

# Ten vertices in two components, as cells, and what their closure adds.
C10_COLORS = [-1, 1, -1, 1, 1, -1, 1, -1, 1, -1]
C10_EDGES = [(0, 4, 3), (0, 5, 2), (2, 0, 2), (2, 1, 3), (3, 7, 2), (3, 8, 3), (4, 6, 3), (5, 9, 2)]
C10_ADDED = {(0, 6): 7, (0, 9): 4, (2, 4): 5, (2, 5): 4, (2, 6): 11, (2, 9): 8}
C10_COMPONENTS = [0, 0, 0, 1, 0, 0, 0, 1, 1, 0]
# The closure N5 with a sibling of vertex 4, then with a mother of vertex 1.
RC5_SIBLING = {(5, 0): 2, (5, 1): 4, (5, 2): 5, (5, 3): 8, (5, 5): -1}
RC5_MOTHER = {(0, 6): 5, (1, 6): 3, (4, 6): 9, (5, 6): 9, (6, 6): 1}
