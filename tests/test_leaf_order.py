import json
import random

import numpy as np

from lexmill.operators.relate import dendrogram, leaf_order, linkage


def made(n, seed):
    r = random.Random(seed)
    points = np.array([[r.random(), r.random()] for _ in range(n)])
    return np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))


def flips(d):
    """All orders of the leaves that flips of the tree give."""
    tree = {i: [[i]] for i in range(len(d))}
    for i, j, _, _ in linkage(d):
        left, right = tree[i], tree.pop(j)
        tree[i] = [a + b for a in left for b in right] + [b + a for a in left for b in right]
    return tree[0]


def length(d, order):
    return sum(d[a, b] for a, b in zip(order, order[1:]))


def test_as_short_as_any_flip():
    for n in (1, 2, 3, 5, 8):
        for seed in range(6):
            d = made(n, seed)
            order, every = leaf_order(d), flips(d)
            assert order in every and np.isclose(length(d, order), min(length(d, o) for o in every))
    assert leaf_order(np.zeros((0, 0))) == []


def test_equal_distances_and_many_leaves():
    d = np.ones((7, 7)) - np.eye(7)
    assert sorted(leaf_order(d)) == list(range(7)) and leaf_order(d) in flips(d)
    d = made(200, 1)
    order = leaf_order(d)
    assert sorted(order) == list(range(200)) and length(d, order) < length(d, flips_first(d))


def flips_first(d):
    tree = {i: [i] for i in range(len(d))}
    for i, j, _, _ in linkage(d):
        tree[i] = tree[i] + tree.pop(j)
    return tree[0]


def test_the_tree_shows_its_leaves_in_that_order():
    d = made(9, 4)

    def leaves(node):
        return [node["name"]] if "name" in node else [x for c in node["children"] for x in leaves(c)]

    assert leaves(json.loads(dendrogram(d, [f"n{i}" for i in range(9)]))) == [f"n{i}" for i in leaf_order(d)]
    assert json.loads(dendrogram(d[:1, :1], ["x"])) == {"name": "x"} and dendrogram(d[:0, :0], []) == "{}"
