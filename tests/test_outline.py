"""Rings of cells against a walk along the boundary in plain Python."""

import numpy as np
import pytest

from rasterloom.operators import outline as O


def rings_of(cells):
    """Rings by walking unit edges, turning right where there is a choice; corners only."""
    ahead = {}
    for r, c in cells:
        for near, a, b in (((r - 1, c), (c, r), (c + 1, r)), ((r, c + 1), (c + 1, r), (c + 1, r + 1)), ((r + 1, c), (c + 1, r + 1), (c, r + 1)), ((r, c - 1), (c, r + 1), (c, r))):
            if near not in cells:
                ahead.setdefault(a, []).append(b)
    out = []
    while ahead:
        first = min(ahead, key=lambda p: (p[1], p[0]))
        at, way, corners = first, None, []
        while True:
            to = ahead[at]
            turn = lambda b: 0 if way is None else way[0] * (b[1] - at[1]) - way[1] * (b[0] - at[0])  # noqa: E731, B023
            b = max(to, key=turn)
            to.remove(b)
            if not to:
                del ahead[at]
            now = (b[0] - at[0], b[1] - at[1])
            if now != way:
                corners.append(at)
            at, way = b, now
            if at == first and (first not in ahead or len(corners) > 2):
                break
        out.append(tuple(corners))
    return sorted(out)


def cells_of(*lines):
    return {(r, c) for r, line in enumerate(lines) for c, x in enumerate(line) if x == "#"}


SHAPES = {
    "one": cells_of("#"), "bar": cells_of("####"), "L": cells_of("#..", "#..", "###"), "hole": cells_of("#####", "#...#", "#.#.#", "#...#", "#####"), "corner": cells_of("##..", "##..", "..##", "..##"),
}


def got(spark, shapes, tolerance=0.0):
    rows = [(k, r, c) for k, s in shapes.items() for r, c in s] + [(k, r, c) for k, s in shapes.items() for r, c in list(s)[:2]]
    out = O.outline(spark.createDataFrame(rows, "scene_id string, r int, c int").repartition(3), ["scene_id"], tolerance).collect()
    return {k: sorted((tuple((p.x, p.y) for p in r.points), r.area, r.hole) for r in out if r.scene_id == k) for k in shapes}


def test_known_shapes(spark):
    g = got(spark, SHAPES)
    for k, s in SHAPES.items():
        assert [x[0] for x in g[k]] == rings_of(s), k
        assert sum(x[1] for x in g[k]) == len(s)
    assert [x[2] for x in g["hole"]] == [False, True, False] and len(g["corner"]) == 2 and g["L"][0][0] == ((0, 0), (1, 0), (1, 2), (3, 2), (3, 3), (0, 3))


def test_random_masks(spark):
    r = np.random.default_rng(4)
    shapes = {f"m{k}": set(zip(*(x.tolist() for x in np.nonzero(r.random((14, 17)) < p)), strict=True)) for k, p in enumerate((0.2, 0.5, 0.75))}
    g = got(spark, shapes)
    for k, s in shapes.items():
        assert sum(x[1] for x in g[k]) == len(s)
        assert [x[0] for x in g[k]] == rings_of(s), k


def test_simplified_rings(spark):
    stairs = {(r, c) for r in range(12) for c in range(r + 1)}
    whole, less = got(spark, {"s": stairs})["s"], got(spark, {"s": stairs, "one": SHAPES["one"]}, 0.75)
    assert 4 <= len(less["s"][0][0]) < len(whole[0][0]) / 2 and less["s"][0][1] == len(stairs)
    assert less["one"][0][0] == ((0, 0), (1, 0), (1, 1), (0, 1))


def test_degrees(spark):
    rings = O.outline(spark.createDataFrame([(1, 0, 0)], "scene_id int, r int, c int"), ["scene_id"])
    p = O.geographic(rings, 0.0, 0.0, 100_000.0, 6_371_007.181).first().points
    assert p[0].lat == 0 and p[2].lat == pytest.approx(-0.8993, abs=1e-3) and p[2].lon > 0
