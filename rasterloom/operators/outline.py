"""Outlines of the cells that a scene holds: boundary runs linked into rings, holes included, and simplified.

A cell (r, c) covers x from c to c + 1 and y from r to r + 1. The sides at which it has no neighbour are
directed so that the cell lies to the right; sides in a line make a run, found line by line. Each run has
one successor, so rings are the cycles of a table of links. Pointer doubling finds the smallest run of each cycle and
how far every run is from it in as many rounds as the longest ring has binary digits; no ring is walked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.storage import checkpointed, discard

#: Headings of runs, clockwise.
EAST, SOUTH, WEST, NORTH = range(4)
#: Coordinates are below this.
SPAN = 1 << 24


def boundary_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, heading, x0, y0, x1, y1): the maximal straight runs of the boundary of cells(keys, r, c), with the cells to their right."""
    cells = cells.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    row, column = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")
    lacks = lambda f, k, w, d: F.coalesce(f(k).over(w) != F.col(k) + d, F.lit(True))
    sides = cells.withColumns({"north": lacks(F.lag, "r", column, -1), "south": lacks(F.lead, "r", column, 1), "west": lacks(F.lag, "c", row, -1), "east": lacks(F.lead, "c", row, 1)})

    def side(when: str, heading: int, line: Column, at: Column) -> Column:
        return F.when(F.col(when), F.struct(F.lit(heading).alias("heading"), line.alias("line"), at.alias("at")))

    r, c = F.col("r"), F.col("c")
    edges = F.array_compact(F.array(side("north", EAST, r, c), side("east", SOUTH, c + 1, r), side("south", WEST, r + 1, c), side("west", NORTH, c, r)))
    edges = sides.select(*keys, F.explode(edges).alias("e")).select(*keys, "e.*")
    place = F.row_number().over(Window.partitionBy(*keys, "heading", "line").orderBy("at"))
    runs = edges.withColumn("island", F.col("at") - place).groupBy(*keys, "heading", "line", "island").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("b"))
    begin, end = (F.when(F.col("heading").isin(EAST, SOUTH), F.col(p)).otherwise(F.col(q)) for p, q in (("a", "b"), ("b", "a")))
    flat = F.col("heading").isin(EAST, WEST)
    return runs.select(*keys, "heading", F.when(flat, begin).otherwise(F.col("line")).alias("x0"), F.when(flat, F.col("line")).otherwise(begin).alias("y0"),
                       F.when(flat, end).otherwise(F.col("line")).alias("x1"), F.when(flat, F.col("line")).otherwise(end).alias("y1"))


def ring_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs with ring (the number of the ring's first run) and back (how many runs lead from a run to that first one).

    Where cells touch at a corner only, a run turns right, so that the cells stay apart.
    """
    number = F.col("y0") * (4 * SPAN) + F.col("x0") * 4 + F.col("heading")
    runs = checkpointed(runs.withColumn("run", number), "runs")
    starts = runs.select(*keys, F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("heading").alias("_to"), F.col("run").alias("next"))
    right = (F.col("_to") == (F.col("heading") + 1) % 4).cast("int")
    met = runs.select(*keys, "run", "heading", "x1", "y1").join(starts.hint("merge"), [*keys, "x1", "y1"])
    links = met.groupBy(*keys, "run").agg(F.max_by("next", right).alias("next"))
    # jump is the run 2^k steps on; low the smallest run among as many, and far its distance.
    state = links.select(*keys, "run", F.col("next").alias("jump"), F.col("run").alias("low"), F.lit(0).cast("long").alias("far"))
    step, former = 1, []
    state = checkpointed(state, "ring-links")
    while True:
        ahead = state.select(*keys, F.col("run").alias("jump"), F.col("jump").alias("_jump"), F.col("low").alias("_low"), F.col("far").alias("_far"))
        nearer = F.col("_low") < F.col("low")
        both = state.join(ahead.hint("merge"), [*keys, "jump"])
        grown = both.select(*keys, "run", F.col("_jump").alias("jump"), F.when(nearer, F.col("_low")).otherwise(F.col("low")).alias("low"),
                            F.when(nearer, F.col("_far") + step).otherwise(F.col("far")).alias("far"), nearer.alias("_new"))
        grown = checkpointed(grown, "ring-links")
        discard(state, *former)
        state, step, former = grown.drop("_new"), 2 * step, [grown]
        # Windows that lie side by side share their smallest run only when they cover the ring.
        if not grown.where("_new").limit(1).count():
            break
    return runs.join(state.select(*keys, "run", F.col("low").alias("ring"), F.col("far").alias("back")).hint("merge"), [*keys, "run"])


def simplified(vertices: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """vertices(keys, ring, place, x, y) without those whose triangle with both neighbours is under tolerance, smallest first.

    Every round drops vertices that are smaller than their neighbours, so that no two beside each other go at once; rings keep four at least.
    """
    ring = Window.partitionBy(*keys, "ring").orderBy("place")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while True:
        beside = lambda c, f, g: F.coalesce(f(c).over(ring), g(c).over(whole))
        v = vertices.select(*keys, "ring", "place", "x", "y").withColumns({f"{n}_{c}": beside(c, f, g) for n, f, g in (("p", F.lag, F.last), ("n", F.lead, F.first)) for c in ("x", "y")})
        area = F.abs((F.col("x") - F.col("p_x")) * (F.col("n_y") - F.col("p_y")) - (F.col("n_x") - F.col("p_x")) * (F.col("y") - F.col("p_y"))) / 2.0
        v = v.withColumn("size", F.struct(area.alias("a"), F.col("place").alias("i")))
        v = v.withColumns({"before": beside("size", F.lag, F.last), "after": beside("size", F.lead, F.first), "m": F.count("*").over(Window.partitionBy(*keys, "ring"))})
        gone = (F.col("size.a") < tolerance) & (F.col("size") < F.col("before")) & (F.col("size") < F.col("after")) & (F.col("m") > 4)
        # Of a small ring only the smallest vertex goes in a round, so that it never falls below four.
        least = F.min("size").over(Window.partitionBy(*keys, "ring"))
        v = checkpointed(v.withColumn("gone", gone & ((F.col("m") > 8) | (F.col("size") == least))).select(*keys, "ring", "place", "x", "y", "gone"), "ring-vertices")
        vertices = v.where("not gone").drop("gone")
        if not v.where("gone").limit(1).count():
            return vertices


def outline(cells: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """(keys, ring, hole, area, points array<struct<x, y>>): every ring of the boundary of cells(keys, r, c), clockwise around cells.

    Holes run the other way and have a negative area; areas are in cells, of the ring before simplification. A ring begins at its
    topmost, then leftmost corner. tolerance is the area in cells under which a corner is left out.
    """
    runs = checkpointed(ring_runs(boundary_runs(cells, keys), keys), "ring-runs")
    areas = runs.groupBy(*keys, "ring").agg(F.sum((F.col("x0") - F.col("x1")) * F.col("y0")).alias("area"), F.count("*").alias("n"))
    # The first run is no step from itself; the one after it is the farthest.
    vertices = runs.join(areas.select(*keys, "ring", "n").hint("merge"), [*keys, "ring"]).select(*keys, "ring", F.pmod(F.col("n") - F.col("back"), F.col("n")).alias("place"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    if tolerance > 0:
        vertices = simplified(vertices, keys, tolerance)
    points = vertices.groupBy(*keys, "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    return points.join(areas.hint("merge"), [*keys, "ring"]).select(*keys, "ring", (F.col("area") < 0).alias("hole"), "area", "points")


def geographic(rings: DataFrame, x0: float, y0: float, cell: float, radius: float) -> DataFrame:
    """Rings in degrees, for a sinusoidal grid with its corner at (x0, y0) and square cells, rows going south."""
    def turned(p: Column) -> Column:
        lat = (F.lit(y0) - p["y"] * cell) / radius
        return F.struct(F.degrees((F.lit(x0) + p["x"] * cell) / (radius * F.cos(lat))).alias("lon"), F.degrees(lat).alias("lat"))

    return rings.withColumn("points", F.transform("points", turned))
