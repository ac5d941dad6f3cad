"""Transitive closures: fixpoints of joins with a MIN per pair.

All of them work on proper paths (values from 2 on) without the diagonal, on
which the algebra is associative and monotone, so every strategy gives the same
result. A value's number of generations rides along as ``g``: the join of two
paths is a shift by the right side's ``g``, and MIN keeps both, since the
number of generations never falls as values grow.

Each round is a written table, so plans stay short and rounds survive lost
executors. A pair (i, i) is a cycle and raises :class:`CycleError`; paths of
more than 62 generations raise OverflowError instead of wrapping.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import MAX_GENERATIONS, msb, msb_sql
from ..plans.scratch import Scratch
from .graph import CycleError, DensificationError, off_diagonal

STRATEGIES = ("auto", "doubling", "semi-naive", "squaring", "levelwise", "components")
METHODS = ("auto", "FW", "D", "BF", "J")
#: Paths beyond which a round is made in parts, and edges in a block of sources: what is shuffled at a time is a part of the disk that the result takes.
PART_ROWS, BLOCK_EDGES = 10_000_000, 1_000_000


@dataclass
class Closure:
    """All paths ``(i, j, v)`` off the diagonal, and the longest one's generations."""

    paths: DataFrame
    diameter: int


def _prepared(edges: DataFrame) -> DataFrame:
    return edges.where("v >= 2").select("i", "j", F.col("v").cast("long").alias("v"), msb("v").cast("int").alias("g"))


def _joined(left: DataFrame, right: DataFrame, halves: bool = False) -> DataFrame:
    """All joins of paths of both sides; with ``halves`` those whose right side has the generations ``h`` of the left."""
    h = ["h"] if halves else []
    a = left.select("i", F.col("j").alias("k"), F.col("v").alias("x"), F.col("g").alias("gx"), *h)
    b = right.select(F.col("i").alias("k"), "j", F.col("v").alias("y"), F.col("g").alias("gy"), *[F.col("g").alias(c) for c in h])
    deep = f"gx + gy > {MAX_GENERATIONS}"
    value = "shiftleft(x, gy) + y - shiftleft(1L, gy)"
    safe = f"CASE WHEN {deep} THEN cast(raise_error('path does not fit 63 bits') AS bigint) ELSE {value} END"
    return a.join(b, ["k", *h]).select("i", "j", F.expr(safe).alias("v"), (F.col("gx") + F.col("gy")).alias("g"))


def _least(paths: DataFrame) -> DataFrame:
    return paths.groupBy("i", "j").agg(F.min("v").alias("v"), F.min("g").alias("g"))


def _block(paths: DataFrame, number: int, blocks: int) -> DataFrame:
    """The paths of one of ``blocks`` groups of sources."""
    return paths.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == number) if blocks > 1 else paths


def _unlike(paths: DataFrame, known: DataFrame) -> DataFrame:
    """Paths of pairs that ``known`` has not."""
    known = known.select(F.col("i").alias("hi"), F.col("j").alias("hj"))
    return paths.join(known, (F.col("i") == F.col("hi")) & (F.col("j") == F.col("hj")), "left_anti")


def _measure(paths: DataFrame) -> tuple[int, int, int | None, int]:
    """Rows, sum of values, a vertex on a cycle, generations: one pass over a written table."""
    row = paths.agg(
        F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min(F.when(F.col("i") == F.col("j"), F.col("i"))).alias("c"), F.max("g").alias("g")
    ).first()
    if row["c"] is not None:
        raise CycleError("Error: cycle detected!", row["c"])
    return row["n"], int(row["s"] or 0), row["c"], int(row["g"] or 0)


def _guarded(action: Callable[[], DataFrame]) -> DataFrame:
    """Run a round; the guard of the shift becomes an OverflowError."""
    try:
        return action()
    except Exception as error:
        if "does not fit 63 bits" in str(error):
            raise OverflowError("path does not fit 63 bits") from error
        raise


def _halved(held: DataFrame, reach: int, low: int, high: int) -> DataFrame:
    """Joins of two paths to ``low`` to ``high`` steps, each cut in its middle."""
    left = held.withColumn("h", F.explode(F.array(F.col("g"), F.col("g") - 1)))
    left = left.where((F.col("h") > 0) & (F.col("g") + F.col("h")).between(low, high))
    return _joined(left, held.where(F.col("g").between(low // 2, high // 2)), halves=True)


def _beyond(held: DataFrame, reach: int, low: int, high: int) -> DataFrame:
    """Joins of two paths to ``low`` to ``high`` steps, each cut after ``reach`` steps."""
    return _joined(held.where(F.col("g") == reach), held.where(F.col("g").between(low - reach, high - reach)))


def _by_steps(scratch: Scratch, held: DataFrame, joins: Callable[[DataFrame, int, int, int], DataFrame], max_rounds: int) -> Closure:
    """Rounds over edges of one step: all pairs up to ``reach`` steps give those up to twice as many, by ``joins``.

    Pairs that are known already are shorter and stay, so new rows are appended.
    A round of many rows is made length by length and then, without what is
    known, by blocks of sources, so that no shuffle holds all of its rows.
    """
    rows, _, _, longest = _measure(held)
    reach, parts = 1, [held]
    for _ in range(max_rounds):
        if longest < reach:
            break
        low, high = reach + 1, 2 * reach
        if rows <= PART_ROWS:
            made, blocks = [], 1
            longer = _least(joins(held, reach, low, high))
        else:
            made = [_guarded(lambda n=n, p=held: scratch.keep(_least(joins(p, reach, n, n)), "made")) for n in range(low, high + 1)]
            longer = scratch.together(made)
            blocks = 1 + (rows + longer.count()) // (4 * PART_ROWS)
        found = []
        for b in range(blocks):
            fresh = _block(longer, b, blocks)
            fresh = _unlike(_least(fresh) if made else fresh, _block(held, b, blocks))
            found.append(_guarded(lambda f=fresh: scratch.keep(f, "fresh")))
        scratch.drop(*made)
        more, _, _, most = _measure(scratch.together(found))
        if not more:
            break
        parts += found
        held, rows, reach, longest = scratch.together(parts), rows + more, 2 * reach, max(longest, most)
    scratch.only(*parts)
    return Closure(scratch.merged(parts).select("i", "j", "v"), longest)


def squaring(edges: DataFrame, max_rounds: int = 64, cut_cycles: bool = False) -> Closure:
    """Join the paths with themselves until nothing changes: as many rounds as the logarithm of the depth.

    Where every edge is one step, a least path is two least paths of half its
    length, so a round joins only paths of equal length or one step apart; the
    other products of the square give no lesser value.
    """
    scratch = Scratch(edges.sparkSession, "squaring", lean=True)
    held = scratch.keep(_least(_prepared(edges)))
    state = _measure(held)
    if state[3] <= 1:
        return _by_steps(scratch, held, _halved, max_rounds)
    for _ in range(max_rounds):
        now = _guarded(lambda p=held: scratch.keep(_least(p.unionByName(_joined(p, p)))))
        scratch.drop(held)
        held, before, state = now, state, _measure(now)
        if state == before:
            break
    return Closure(held.select("i", "j", "v"), state[3])


def doubling(edges: DataFrame, max_rounds: int = 64) -> Closure:
    """Double the length of known paths each round, with one join row for each way to cut a path once.

    The least path of a pair is a shortest one, and its beginning is the least
    path of its own pair. So when all pairs up to length n are known, those up
    to 2n are a path of length n exactly, joined with a known one; pairs that
    are known already are shorter and stay. New rows are appended, none is
    written twice. Edges longer than one step are left to :func:`squaring`.
    """
    scratch = Scratch(edges.sparkSession, "doubling", lean=True)
    held = scratch.keep(_least(_prepared(edges)))
    if _measure(held)[3] > 1:
        scratch.drop(held)
        return squaring(edges)
    return _by_steps(scratch, held, _beyond, max_rounds)


def semi_naive(edges: DataFrame, start: DataFrame | None = None, limit: int | None = None, reverse: bool = False) -> Closure:
    """Lengthen only the paths that the last round made or shortened, by one edge; as many rounds as the depth.

    ``start`` has the sources ``i`` to begin from (all by default), or with
    ``reverse`` the ends ``j``; ``limit`` bounds the values.
    """
    scratch = Scratch(edges.sparkSession, "semi-naive", lean=True)
    steps = scratch.keep(_least(_prepared(edges)), "edges")
    bound = F.lit(True) if limit is None else F.col("v") <= limit
    side = "j" if reverse else "i"
    delta = steps if start is None else steps.join(start.select(side).distinct(), side, "left_semi")
    held = fresh = scratch.keep(delta.where(bound))
    # Where every edge is one step, a path found later is longer and so never less: new rows are appended, none is written twice.
    single = (steps.agg(F.max("g").alias("g")).first()["g"] or 1) == 1
    longest, parts = _measure(held)[3], [held]
    while True:
        longer = _joined(steps, fresh) if reverse else _joined(fresh, steps)
        longer = _least(longer.where(bound))
        known = held.select(F.col("i").alias("hi"), F.col("j").alias("hj"), F.col("v").alias("hv"))
        same = (F.col("i") == F.col("hi")) & (F.col("j") == F.col("hj"))
        better = longer.join(known, same, "left_anti") if single else longer.join(known, same, "left").where("hv is null or v < hv")
        better = _guarded(lambda b=better: scratch.keep(b.select("i", "j", "v", "g"), "fresh"))
        rows, _, _, most = _measure(better)
        if not rows:
            break
        if single:
            held, longest = held.unionByName(better), max(longest, most)
            parts.append(better)
        else:
            held = scratch.keep(_least(held.unionByName(better)))
            scratch.only(steps, held, better)
            parts = [held]
        fresh = better
    scratch.only(*parts)
    return Closure(held.select("i", "j", "v"), longest if single else _measure(held)[3])


def _without_steps(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """Paths of several generations that are no path and one more step."""
    made = _joined(paths.where(F.col("g") < MAX_GENERATIONS), steps).select("i", "j", "v")
    return paths.where("g > 1").join(made, ["i", "j", "v"], "left_anti")


def absorbed(closure: DataFrame, edges: DataFrame) -> DataFrame | None:
    """The closure ``(i, j, v)`` with a batch of new ``edges (i, j, v)``; None if not all its edges are one step.

    New paths are made length by length: a path that holds a new edge is such a
    path and any edge, or an old path and a new edge. What comes out for the
    first time is final, so it is appended and never written again; old paths
    that a lesser one replaces are left out at the end. Blocks of sources follow
    one another, so that no shuffle holds the whole closure.
    """
    scratch = Scratch(edges.sparkSession, "absorb", lean=True)
    new = scratch.keep(_least(_prepared(edges)), "edges")
    old = scratch.keep(_prepared(closure), "closure")
    steps = scratch.keep(_least(new.unionByName(old.where("g = 1"))), "steps")
    longest = old.agg(F.max("g").alias("g")).first()["g"] or 0
    if _measure(new)[3] > 1 or (longest > 1 and not _guarded(lambda: _without_steps(old, steps.where("g = 1")).isEmpty())):
        scratch.only()
        return None
    blocks = 1 + steps.count() // BLOCK_EDGES
    parts, better_than_old = [], []
    for block in range(blocks):
        before, found, fresh, length = _block(old, block, blocks), [], _block(new, block, blocks), 1
        while True:
            known = before.select(F.col("i").alias("hi"), F.col("j").alias("hj"), F.col("v").alias("hv"))
            less = _unlike(fresh, scratch.together(found)) if found else fresh
            less = less.join(known, (F.col("i") == F.col("hi")) & (F.col("j") == F.col("hj")), "left").where("hv is null or v < hv")
            less = _guarded(lambda x=less: scratch.keep(x.select("i", "j", "v", "g", F.col("hv").isNotNull().alias("instead")), "fresh"))
            rows = _measure(less)[0]
            if rows:
                found.append(less)
            else:
                scratch.drop(less)
            if not rows and length > longest:
                break
            by_new = _joined(before.where(F.col("g") == length), new)
            fresh = _least(by_new.unionByName(_joined(less, steps)) if rows else by_new)
            length += 1
        parts += found
    if not parts:
        scratch.only(old)
        return old.select("i", "j", "v")
    scratch.only(old, *parts)
    added = scratch.together(parts)
    return _unlike(old, added.where("instead")).select("i", "j", "v").unionByName(added.select("i", "j", "v"))


def levels(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(vertex_id, level)``: the number of edges of the longest path from a vertex; sinks have 0.

    Peels vertices whose parents are all done; what can not be peeled lies on
    or leads to a cycle.
    """
    scratch = Scratch(edges.sparkSession, "levels")
    pairs = scratch.keep(edges.where("i <> j").select("i", "j").distinct(), "edges")
    ids = edges.select(F.col("i").alias("vertex_id")).union(edges.select("j"))
    if vertices is not None:
        ids = ids.union(vertices.select("vertex_id"))
    loops = edges.where("i = j and v >= 2").select("i").first()
    if loops:
        raise CycleError("Error: cycle detected!", loops["i"])
    waiting = scratch.keep(ids.distinct(), "waiting")
    done, level, peeled = None, 0, []
    while True:
        rest = pairs.select(F.col("i").alias("vertex_id")).distinct()
        ready = scratch.keep(waiting.join(rest, "vertex_id", "left_anti").withColumn("level", F.lit(level).cast("long")), "ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        peeled.append(ready)
        waiting = scratch.keep(waiting.join(ready, "vertex_id", "left_anti"), "waiting")
        pairs = scratch.keep(pairs.join(ready.select(F.col("vertex_id").alias("j")), "j", "left_anti"), "edges")
        level += 1
        scratch.only(waiting, pairs, *peeled)
    stuck = waiting.agg(F.min("vertex_id").alias("v")).first()["v"]
    if stuck is not None:
        from .quality import cycle_participants

        stuck = cycle_participants(pairs).agg(F.min("vertex_id").alias("v")).first()["v"]
        scratch.only()
        raise CycleError("Error: cycle detected!", stuck)
    scratch.only(*peeled)
    return done if done is not None else ids.selectExpr("vertex_id", "0L as level")


def levelwise(edges: DataFrame) -> Closure:
    """Finish vertices level by level from the sinks: an edge and its parent's finished paths make a vertex's paths."""
    scratch = Scratch(edges.sparkSession, "levelwise")
    steps = scratch.keep(_least(_prepared(edges)), "edges")
    depth = scratch.keep(levels(edges), "levels")
    most = depth.agg(F.max("level").alias("m")).first()["m"] or 0
    steps = scratch.keep(steps.join(depth.select(F.col("vertex_id").alias("i"), "level"), "i"), "edges")
    held = steps.where("level = 0").select("i", "j", "v", "g")
    parts = []
    for level in range(1, most + 1):
        here = steps.where(F.col("level") == level).select("i", "j", "v", "g")
        made = _guarded(lambda h=here, d=held: scratch.keep(_least(h.unionByName(_joined(h, d))), f"level{level}"))
        held = made if level == 1 else held.unionByName(made)
        parts.append(made)
    # Without levels there is no path, and the edges are empty.
    scratch.only(*(parts or [steps]))
    return Closure(held.select("i", "j", "v"), _measure(held)[3])


def by_component(edges: DataFrame, vertices: DataFrame | None = None) -> tuple[Closure, DataFrame]:
    """The closure with the component of each path's vertices: ``(component, i, j, v)``, and ``(vertex_id, component)``.

    Keys already keep components apart, so one fixpoint serves all of them.
    """
    from .structure import connected_components

    labels = connected_components(edges, vertices)
    done = doubling(edges)
    paths = done.paths.join(labels.select(F.col("vertex_id").alias("i"), "component"), "i")
    return Closure(paths.select("component", "i", "j", "v"), done.diameter), labels


def _plain(done: Closure) -> Closure:
    return Closure(done.paths.select("i", "j", "v"), done.diameter)


def choose(edges: DataFrame) -> str:
    """Doubling for edges of one step, else squaring."""
    row = edges.agg(F.max("v").alias("v")).first()
    return "squaring" if (row["v"] or 0) > 3 else "doubling"


def transitive_closure(edges: DataFrame, strategy: str = "auto", sparse_only: bool = False, vertices: int | None = None) -> Closure:
    """All paths of a graph. An unknown strategy is ``auto``; ``sparse_only`` turns a cycle into DensificationError."""
    edges = off_diagonal(edges).unionByName(edges.where("i = j and v >= 2"))
    if strategy not in STRATEGIES or strategy == "auto":
        strategy = choose(edges)
    run: dict[str, Callable[[], Closure]] = {
        "doubling": lambda: doubling(edges),
        "semi-naive": lambda: semi_naive(edges),
        "squaring": lambda: squaring(edges),
        "levelwise": lambda: levelwise(edges),
        "components": lambda: _plain(by_component(edges)[0]),
    }
    try:
        return run[strategy]()
    except CycleError as error:
        if sparse_only:
            raise DensificationError("a cyclic graph has no sparse closure") from error
        raise


def multi_source_min(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(j, v)``: the least value with which any of the sources ``i`` reaches ``j``."""
    return semi_naive(edges, sources).paths.groupBy("j").agg(F.min("v").alias("v"))


def weighted_paths(edges: DataFrame, sources: DataFrame | None = None, weight: str = "w", directed: bool = True, limit: int | None = None) -> DataFrame:
    """Shortest paths by ordinary addition: ``(i, j, d, pred)``, with the vertex before ``j`` (the smallest on ties).

    Without negative cycles at most as many rounds as there are vertices change
    anything; a change after that raises CycleError. Sources reach themselves at 0
    without a row.
    """
    scratch = Scratch(edges.sparkSession, "weighted")
    pairs = edges.select("i", "j", F.col(weight).cast("long").alias("w"))
    if not directed:
        pairs = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    pairs = scratch.keep(pairs.where("i <> j").groupBy("i", "j").agg(F.min("w").alias("w")), "edges")
    bound = F.lit(True) if limit is None else F.col("d") <= limit
    start = pairs if sources is None else pairs.join(sources.select("i").distinct(), "i", "left_semi")
    held = fresh = scratch.keep(start.select("i", "j", F.col("w").alias("d"), F.col("i").alias("pred")).where(bound))
    signs = pairs.agg(F.min("w").alias("least"), F.count_distinct("i").alias("n")).first()
    negative, most, rounds = (signs["least"] or 0) < 0, signs["n"] + 1, 0
    while True:
        step = pairs.select(F.col("i").alias("k"), F.col("j").alias("to"), "w")
        moved = fresh.join(step, fresh["j"] == step["k"])
        if negative:
            closed = moved.where("to = i and d + w < 0").agg(F.min("i").alias("i")).first()["i"]
            if closed is not None:
                raise CycleError("Error: negative cycle detected!", closed)
        longer = moved.where("to <> i").select("i", F.col("to").alias("j"), (F.col("d") + F.col("w")).alias("d"), F.col("k").alias("pred")).where(bound)
        longer = longer.groupBy("i", "j").agg(F.min(F.struct("d", "pred")).alias("b")).select("i", "j", "b.d", "b.pred")
        known = held.select(F.col("i").alias("hi"), F.col("j").alias("hj"), F.col("d").alias("hd"), F.col("pred").alias("hp"))
        better = longer.join(known, (F.col("i") == F.col("hi")) & (F.col("j") == F.col("hj")), "left")
        better = scratch.keep(better.where("hd is null or d < hd or (d = hd and pred < hp)").select("i", "j", "d", "pred"), "fresh")
        if better.isEmpty():
            scratch.only(held)
            return held
        rounds += 1
        if negative and rounds > most + 1:
            raise CycleError("Error: negative cycle detected!", better.agg(F.min("i").alias("i")).first()["i"])
        held = scratch.keep(held.unionByName(better).groupBy("i", "j").agg(F.min(F.struct("d", "pred")).alias("b")).select("i", "j", "b.d", "b.pred"))
        fresh = better
        scratch.only(pairs, held, fresh)


def shortest_path(edges: DataFrame, method: str = "auto", sources: DataFrame | None = None, unweighted: bool = False, limit: int | None = None) -> DataFrame:
    """``(i, j, d)``: shortest paths between all pairs, or from ``sources (i)``.

    ``FW`` and ``D`` join values by the algebra (all pairs by doubling, sources
    by lengthening), ``BF`` and ``J`` add them as plain numbers. ``auto`` takes
    the algebra, ``FW`` without sources and ``D`` with them: a colour, which is
    negative, is no weight. ``unweighted`` counts edges, whatever the method.
    """
    if method not in METHODS:
        raise ValueError(f"unrecognised method '{method}': one of {', '.join(METHODS)}")
    proper = edges.where("i <> j")
    if unweighted or method in ("BF", "J"):
        weighed = proper.withColumn("w", F.lit(1) if unweighted else F.col("v"))
        return weighted_paths(weighed, sources, limit=limit).select("i", "j", "d")
    if method == "D" or sources is not None or limit is not None:
        done = semi_naive(proper, sources, limit)
    else:
        done = transitive_closure(proper)
    return done.paths.select("i", "j", F.col("v").alias("d"))


def distances(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """``(i, j, d)``: edge values added as plain numbers along the predecessors ``tree (i, j, pred)``.

    Each row points at its predecessor's row; pointers double, so it takes as
    many rounds as the logarithm of the longest chain. A chain that ends before
    ``i`` gives no row, one that runs in a circle raises CycleError. Of parallel
    edges the least counts.
    """
    return _walked(Scratch(edges.sparkSession, "distances", lean=True), edges, tree)


def _walked(scratch: Scratch, edges: DataFrame, tree: DataFrame, others: Sequence[DataFrame] = ()) -> DataFrame:
    """:func:`distances` in a folder where the tables ``others`` stay."""
    steps = edges.where("i <> j").groupBy(F.col("i").alias("pred"), "j").agg(F.min("v").cast("long").alias("d"))
    walk = scratch.keep(tree.join(steps, ["pred", "j"]).select("i", "j", F.col("pred").alias("at"), "d"), "walk")
    # No chain has more steps than there are rows.
    for _ in range(walk.count().bit_length() + 2):
        if walk.where("at <> i").isEmpty():
            return walk.select("i", "j", "d")
        on = walk.select("i", F.col("j").alias("at"), F.col("at").alias("next"), F.col("d").alias("more"))
        moved = walk.where("at <> i").join(on, ["i", "at"]).select("i", "j", F.col("next").alias("at"), (F.col("d") + F.col("more")).alias("d"))
        walk = scratch.keep(walk.where("at = i").unionByName(moved), "walk")
        scratch.only(walk, *others)
    raise CycleError("Error: cycle detected!", walk.where("at <> i").agg(F.min("j").alias("j")).first()["j"])


def predecessors(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """``(i, j, v, pred)``: the vertex before ``j`` on the path that ``v`` names.

    The path without its last step leads to it, so no walk is needed: each path
    and one step more is looked up among the paths, the smallest predecessor on
    ties. A vertex has few parents but many children, so steps are added here
    and not taken off.
    """
    steps = edges.where("v in (2, 3)").select(F.col("i").alias("pred"), "j", F.col("v").cast("long").alias("step"))
    paths = closure.where("v >= 2")
    # A value without room for a step more turns negative and is not found.
    longer = paths.select("i", F.col("j").alias("pred"), F.col("v").alias("pv")).join(steps, "pred")
    longer = longer.select("i", "j", F.expr("shiftleft(pv, 1) + (step - 2)").alias("v"), "pred")
    direct = steps.select(F.col("pred").alias("i"), "j", F.col("step").alias("v"), "pred")
    return direct.unionByName(longer).join(paths.select("i", "j", "v"), ["i", "j", "v"]).groupBy("i", "j", "v").agg(F.min("pred").alias("pred"))


def distance_matrix(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """``(i, j, d)``: :func:`distances` along the :func:`predecessors` of all paths of the closure of ``edges``.

    Where every edge is one step, the value of a path spells its edges, 2 or 3
    each, so their sum is read from it and nothing is joined. Other edges are
    walked: a path's chain stays with its source, so blocks of sources follow
    one another, and no shuffle holds the whole closure.
    """
    if edges.where("i <> j and coalesce(v not in (2, 3), true)").isEmpty():
        return closure.where("v >= 2").select("i", "j", F.expr(f"cast(2 * {msb_sql('v')} + bit_count(v) - 1 as bigint)").alias("d"))
    scratch = Scratch(edges.sparkSession, "matrix", lean=True)
    blocks = 1 + closure.count() // PART_ROWS
    parts = []
    for b in range(blocks):
        mine = _block(closure, b, blocks)
        walked = _walked(scratch, edges, predecessors(mine, edges), parts)
        parts.append(scratch.keep(walked, "block"))
        scratch.only(*parts)
    return scratch.merged(parts)


def path_vertices(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(i, j, v, path)``: the vertices of the paths ``pairs (i, j, v)``, walked along the steps of ``v``."""
    scratch = Scratch(edges.sparkSession, "walk")
    steps = edges.where("v in (2, 3)").select(F.col("i").alias("at"), F.col("j").alias("to"), (F.col("v") - 2).alias("bit"))
    walk = pairs.where("v >= 2").select("i", "j", "v", F.col("i").alias("at"), (msb("v") - 1).cast("int").alias("left"), F.array("i").alias("path"))
    walk = scratch.keep(walk, "walk")
    done, last = None, walk
    for _ in range(MAX_GENERATIONS):
        moved = walk.withColumn("bit", F.expr("shiftright(v, left) & 1")).join(steps, ["at", "bit"])
        moved = moved.select("i", "j", "v", F.col("to").alias("at"), (F.col("left") - 1).alias("left"), F.concat("path", F.array("to")).alias("path"))
        moved = moved.where("left >= 0 or at = j").withColumn("over", F.col("left") < 0)
        moved = scratch.keep(moved, "walk")
        # Walks still open are read from here once more; what is over stays.
        over = scratch.keep(moved.where("over").select("i", "j", "v", "path"), "over")
        done = over if done is None else done.unionByName(over)
        walk = moved.where("not over").drop("over")
        scratch.drop(last)
        last = moved
        if walk.isEmpty():
            break
    scratch.drop(last)
    return done
