"""Seeded synthesis of family graphs, one generation a round.

Chance is a hash of the seed and an id, so a seed gives the same family on any
cluster. Pairs are made by rank: the r-th red of a generation with the r-th
black in a hashed order; close kin are refused and may pair in the next pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .graph import Graph
from .structure import numbered

PASSES = 3
# Names are a head and a tail.
HEADS = ("Al", "Be", "Co", "Da", "El", "Fi", "Ga", "Ho")
TAILS = {"red": ("bor", "dan", "ken", "mir", "ric", "ton"), "black": ("bela", "dina", "lise", "mara", "ria", "tessa"), "last": ("berg", "combe", "ham", "ley", "stead", "wick")}


@dataclass(frozen=True)
class SynthesizerConfig:
    """What a family looks like; shares are in percent."""

    num_initial_nodes: int
    pct_red: float = 50.0
    avg_children_per_pairing: float = 2.5
    num_generations: int = 3
    pct_monogamous: float = 60.0
    pct_non_procreating: float = 15.0
    seed: int = 0
    max_total_vertices: int | None = None
    consanguinity_depth: int = 3
    pct_immigration_per_gen: float = 0.0
    child_distribution: str = "poisson"
    child_dispersion: float = 3.0

    def __post_init__(self) -> None:
        rules = {
            "num_initial_nodes": self.num_initial_nodes >= 1,
            "pct_red": 0 <= self.pct_red <= 100,
            "avg_children_per_pairing": self.avg_children_per_pairing >= 0,
            "num_generations": self.num_generations >= 0,
            "pct_monogamous": 0 <= self.pct_monogamous <= 100,
            "pct_non_procreating": 0 <= self.pct_non_procreating <= 100,
            "max_total_vertices": self.max_total_vertices is None or self.max_total_vertices >= 1,
            "consanguinity_depth": self.consanguinity_depth in (2, 3),
            "pct_immigration_per_gen": self.pct_immigration_per_gen >= 0,
            "child_distribution": self.child_distribution in ("poisson", "negative_binomial"),
            "child_dispersion": self.child_dispersion > 0,
        }
        for name, holds in rules.items():
            if not holds:
                raise ValueError(f"{name} is out of range: {getattr(self, name)!r}")


@dataclass
class SynthesisResult:
    graph: Graph
    individuals: DataFrame
    stats: dict


def _chance(seed: int, what: str, *of: str) -> Column:
    """A number in [0, 1) that hangs on the seed, a purpose and ids."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *[F.col(c) for c in of]), F.lit(1 << 40)) / float(1 << 40)


def child_shares(config: SynthesizerConfig, most: int = 40) -> list[float]:
    """Cumulative shares of 0, 1, 2, ... children."""
    mean, total, out = config.avg_children_per_pairing, 0.0, []
    for k in range(most):
        if config.child_distribution == "poisson":
            p = math.exp(-mean + (k * math.log(mean) if mean else 0) - math.lgamma(k + 1)) if mean or not k else 0.0
        else:
            r = config.child_dispersion
            q = mean / (mean + r)
            p = math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(1 - q) + (k * math.log(q) if q else 0)) if q or not k else 0.0
        total += p
        out.append(min(total, 1.0))
    return out


def _pick(names: tuple[str, ...], chance: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(chance * len(names)) + 1).cast("int"))


def _name(kind: str, seed: int, what: str) -> Column:
    return F.concat(_pick(HEADS, _chance(seed, what, "vertex_id")), _pick(TAILS[kind], _chance(seed, what + " tail", "vertex_id")))


def _named(people: DataFrame, seed: int, last: Column | None = None) -> DataFrame:
    first = F.when(F.col("color") == -1, _name("red", seed, "first")).otherwise(_name("black", seed, "first"))
    own = _name("last", seed, "last")
    return people.withColumn("first_name", first).withColumn("last_name", own if last is None else last)


def _newcomers(spark: SparkSession, config: SynthesizerConfig, count: int, base: int, generation: int) -> DataFrame:
    ids = spark.range(base, base + count).withColumnRenamed("id", "vertex_id")
    color = F.when(_chance(config.seed, "color", "vertex_id") < config.pct_red / 100, -1).otherwise(1)
    people = ids.select("vertex_id", color.alias("color"), F.lit(generation).alias("generation"), F.lit(None).cast("long").alias("father_id"), F.lit(None).cast("long").alias("mother_id"))
    return _named(people, config.seed)


def _kin(pairs: DataFrame, forebears: DataFrame) -> DataFrame:
    """Pairs whose forebears (themselves included) meet."""
    mine = pairs.join(forebears.select(F.col("vertex_id").alias("father"), "forebear"), "father")
    return mine.join(forebears.select(F.col("vertex_id").alias("mother"), "forebear"), ["mother", "forebear"]).select("father", "mother").distinct()


def synthesize(spark: SparkSession, config: SynthesizerConfig) -> SynthesisResult:
    scratch = Scratch(spark, "synth")
    cap = config.max_total_vertices or (1 << 62)
    total = min(config.num_initial_nodes, cap)
    fresh = scratch.keep(_newcomers(spark, config, total, 0, 0), "people")
    people, settled = fresh, None
    forebears = scratch.keep(fresh.select("vertex_id", F.col("vertex_id").alias("forebear"), F.lit(0).alias("depth")), "forebears")
    stats = {"generations": [total], "immigrants": 0, "pairings": 0, "refused": 0}
    shares = F.array(*[F.lit(s) for s in child_shares(config)])
    for generation in range(1, config.num_generations + 1):
        able = fresh.where(_chance(config.seed, "able", "vertex_id") >= config.pct_non_procreating / 100).select("vertex_id", "color", "last_name")
        if settled is not None:
            able = able.unionByName(settled)
        able = scratch.keep(able, "able")
        couples = None
        waiting = able
        for turn in range(PASSES):
            order = [_chance(config.seed, f"pair{generation}.{turn}", "vertex_id"), F.col("vertex_id")]
            red = numbered(waiting.where("color = -1"), order, "r").select(F.col("vertex_id").alias("father"), F.col("last_name"), "r")
            black = numbered(waiting.where("color = 1"), order, "r").select(F.col("vertex_id").alias("mother"), "r")
            pairs = scratch.keep(red.join(black, "r"), "pairs")
            kin = _kin(pairs, forebears.where(F.col("depth") <= config.consanguinity_depth))
            good = scratch.keep(pairs.join(kin, ["father", "mother"], "left_anti").select("father", "mother", "last_name"), "couples")
            made = good.count()
            stats["refused"] += pairs.count() - made
            couples = good if couples is None else couples.unionByName(good)
            stats["pairings"] += made
            paired = good.select(F.col("father").alias("vertex_id")).union(good.select("mother"))
            waiting = scratch.keep(waiting.join(paired, "vertex_id", "left_anti"), "waiting")
            if waiting.where("color = -1").isEmpty() or waiting.where("color = 1").isEmpty():
                break
        number = F.size(F.filter(shares, lambda s: s <= _chance(config.seed, f"children{generation}", "father", "mother")))
        born = couples.withColumn("n", number).where("n > 0").select("father", "mother", "last_name", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
        born = numbered(born, [F.col("father"), F.col("mother"), F.col("k")], "at").where(F.col("at") < cap - total)
        born = born.withColumn("vertex_id", F.col("at") + total)
        color = F.when(_chance(config.seed, "color", "vertex_id") < config.pct_red / 100, -1).otherwise(1)
        born = born.select("vertex_id", color.alias("color"), F.lit(generation).alias("generation"), F.col("father").alias("father_id"), F.col("mother").alias("mother_id"), "last_name")
        born = scratch.keep(_named(born, config.seed, F.col("last_name")).select(*people.columns), "people")
        count = born.count()
        total += count
        newcomers = max(0, min(round(count * config.pct_immigration_per_gen / 100), cap - total))
        following = born
        if newcomers:
            following = born.unionByName(scratch.keep(_newcomers(spark, config, newcomers, total, generation), "people"))
            total += newcomers
            stats["immigrants"] += newcomers
        stats["generations"].append(count + newcomers)
        committed = couples.where(_chance(config.seed, f"mono{generation}", "father", "mother") < config.pct_monogamous / 100)
        committed = committed.select(F.col("father").alias("vertex_id")).union(committed.select("mother"))
        settled = able.join(committed, "vertex_id", "left_anti")
        people = people.unionByName(following)
        lines = born.selectExpr("vertex_id", "inline(array(struct(father_id as parent), struct(mother_id as parent)))")
        up = lines.join(forebears.withColumnRenamed("vertex_id", "parent"), "parent").select("vertex_id", "forebear", (F.col("depth") + 1).alias("depth"))
        own = following.select("vertex_id", F.col("vertex_id").alias("forebear"), F.lit(0).alias("depth"))
        up = up.where(F.col("depth") <= config.consanguinity_depth).unionByName(own).groupBy("vertex_id", "forebear").agg(F.min("depth").alias("depth"))
        forebears = scratch.keep(forebears.unionByName(up), "forebears")
        fresh = following
        if not count or total >= cap:
            break
    edges = people.where("father_id is not null").selectExpr(
        "inline(array(struct(vertex_id as i, father_id as j, 2L as v), struct(vertex_id as i, mother_id as j, 3L as v)))"
    )
    stats["total"] = total
    return SynthesisResult(Graph(people.select("vertex_id", "color"), edges), people, stats)
