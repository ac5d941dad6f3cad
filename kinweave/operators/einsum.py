"""Generalised contraction over the path algebra.

Operands are tables with a column for each index and a value ``v``; subscripts
name the indices as in ``'ij,jk->ik'``. Products run from left to right before
any sum, since the algebra is not associative where colours meet: partial sums
are never taken between operands. Indices that the output lacks are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import avos_product


def parse(subscripts: str, ranks: list[int]) -> tuple[list[list[str]], list[str]]:
    """Index names of each operand and of the output. An ellipsis stands for the indices that are not named, from the right."""
    inputs, arrow, output = subscripts.replace(" ", "").partition("->")
    terms = inputs.split(",")
    if len(terms) != len(ranks):
        raise ValueError(f"{len(terms)} subscripts for {len(ranks)} operands")
    named, widest = [], 0
    for term, rank in zip(terms, ranks, strict=True):
        letters = term.replace("...", "")
        if "." in letters or not all(c.isalpha() for c in letters):
            raise ValueError(f"bad subscript {term!r}")
        hidden = rank - len(letters)
        if hidden < 0 or (hidden and "..." not in term):
            raise ValueError(f"subscript {term!r} for an operand of {rank} indices")
        widest = max(widest, hidden)
        named.append((term, hidden))
    batch = lambda n: [f"_{widest - n + k}" for k in range(n)]

    def spread(term: str, hidden: int) -> list[str]:
        left, dots, right = term.partition("...")
        return [*left, *(batch(hidden) if dots else []), *right]

    operands = [spread(t, h) for t, h in named]
    if arrow:
        out = spread(output, widest)
    else:
        flat = [c for o in operands for c in o]
        out = batch(widest) + sorted(c for c in set(flat) if not c.startswith("_") and flat.count(c) == 1)
    if len(set(out)) != len(out) or any(c not in {x for o in operands for x in o} for c in out):
        raise ValueError(f"bad output of {subscripts!r}")
    return operands, out


def einsum(subscripts: str, *operands: DataFrame) -> DataFrame:
    """Contract operands ``(index columns..., v)``; the result has a column for each output index, and ``v``.

    A result without indices has one row, 0 if no product is left. Operands
    without a common index are combined by all pairs, as an outer product is.
    """
    if not operands:
        raise ValueError("einsum needs an operand")
    ranks = [len(o.columns) - 1 for o in operands]
    names, output = parse(subscripts, ranks)
    done: DataFrame | None = None
    held: list[str] = []
    for k, (operand, labels) in enumerate(zip(operands, names, strict=True)):
        columns = [c for c in operand.columns if c != "v"]
        seen: dict[str, str] = {}
        same = F.lit(True)
        for column, label in zip(columns, labels, strict=True):
            if label in seen:
                same &= F.col(f"`{column}`") == F.col(f"`{seen[label]}`")
            else:
                seen[label] = column
        part = operand.where(same).where("v <> 0").select(*[F.col(f"`{c}`").alias(f"n{label}") for label, c in seen.items()], F.col("v").alias("y"))
        if done is None:
            done, held = part.withColumnRenamed("y", "x"), list(seen)
            continue
        shared = [f"n{c}" for c in seen if c in held]
        both = done.join(part, shared) if shared else done.crossJoin(part)
        held += [c for c in seen if c not in held]
        done = both.select(*[f"n{c}" for c in held], avos_product("x", "y").alias("x")).where("x <> 0")
    index = [f"n{c}" for c in output]
    if not index:
        return done.agg(F.coalesce(F.min("x"), F.lit(0)).alias("v"))
    return done.groupBy(*index).agg(F.min("x").alias("v")).select(*[F.col(f"n{c}").alias(c.lstrip("_") if not c.startswith("_") else f"b{c}") for c in output], "v")
