"""Named, staged column expressions that run over rows or over array elements.

A long rule (parse a URL, then canonicalise it) is written once as stages of named
expressions. Each stage sees the names of the stages before it. ``add_steps`` runs the
stages as consecutive projections, so every intermediate value is computed once and the
plain ones stay inside whole-stage code generation. The results pass through ``pinned``. ``map_steps`` runs the same stages over
an ``array<struct>`` without exploding it, which needs no shuffle to put a row back together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Getter = Callable[[str], Column]
Stage = Mapping[str, Callable[[Getter], Column]]
HIDDEN = "__step_"

# Columns of stages, by the identity of a stage list that its owner keeps (lru_cache). They name
# columns only, so they fit any frame, and building them is the slow part on the driver.
_BUILT: dict[int, tuple[Sequence[Stage], list[list[Column]]]] = {}


def _columns(stages: Sequence[Stage]) -> list[list[Column]]:
    known = _BUILT.get(id(stages))
    if known is None or known[0] is not stages:
        columns = [
            [fn(_hidden).alias(HIDDEN + name) for name, fn in stage.items()] for stage in stages
        ]
        known = (stages, columns)
        if isinstance(stages, tuple):
            _BUILT[id(stages)] = known
    return known[1]


def _hidden(name: str) -> Column:
    return F.col(HIDDEN + name)


def add_steps(
    df: DataFrame,
    stages: Sequence[Stage],
    inputs: Mapping[str, Column],
    outputs: Mapping[str, str],
) -> DataFrame:
    """Add ``outputs`` (step name -> column name) to ``df``; intermediate values are dropped.

    A tuple of stages that the caller keeps is turned into columns once per process.
    """
    original = [c for c in df.columns if c not in outputs.values()]
    out = df.select("*", *[expr.alias(HIDDEN + name) for name, expr in inputs.items()])
    for columns in _columns(stages):
        out = out.select("*", *columns)
    return pinned(out, original, {column: _hidden(step) for step, column in outputs.items()})


def pinned(df: DataFrame, kept: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """``kept`` columns of ``df`` plus ``columns``, as the output of a one-row generator.

    A filter or join on a computed column would otherwise be pushed through the projections
    that compute it, which copies their expressions into it: once per reference and stage, so
    exponentially many for a long rule. Nothing is pushed through a generator's own output,
    while filters on the kept columns still reach the scan.
    """
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(row)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_steps(array: Column, fields: Sequence[str], stages: Sequence[Stage]) -> Column:
    """Run ``stages`` over each struct of ``array``; every result field is added to the struct."""
    names = list(fields)
    for stage in stages:
        array = F.transform(array, _stage_struct(tuple(names), stage))
        names.extend(stage)
    return array


def _stage_struct(names: tuple[str, ...], stage: Stage) -> Callable[[Column], Column]:
    def build(element: Column) -> Column:
        def get(name: str) -> Column:
            return element.getField(name)

        kept = [get(n).alias(n) for n in names]
        return F.struct(*kept, *[fn(get).alias(n) for n, fn in stage.items()])

    return build
