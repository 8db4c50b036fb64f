"""Whether rows lie in value ranges, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.reason import analysis
from tidemark.reason.ranges import Range
from tidemark.reason.spec import Spec


def admits(ranges: dict[str, Range]) -> Column:
    """A row's columns lie in the ranges; null lies in none."""
    out = F.lit(True)
    for column, r in ranges.items():
        c = F.col(column)
        if r.free:
            continue
        out = out & c.isNotNull()
        if r.values is not None:
            out = out & (c.isin(*r.values) if r.values else F.lit(False))
        for bound, low in ((r.low, True), (r.high, False)):
            if bound:
                out = out & ((c >= bound[0] if bound[1] else c > bound[0]) if low else (c <= bound[0] if bound[1] else c < bound[0]))
        if r.excluded:
            out = out & ~c.isin(*r.excluded)
    return F.coalesce(out, F.lit(False))


def admitted(spec: Spec, table: str, columns: list[str]) -> Column:
    """Whether any use of a table in a query can need a row."""
    uses = [u for u in analysis.uses(spec) if u.table == table]
    return reduce(lambda a, b: a | b, [admits({c: r for c, r in analysis.constraints(u.branch).of(u.label).items() if c in columns}) for u in uses])
