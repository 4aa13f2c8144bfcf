"""Ordered work along keys whose history is larger than a task.

Rows are cut into parts by ranges of key and order, so that a part holds a stretch of a long key or several short
keys, and at most one key goes on from the part before. What a window over the whole key would know is then made of
what the part knows and what is carried into it: one row for each part whose first key began earlier.

* carried(): sums, extremes and last values of all earlier rows of the key.
* framed(): the rows just before and behind a part, copied into it, for frames of a bounded number of rows.
* block_scan(): states that aren't sums. A block of rows gives one summary, which says what the block does to any
  state before it; a walk over the summaries, a row for each block, gives each block its start, and blocks finish alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import discard, stored

#: Rows of a part; a table of no more is one part.
PART_ROWS = 1_000_000
#: Rows that are folded as one array.
BLOCK_ROWS = 512
KEY, PART = "__key", "__part"


@dataclass(frozen=True)
class Parts:
    """Rows with their key (a struct) and part. Null keys are a key."""

    rows: DataFrame
    order: list[str]
    n: int

    @property
    def line(self) -> WindowSpec:
        """Rows of a key within its part, in order."""
        return Window.partitionBy(KEY, PART).orderBy(*self.order)

    @property
    def so_far(self) -> WindowSpec:
        return self.line.rowsBetween(Window.unboundedPreceding, 0)

    def but(self, rows: DataFrame) -> Parts:
        """The same parts with other columns."""
        return replace(self, rows=rows)

    def done(self) -> DataFrame:
        return self.rows.drop(KEY, PART)

    def carried(self, **states: tuple[Column, Callable[[Column], Column]]) -> Parts:
        """Adds, by name, what the key's rows in earlier parts come to (null where there are none): an aggregate of a
        part's rows, and the one that puts parts together, in their order."""
        if self.n == 1:
            kinds = dict(self.rows.limit(0).groupBy(KEY).agg(*[made.alias(name) for name, (made, _) in states.items()]).dtypes)
            return self.but(self.rows.withColumns({name: F.lit(None).cast(kinds[name]) for name in states}))
        before = Window.partitionBy(KEY).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        held = self.rows.groupBy(KEY, PART).agg(*[made.alias(name) for name, (made, _) in states.items()])
        starts = held.withColumns({name: joined(F.col(name)).over(before) for name, (_, joined) in states.items()} | {"__earlier": F.count("*").over(before)})
        return self.but(self.rows.join(F.broadcast(starts.where("__earlier > 0").drop("__earlier")), [KEY, PART], "left"))  # a row for each part at most

    def _copies(self, n: int, ahead: bool) -> DataFrame:
        """The n rows next to each part, before (or behind) it, of the key that goes on there, under that part."""
        sizes = self.rows.groupBy(KEY, PART).agg(F.count("*").alias("__size"))
        way = F.desc(PART) if ahead else F.asc(PART)
        others = Window.partitionBy(KEY).orderBy(way)
        # parts that come next, with the number of rows between them and this one
        total = sizes.withColumn("__end", F.sum("__size").over(others.rowsBetween(Window.unboundedPreceding, 0)))
        nexts = total.withColumn("__to", F.collect_list(F.struct(F.col(PART).alias("part"), (F.col("__end") - F.col("__size")).alias("at"))).over(others.rowsBetween(1, n)))
        near = nexts.withColumn("__to", F.filter("__to", lambda p: p["at"] - F.col("__end") < n)).where("size(__to) > 0").select(KEY, PART, "__to", "__end")
        # the first row in the walk's direction is the farthest from the next part
        nth = F.row_number().over(Window.partitionBy(KEY, PART).orderBy(*[F.asc(c) if ahead else F.desc(c) for c in self.order]))
        edge = self.rows.join(F.broadcast(near), [KEY, PART]).withColumn("__nth", nth).where(F.col("__nth") <= n)
        copied = edge.withColumn("__to", F.explode(F.filter("__to", lambda p: p["at"] - F.col("__end") + F.col("__nth") <= n)))
        return copied.withColumn(PART, F.col("__to.part")).select(*self.rows.columns)

    def with_neighbours(self, before: int, after: int) -> Parts:
        """Rows of other parts that frames of this one reach, marked in __copy."""
        rows = self.rows.withColumn("__copy", F.lit(False))
        if self.n > 1:
            for n, ahead in ((before, False), (after, True)):
                if n:
                    rows = rows.unionByName(self._copies(n, ahead).withColumn("__copy", F.lit(True)))
        return self.but(rows)


def parts_of(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None) -> Parts:
    """Writes df cut into parts of about so many rows: ranges differ from run to run, a written table doesn't."""
    rows = PART_ROWS if rows is None else rows
    keyed = stored(df.withColumn(KEY, F.struct(*keys)), "rows")
    n = max(1, math.ceil(keyed.count() / rows))
    if n == 1:
        return Parts(keyed.withColumn(PART, F.lit(0)), order, 1)
    placed = stored(keyed.repartitionByRange(n, KEY, *order).withColumn(PART, F.spark_partition_id()), "parts")
    discard(keyed)
    return Parts(placed, order, n)


def framed(df: DataFrame, key: str, order: str, before: int, after: int, build: Callable[[Parts, list[str]], DataFrame], rows: int | None = None) -> DataFrame:
    """build(parts, keys) of rows among which stand the `before` rows above and `after` rows below each part: windows
    by the keys that it gets, over frames within that reach, have the values of windows by key over the whole table.
    build keeps the columns __key, __part and __copy."""
    parts = parts_of(df, [key], [order], rows).with_neighbours(before, after)
    return build(parts, [KEY, PART]).where("not __copy").drop(KEY, PART, "__copy")


def block_scan(parts: Parts, inputs: dict[str, Column], start: Column, step: Callable[[Column, Column], Column], blank: Column, summed: Callable[[Column, Column], Column], moved: Callable[[Column, Column], Column], names: list[str], block: int | None = None) -> Parts:
    """Rows with the named fields of a state that goes along each key's rows: state' = step(state, row).

    inputs: what step reads of a row; start: the state before the first row. A block's summary is a fold of summed from
    blank over its rows; moved(state, summary) is the state behind the block.
    """
    block = BLOCK_ROWS if block is None else block
    kind, sums = (parts.rows.select(c.alias("s")).schema["s"].dataType.simpleString() for c in (start, blank))
    columns = [c for c in parts.rows.columns if c not in (KEY, PART)]
    picked = F.struct(*parts.order, F.struct(*[c.alias(n) for n, c in inputs.items()]).alias("x"), F.struct(*columns).alias("row"))
    numbered = parts.rows.withColumn("__block", F.floor((F.row_number().over(parts.line) - 1) / block))
    place = [KEY, PART, "__block"]
    blocks = numbered.groupBy(*place).agg(F.sort_array(F.collect_list(picked)).alias("rows"))
    known = blocks.select(*place, F.aggregate("rows", blank.cast(sums), lambda a, r: summed(a, r["x"]).cast(sums)).alias("does"))
    line = F.sort_array(F.collect_list(F.struct(PART, "__block", "does")))
    walk = known.groupBy(KEY).agg(line.alias("line"))
    begun = F.struct(start.cast(kind).alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    states = F.aggregate("line", begun, lambda a, b: F.struct(moved(a["state"], b["does"]).cast(kind).alias("state"), F.concat(a["out"], F.array(a["state"])).alias("out")), lambda a: a["out"])
    starts = walk.select(KEY, F.explode(F.zip_with("line", states, lambda b, s: F.struct(b[PART].alias(PART), b["__block"].alias("__block"), s.alias("begin")))).alias("b")).select(KEY, "b.*")

    def one(at: Column, row: Column) -> Column:
        now = step(at["state"], row["x"]).cast(kind)
        return F.struct(now.alias("state"), F.concat(at["out"], F.array(now)).alias("out"))

    first = F.struct(F.col("begin").alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    met = blocks.join(starts, place).withColumn("states", F.aggregate("rows", first, one, lambda a: a["out"]))
    out = met.select(KEY, PART, F.explode(F.arrays_zip("rows", "states")).alias("z"))
    return parts.but(out.select("z.rows.row.*", *[F.col(f"z.states.{n}").alias(n) for n in names], KEY, PART))
