"""Running aggregates over ordered groups that stay balanced under skew.

A plain window puts each group in one task. That is right while groups are
small. A group above ``limit`` rows is cut into consecutive chunks by a range
shuffle on (keys, order): every chunk is aggregated on its own, the chunk totals
(one row per chunk) are carried forward, and the two are combined. All the
aggregates offered here can be combined that way, so the result is the same.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut

HOT_ROWS = 2_000_000
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20

_CHUNK = "__chunk"
_ALL = "__all"


@dataclass(frozen=True)
class Running:
    """One running aggregate over the rows strictly before the current one."""

    kind: str  # sum, max, min or last
    value: Column


def running_sum(value: Column) -> Running:
    return Running("sum", value)


def running_max(value: Column) -> Running:
    return Running("max", value)


def running_min(value: Column) -> Running:
    return Running("min", value)


def latest(value: Column) -> Running:
    """Most recent non-null value before the row."""
    return Running("last", value)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count was measured and is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def heavy_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys holding more than ``limit`` rows: at most rows / limit of them."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > limit)


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with renamed keys, and the null-safe match with ``left``."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    return renamed, functools.reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys])


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys are those of ``left``
    (of either side in a full join)."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    match = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    joined = left.join(renamed, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how == "full":
        joined = joined.withColumns({k: F.coalesce(k, f"__k_{k}") for k in keys})
    return joined.drop(*[f"__k_{k}" for k in keys])


def small_enough(df: DataFrame) -> bool:
    """Whether a table is small enough to send, by its counted rows and bytes."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    n_rows, n_bytes = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n_rows <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES


def look_up(
    left: DataFrame, right: DataFrame, key: str, limit: int = HOT_ROWS, small: bool | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Left join with a table of unique keys. A small table is sent to the rows. To a larger
    one the rows are shuffled. If more than ``limit`` rows have one key or none, the rows of
    such keys and those without a key stay where they are, and the entries they need are
    sent. ``counts`` may name the keys of ``left`` (null too) with their ``n_rows``."""
    if small_enough(right) if small is None else small:
        return left.join(F.broadcast(right), key, "left")
    heavy = heavy_keys(left, [key], limit) if counts is None else counts.filter(F.col("n_rows") > limit)
    heavy = heavy.select(key)
    n_hot = heavy.count()
    if n_hot == 0:
        return left.join(right, key, "left")  # one pass over the rows
    hot = heavy.filter(F.col(key).isNotNull())
    marked = left.join(bounded_broadcast(hot.withColumn("__hot", F.lit(True)), n_hot), key, "left")
    stays = F.col(key).isNull() | F.col("__hot").isNotNull()
    entries = bounded_broadcast(right.join(bounded_broadcast(hot, n_hot), key, "left_semi"), n_hot)
    apart, rest = marked.filter(stays).drop("__hot"), marked.filter(~stays).drop("__hot")
    return apart.join(entries, key, "left").unionByName(rest.join(right, key, "left"))


def _ordering(order: list[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def _local(run: Running, window) -> Column:
    match run.kind:
        case "sum":
            return F.coalesce(F.sum(run.value).over(window), F.lit(0))
        case "max":
            return F.max(run.value).over(window)
        case "min":
            return F.min(run.value).over(window)
        case "last":
            return F.last(run.value, ignorenulls=True).over(window)
    raise ValueError(f"unknown running aggregate {run.kind!r}")


def _total(run: Running, order: list[str], reverse: bool) -> Column:
    match run.kind:
        case "sum":
            return F.sum(run.value)
        case "max":
            return F.max(run.value)
        case "min":
            return F.min(run.value)
    position = F.when(run.value.isNotNull(), F.struct(*order))
    return F.min_by(run.value, position) if reverse else F.max_by(run.value, position)


def _combine(run: Running, local: Column, carried: Column) -> Column:
    match run.kind:
        case "sum":
            return local + F.coalesce(carried, F.lit(0))
        case "max":
            return F.greatest(local, carried)
        case "min":
            return F.least(local, carried)
    return F.coalesce(local, carried)


class OrderedGroups:
    """Rows of ordered groups, split once into light groups and chunked heavy ones.

    ``order`` must be a total order within a group.
    """

    def __init__(self, keys: list[str], order: list[str], light: DataFrame | None, heavy: DataFrame | None = None, n_chunks: int = 0, is_cut: bool = False):
        self.keys, self.order, self.light, self.heavy = keys, order, light, heavy
        self.n_chunks, self.is_cut = n_chunks, is_cut

    @classmethod
    def of_light(cls, df: DataFrame, keys: list[str], order: list[str]) -> OrderedGroups:
        """Groups already known to be small."""
        return cls(keys, order, df)

    @classmethod
    def split(
        cls, df: DataFrame, keys: list[str], order: list[str], limit: int = HOT_ROWS, sizes: DataFrame | None = None
    ) -> OrderedGroups:
        """``sizes`` may name a cheaper table whose groups are at least as large."""
        heavy = heavy_keys(df if sizes is None else sizes, keys, limit)
        n_keys, n_rows = heavy.agg(F.count("*"), F.sum("n_rows")).first()
        if n_keys == 0:
            return cls(keys, order, df)
        side, match = _same_keys(df, heavy.select(*keys), keys)
        side = bounded_broadcast(side, n_keys)
        n_chunks = 2 * math.ceil(n_rows / limit)
        chunked = cut(
            df.join(side, match, "left_semi")
            .repartitionByRange(n_chunks, *keys, *order)
            .withColumn(_CHUNK, F.spark_partition_id())
        )
        return cls(keys, order, df.join(side, match, "left_anti"), chunked, n_chunks + n_keys, is_cut=True)

    @classmethod
    def of_one(cls, df: DataFrame, order: list[str]) -> OrderedGroups:
        """All rows as one group, in chunks at any size, so that no task holds them all."""
        chunked = cut(df.withColumn(_ALL, F.lit(0)).repartitionByRange(*order).withColumn(_CHUNK, F.spark_partition_id()))
        return cls([_ALL], order, None, chunked, BROADCAST_ROWS + 1, is_cut=True)

    def transform(self, step: Callable[[DataFrame], DataFrame]) -> OrderedGroups:
        """Apply a row-wise step to all rows."""
        heavy = None if self.heavy is None else step(self.heavy)
        light = None if self.light is None else step(self.light)
        return OrderedGroups(self.keys, self.order, light, heavy, self.n_chunks)

    def running(self, runs: dict[str, Running], reverse: bool = False) -> OrderedGroups:
        """Add one column per run, over the earlier (later) rows of the group."""
        light = None if self.light is None else self._windowed(self.light, self.keys, runs, reverse)
        heavy = None if self.heavy is None else self._carried(runs, reverse)
        return OrderedGroups(self.keys, self.order, light, heavy, self.n_chunks)

    def rows(self) -> DataFrame:
        if self.light is None or self.heavy is None:
            return self.light if self.heavy is None else self.heavy.drop(_CHUNK)
        return self.light.unionByName(self.heavy.drop(_CHUNK))

    def _windowed(self, rows: DataFrame, group: list[str], runs: dict[str, Running], reverse: bool) -> DataFrame:
        window = Window.partitionBy(*group).orderBy(*_ordering(self.order, reverse)).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({name: _local(run, window) for name, run in runs.items()})

    def _carried(self, runs: dict[str, Running], reverse: bool) -> DataFrame:
        group = [*self.keys, _CHUNK]
        # the rows are used twice, so that a chain of steps must not redo them
        rows = self.heavy if self.is_cut else cut(self.heavy)
        totals = rows.groupBy(*group).agg(
            *[_total(run, self.order, reverse).alias(f"__t_{name}") for name, run in runs.items()]
        )
        before = Window.partitionBy(*self.keys).orderBy(*_ordering([_CHUNK], reverse)).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *group,
            *[_local(Running(run.kind, F.col(f"__t_{name}")), before).alias(f"__c_{name}") for name, run in runs.items()],
        )
        local = self._windowed(rows, group, runs, reverse)
        side, match = _same_keys(local, carried, group)
        combined = local.join(bounded_broadcast(side, self.n_chunks), match, "left")
        return combined.select(
            *rows.columns,
            *[_combine(run, F.col(name), F.col(f"__c_{name}")).alias(name) for name, run in runs.items()],
        )


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    runs: dict[str, Running],
    *,
    reverse: bool = False,
    limit: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add one column per entry of ``runs``, computed over the earlier rows of
    the same group (later rows when ``reverse``). ``order`` must be a total
    order within a group; no ``keys`` means one order over all rows."""
    if not keys:
        return OrderedGroups.of_one(df, order).running(runs, reverse).rows().drop(_ALL)
    return OrderedGroups.split(df, keys, order, limit, sizes).running(runs, reverse).rows()


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], **options) -> DataFrame:
    """Values of the row just before (after, when ``reverse``) in the group:
    ``values`` maps new column names to source columns; NULL on the first row."""
    packed = "__previous"
    sources = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    wide = with_running(df, keys, order, {packed: latest(sources)}, **options)
    return wide.select(*df.columns, F.col(packed).isNull().alias("is_first"), *[F.col(f"{packed}.{n}").alias(n) for n in values])


def first_in_group(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their rank ``position``.

    A tree of rankings: within the rows a task read, within the survivors of 256
    such tasks, then over the group. No step ranks more than one task's input,
    or ``256 * n`` rows, or ``n`` rows per 256 tasks at the end.
    """
    part = df.withColumn("__part", F.spark_partition_id())
    for group in ([*keys, "__part"], [*keys, "__parts"], keys):
        window = Window.partitionBy(*group).orderBy(*order)
        part = part.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n)
        if group[-1] == "__part":
            part = part.withColumn("__parts", F.floor(F.col("__part") / 256)).drop("position")
        elif group[-1] == "__parts":
            part = part.drop("position")
    return part.drop("__part", "__parts")
