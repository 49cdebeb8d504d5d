"""Grouping, lookup and ordering steps whose work does not pile up on one key.

A key may own a large share of all rows: one series, one source, one group of
byte-equal pages.  The steps here keep heavy work keyed by more than that key:

* ``attach`` salts the rows it gives their group's aggregates to.  The one-row
  side is copied only to the salts that really occur, which a BIGINT bitmap
  records during the (map-side combined) aggregation, so a unique key is copied
  once.
* ``lookup`` is a many-to-one equi-join.  Where a key is known to be held by a
  large part of the many side, the one-row side is copied to those of a few
  salts that occur, which needs no setting of the session.

* ``prefix`` and ``number_rows`` cut the order of a group into buckets of
  ``WIDTH`` positions, for dense positions such as pages and list indexes.  What
  crosses buckets is one carried row per bucket.  Sparse positions, and inputs
  that are dear to plan twice, take ``ordered.scan`` instead.

Copies are joined by sorting and merging: the optimizer's size of a table does
not count what ``explode`` adds to it, so it would broadcast tables of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
#: Copies of the one-row side of a lookup with hot keys.
COPIES = 16
WIDTH = 65536
_SALT, _MAP = "_salt", "_salt_map"


def computed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the named columns computed once.

    Filters on a projected column are pushed below the projection with the
    whole expression repeated in them.  Columns that leave a generator are not,
    so expensive columns that are filtered on several times pass through one.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, for rows that are dear to work on.

    Tasks follow the bytes of the files, and a file of a few megabytes may hold
    a million rows: without this, one task would work on all of them.  The
    number is stated, as partitions of few bytes would be put together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)


def _salted(df: DataFrame, row: Sequence[str]) -> DataFrame:
    return df.withColumn(_SALT, F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int"))


def _salt_map() -> Column:
    return F.expr(f"bit_or(shiftleft(1L, {_SALT}))").alias(_MAP)


def _spread(df: DataFrame) -> DataFrame:
    salts = f"filter(sequence(0, {SALTS - 1}), i -> shiftright({_MAP}, i) & 1 = 1)"
    return df.withColumn(_SALT, F.explode(F.expr(salts))).drop(_MAP)


def attach(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    row: Sequence[str],
    keep: str | Column | None = None,
    share: bool = False,
) -> DataFrame:
    """Each row with the aggregates of its group; ``keep`` drops whole groups.

    ``row`` names columns that differ between the rows of a group; they decide
    the salt.  Keys must not be null.  With ``share`` the aggregates are taken
    from the salted shuffle of the rows themselves, so an expensive ``df``
    without further columns is computed and shuffled once.
    """
    salted = _salted(df, row)
    if share:
        salted = salted.repartition(*keys, _SALT)
    groups = salted.groupBy(*keys).agg(*aggs, _salt_map())
    if keep is not None:
        groups = groups.filter(keep)
    return salted.join(_spread(groups).hint("merge"), [*keys, _SALT]).drop(_SALT)


def lookup(many: DataFrame, one: DataFrame, on: Sequence[str], how: str = "left", copies: int = 1) -> DataFrame:
    """``many`` joined to ``one``, which has at most one row per key.

    With ``copies`` the rows of a key (null keys too) are dealt to that many
    salts (64 at most) by their content, and ``one`` is copied to those that
    occur.  ``many`` is then evaluated twice, so its content must not vary.
    """
    if copies == 1:
        return many.join(one, list(on), how)
    salted = many.withColumn(_SALT, F.pmod(F.xxhash64(*many.columns), F.lit(copies)).cast("int"))
    wanted = salted.groupBy(*on).agg(_salt_map()).join(one.hint("merge"), list(on))
    return salted.join(_spread(wanted).hint("merge"), [*on, _SALT], how).drop(_SALT)


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: dict[str, tuple[str, str]],
    inclusive: bool = False,
    width: int = WIDTH,
) -> DataFrame:
    """Running aggregates by ``pos`` within ``keys``, over the rows before each row.

    ``values`` maps a new column to (how, column); ``how`` is last (non-null),
    sum or max.  ``pos`` is a non-negative integer, unique within ``keys``, so
    a bucket holds at most ``width`` rows whatever the size of the group, and
    there are as many buckets in one window as ``width`` goes into the last
    position: below ``width`` squared both are bounded.
    """
    # Totals and rows come from the same shuffle on (keys, bucket).
    df = df.withColumn("_bucket", F.expr(f"{pos} div {width}")).repartition(*keys, "_bucket")
    totals = df.groupBy(*keys, "_bucket").agg(
        *(_total(how, column, pos).alias(f"_total_{name}") for name, (how, column) in values.items())
    )
    run = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, "_bucket", *(run[how](f"_total_{name}").over(earlier).alias(f"_before_{name}") for name, (how, _) in values.items())
    )
    df = df.join(before, [*keys, "_bucket"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    columns = {}
    for name, (how, column) in values.items():
        own, carried = run[how](column).over(inside), F.col(f"_before_{name}")
        if how == "sum":
            columns[name] = F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))
        else:
            columns[name] = (F.coalesce if how == "last" else F.greatest)(own, carried)
    return df.withColumns(columns).drop("_bucket", *(f"_before_{name}" for name in values))


def _total(how: str, column: str, pos: str) -> Column:
    if how == "last":
        return F.expr(f"max_by({column}, {pos}) FILTER (WHERE {column} IS NOT NULL)")
    return getattr(F, how)(column)


def number_rows(df: DataFrame, keys: Sequence[str], pos: str, name: str, width: int = WIDTH) -> DataFrame:
    """1-based number of each row within ``keys``, ordered by the unique integer ``pos``."""
    return prefix(df.withColumn("_one", F.lit(1).cast("bigint")), keys, pos, {name: ("sum", "_one")}, inclusive=True, width=width).drop("_one")
