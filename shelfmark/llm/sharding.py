"""Sharding by histogram sort, in DataFrame operations only.

Method: rows have a 64-bit key.  Probes cut the open key intervals; one
map-side combined aggregation counts the exact bytes and rows below every
probe, and only the intervals that hold an unsettled splitter are cut again.
When every splitter is within the tolerance, or its interval is a single key,
the rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: All bits of a key, and the most probes of one round over all open intervals.
KEY_BITS, PROBES = 63, 1 << 16
#: Ranges of one shard at most; each is one task's sort.
MOST_PARTS = 256


def size_of(text: str = "text") -> Column:
    """Bytes of the UTF-8 text plus one; none for a null text."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def text_crc(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def sort_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """A non-negative key: the text's checksum above 31 bits of the id's hash, so equal texts lie together.

    A group of equal texts of any size is still cut between its ids.
    """
    return F.shiftleft(text_crc(text), 31) + F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 31))


def find_splitters(keyed: DataFrame, key: str, weight: str, targets: dict[float, float]) -> dict[float, tuple[int, int, int]]:
    """For every target weight a key and the exact (rows, weight) below it.

    ``targets`` holds the tolerance of each target.  A target is settled by the
    first probe within its tolerance, else by the nearest key of all.
    ``keyed`` is read once a round; the driver gets the counts of at most
    PROBES cells and two for every target.
    """
    # Target -> lowest key and bits of the interval that holds its cut, and rows and weight below that key.
    open_ = dict.fromkeys(targets, (0, 0, 0))
    settled, bits = {}, KEY_BITS
    while open_:
        lows = sorted({low for low, _, _ in open_.values()})
        step = max(0, bits - max(1, (PROBES // len(lows)).bit_length() - 1))
        inside = keyed if bits == KEY_BITS else keyed.filter(F.shiftright(key, bits).isin([low >> bits for low in lows]))
        cells = inside.groupBy(F.shiftright(key, step).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
        counts: dict[int, list] = {}
        for r in cells.collect():
            counts.setdefault(r.cell >> (bits - step) << bits, []).append((r.cell << step, r.n, r.w))
        below: dict[int, tuple] = {}
        for low in lows:
            row, sums = (0, 0), []
            for start, n, w in sorted(counts.get(low, [])):
                sums.append((start, *row))
                row = row[0] + n, row[1] + w
            below[low] = sums, [s[2] for s in sums] + [row[1]], row
        for target, (low, rows, weight_below) in list(open_.items()):
            sums, weights, whole = below[low]
            # The cell in which the target lies: the last that begins at or below it.
            at = max(0, bisect_right(weights, target - weight_below) - 1)
            start, n, w = sums[at] if at < len(sums) else (low + (1 << bits), *whole)
            left = (start, rows + n, weight_below + w)
            if at < len(sums):
                nxt = sums[at + 1][1:] if at + 1 < len(sums) else whole
                right = (start + (1 << step), rows + nxt[0], weight_below + nxt[1])
            else:
                right = left
            near = min(left, right, key=lambda x: abs(x[2] - target))
            if abs(near[2] - target) <= targets[target] or not step:
                settled[target] = near
                del open_[target]
            else:
                open_[target] = left
        bits = step
    return settled


def shard(
    df: DataFrame, shards: int = 16, parts: int | None = None, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.001,
) -> DataFrame:
    """``df`` with ``size``, ``text_crc32``, ``shard`` and a gapless ``slot`` within the shard.

    The law is ``bytes``: shards are neighbouring ranges of the sort key, and
    their sizes differ from an equal part by at most ``tolerance`` of it at
    either end, or by half of the row (or of the fully equal rows) that lies
    across the cut.  Each shard is exchanged in ``parts`` ranges, found in the
    same rounds, whose exact row counts give the first slot of every range; so
    no task sorts a whole shard.  Null texts have size 1 and the checksum of
    ''; ties of the key are ordered by id, and fully equal rows in any order.
    An empty table has no rows and no splitters.  Columns of the four names
    are replaced, others stay.
    """
    ours = {"size", "text_crc32", "shard", "slot"}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ours]
    key, place = fresh(df, "_key"), fresh(df, "_range")
    keyed = df.select(*rest, size_of(text).alias("size"), text_crc(text).alias("text_crc32"), sort_key(text, doc_id).alias(key))
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if parts is None:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = min(MOST_PARTS, max(4, -(-tasks // shards)))
    ranges = shards * parts
    # Cuts between shards are exact to the tolerance; those inside one only share out its work.
    part = total / ranges
    targets = {part * i: tolerance * total / shards if i % parts == 0 else part / 4 for i in range(1, ranges)} if total else {}
    found = find_splitters(keyed.select(key, "size"), key, "size", targets)
    cuts = [(0, 0, 0)] + [found[t] for t in sorted(targets)]
    cuts += [cuts[-1]] * (ranges - len(cuts))
    shard_keys = [cuts[s * parts][0] for s in range(1, shards)]
    part_keys = [[cuts[i][0] for i in range(s * parts + 1, (s + 1) * parts)] for s in range(shards)]
    # Rows of the same shard ahead of each range.
    ahead = [cuts[i][1] - cuts[i - i % parts][1] for i in range(ranges)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    passed = lambda keys: F.size(F.filter(keys, lambda k: k <= F.col(key)))
    number = passed(longs(shard_keys)) if shards > 1 else F.lit(0)
    sub = passed(F.element_at(F.array(*map(longs, part_keys)), F.col("shard") + 1)) if parts > 1 else F.lit(0)
    placed = keyed.withColumn("shard", number.cast("int")).withColumn(place, (F.col("shard") * parts + sub).cast("int"))
    order = Window.partitionBy(place).orderBy(key, doc_id)
    before = F.element_at(longs(ahead), F.col(place) + 1)
    return (
        placed.repartition(ranges, place)
        .withColumn("slot", before + F.row_number().over(order) - 1)
        .drop(place, key)
    )


def report(df: DataFrame) -> DataFrame:
    """The place of every document."""
    return df.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
