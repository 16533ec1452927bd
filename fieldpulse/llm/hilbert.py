"""Shards along a Hilbert curve, for files that prune on several columns at once.

Documents are quantised in three dimensions of ``BITS`` bits (language, source, size class), sorted by
their place on the Hilbert curve through that cube, then by key, and cut into runs whose row counts
differ by one at most (law ``rows``).  Neighbours on the curve are neighbours in the cube, so each shard
covers few values of every dimension.

The curve index is an aggregate over the bit levels with a table of states, which ``curve_table`` derives
from Gray codes.  Ranks come from range partitions that number their own rows, so neither a hot
source nor many equal texts meet in one task.  Only key, size and checksum are sorted, never texts.

Edge cases: a null or empty text has size 1 and checksum 0; null languages and sources count as empty
ones; a null key comes first among its equals; repeated rows get slots of their own; with fewer
rows than shards some shards are empty; an empty table gives an empty result; columns named like a
result are left out.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import numbered

DIMS, BITS = 3, 5
SHARDS = 16
LAW = "rows"
#: Most rows of one written file.
ROWS_PER_FILE = 100_000


@lru_cache(maxsize=4)
def curve_table(dims: int = DIMS) -> tuple[list[int], list[int]]:
    """``(digit, next)``: digit of the curve index and following state, at ``state * 2**dims + corner``.

    A state is an entry corner and a direction.  Corners of a cube are visited in Gray code order, turned
    so that the visit begins at the entry and leaves along the direction; each subcube is entered
    where its predecessor was left.
    """
    n, size = dims, 1 << dims

    def gray(i: int) -> int:
        return i ^ i >> 1

    def ones_below(i: int) -> int:  # trailing ones
        return (~i & i + 1).bit_length() - 1

    def turned(v: int, by: int) -> int:  # rotated left within n bits
        by %= n
        return (v << by | v >> n - by) & size - 1

    rank = {gray(i): i for i in range(size)}
    digit, after = [], []
    for state in range(n * size):
        entry, direction = state % size, state // size
        for corner in range(size):
            i = rank[turned(corner ^ entry, -(direction + 1))]
            enter = gray(2 * ((i - 1) // 2)) if i else 0
            along = 0 if i == 0 else ones_below(i - 1 if i % 2 == 0 else i) % n
            digit.append(i)
            after.append((direction + along + 1) % n * size + (entry ^ turned(enter, direction + 1)))
    return digit, after


def curve_index(places: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a point with whole coordinates below ``2**bits``."""
    n = len(places)
    digit, after = curve_table(n)
    digits, states = F.array(*map(F.lit, digit)), F.array(*map(F.lit, after))
    corners = F.array(*[
        sum((F.shiftright(p, level).bitwiseAND(F.lit(1)) * (1 << j) for j, p in enumerate(places)), F.lit(0))
        for level in reversed(range(bits))])
    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("s"))

    def step(at: Column, corner: Column) -> Column:
        cell = at["s"] * (1 << n) + corner
        return F.struct((at["h"] * (1 << n) + F.get(digits, cell)).alias("h"), F.get(states, cell).alias("s"))

    return F.aggregate(corners, start, step, lambda at: at["h"])


def bucket(value: Column, bits: int = BITS) -> Column:
    """A value without order, spread over ``2**bits`` places by its MD5."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(1 << bits))


def size_class(size: Column, bits: int = BITS) -> Column:
    """Number of binary digits after the first."""
    return F.least(F.length(F.bin(size)) - 1, F.lit((1 << bits) - 1))


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text",
                  lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, keep..., size, text_crc32, curve, law, shard, slot, grown_shard)`` of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(whole) + 1).cast("bigint")
    rows = docs.select(
        key, *keep, size.alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        curve_index([bucket(F.col(lang)), bucket(F.col(source)), size_class(size)]).alias("curve"))
    ranked = numbered(rows, [], [F.col(c).asc() for c in ("curve", key, "size", "text_crc32")], "_rank")
    total = ranked.agg(F.count("*").alias("n")).select(F.col("n")).scalar()
    rank = F.col("_rank") - 1
    placed = ranked.withColumn("_n", total).withColumn("shard", F.expr(f"(_rank - 1) * {shards} div _n").cast("int"))
    first = F.expr(f"(shard * _n + {shards - 1}) div {shards}")
    return placed.select(
        key, *keep, "size", "text_crc32", "curve", F.lit(LAW).alias("law"), "shard",
        (rank - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_per_file: int = ROWS_PER_FILE, **columns: str) -> None:
    """All columns of ``docs`` as Parquet under ``path``: a folder per shard, rows in the order of their slots.

    A shard is cut into files along the curve, and each file holds one run of slots, so a reader that filters on
    language or source skips files by the extents and dictionaries they hold.  Ranges of slots are dealt over
    tasks: no task writes a whole shard of a large corpus.  Columns of ``docs`` named like a result are kept
    in the files; ``shard`` and ``slot`` are those of the assignment.
    """
    taken = ("size", "text_crc32", "curve", "law", "shard", "slot", "grown_shard")
    key, text = columns.get("key", "doc_id"), columns.get("text", "text")
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    row = docs.select(key, text, *[columns.get(c, c) for c in ("lang", "source")], F.struct(*[docs[c] for c in kept]).alias("whole_row"))
    placed = assign_shards(row, shards, keep=("whole_row",), **columns).select("whole_row.*", *taken[4:6])
    ranged = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
