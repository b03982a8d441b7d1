"""Which partition a record goes to, and which member reads a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the 32-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295


def fnv1a32(b: Column | str) -> Column:
    """FNV-1a over bytes, as a non-negative BIGINT; null bytes are none."""
    b = F.col(b) if isinstance(b, str) else b
    digits = F.hex(b)
    byte = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    places = F.when(F.octet_length(b) > 0, F.sequence(F.lit(1), F.octet_length(b))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(FNV_BASIS).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * FNV_PRIME).bitwiseAND(FNV_MASK))


def partition_for(key: Column | str, n: int, keyless: Column) -> Column:
    """Keyed records by hash; others where ``keyless`` says."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(F.octet_length(key) > 0, fnv1a32(key) % n).otherwise(keyless).cast("int")


def sticky(ts_ns: Column | str, stick_ns: int, n: int) -> Column:
    """Keyless records of one stretch of time stay on one partition, the next stretch takes the next."""
    ts = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    return F.pmod(F.floor(ts / stick_ns), F.lit(n)).cast("int")


def range_assign(partitions: DataFrame, members: list[str]) -> DataFrame:
    """(topic, partition, member): contiguous slices for members in name order, the first ones one longer."""
    names = F.array(*[F.lit(m) for m in sorted(members)])
    return partitions.withColumn("slice", F.ntile(len(members)).over(Window.partitionBy("topic").orderBy("partition"))).select("topic", "partition", F.get(names, F.col("slice") - 1).alias("member"))


def range_assign_all(partitions: DataFrame, members: list[str]) -> DataFrame:
    """The same over all partitions of all topics as one list."""
    names = F.array(*[F.lit(m) for m in sorted(members)])
    return partitions.withColumn("slice", F.ntile(len(members)).over(Window.orderBy("topic", "partition"))).select("topic", "partition", F.get(names, F.col("slice") - 1).alias("member"))


def round_robin_assign(partitions: DataFrame, members: list[str]) -> DataFrame:
    """(topic, partition, member): partition i goes to member i mod n, in name order."""
    names = F.array(*[F.lit(m) for m in sorted(members)])
    place = F.row_number().over(Window.orderBy("topic", "partition")) - 1
    return partitions.select("topic", "partition", F.get(names, F.pmod(place, F.lit(len(members)))).alias("member"))


def sticky_assign(partitions: list[tuple[str, int]], members: list[str], prior: dict[str, list[tuple[str, int]]]) -> dict[str, list[tuple[str, int]]]:
    """Members keep what they had up to a fair share; what is free goes round in name order."""
    names, pool = sorted(members), sorted(partitions)
    if not names:
        return {}
    low, more = divmod(len(pool), len(names))
    share = {m: low + (k < more) for k, m in enumerate(names)}
    exists, out, taken = set(pool), {m: [] for m in names}, set()
    for m in names:
        for p in sorted(prior.get(m, [])):
            if p in exists and p not in taken and len(out[m]) < share[m]:
                out[m].append(p)
                taken.add(p)
    free = [p for p in pool if p not in taken]
    for m in names:
        while len(out[m]) < share[m]:
            out[m].append(free.pop(0))
    return out
