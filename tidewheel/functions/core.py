"""Scalar functions: portable hashes, power-of-two arithmetic, rates, names and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2_147_483_647
#: fixed values: multipliers and offsets of the row hashes, drawn once below P
A = (1103515245, 1220703125, 742938285, 950706376, 1226874159, 62089911, 1343714438, 630360016, 397204094)
B = (12345, 907633385, 1442695040, 362436069, 521288629, 88675123, 5783321, 6615241, 123456789)


def row_hash(key: Column, row: int, width: int) -> Column:
    """Cell of an integer key in a sketch row; rows use independent functions. Products stay below 2**62."""
    return ((F.lit(A[row]).cast("long") * F.pmod(key, F.lit(P)) + F.lit(B[row])) % F.lit(P)) % F.lit(width)


def string_key(s: Column) -> Column:
    """A 32-bit integer from a string, the same in other engines."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def unit_draw(seq: Column, salt: str = "") -> Column:
    """A number in [0, 1) from a row's sequence number, the same in any run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), seq.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def object_hash(*cols: Column) -> Column:
    """Hash of any value, for placement inside Spark."""
    return F.xxhash64(*cols)


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two above n: 65536 gives 131072."""
    bits = F.length(F.conv(n.cast("string"), 10, 2))
    return F.when(n <= 0, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), bits).cast("long"))


def is_power_of_two(n: Column) -> Column:
    """Zero counts as one."""
    return n.bitwiseAND(n - 1) == 0


def is_prime(n: Column) -> Column:
    """By division up to the square root."""
    up_to = F.sequence(F.lit(2), F.greatest(F.floor(F.sqrt(n.cast("double"))).cast("int"), F.lit(2)))
    return (n >= 2) & ~F.exists(up_to, lambda d: (d < n) & (n % d == 0))


def slot(key: Column, capacity: int) -> Column:
    return F.pmod(key, F.lit(capacity))


def mac_bytes(text: Column) -> Column:
    """Six bytes of a colon-separated address; equality and hash are those of binary values."""
    return F.unhex(F.regexp_replace(text, ":", ""))


def mega(value: Column) -> Column:
    return value / F.lit(1e6)


def rates(tx_pkts: Column, rx_pkts: Column, rx_bytes: Column, seconds: Column) -> list[Column]:
    """bps and pps truncated to integers, loss as a share (0 if nothing was sent)."""
    loss = F.when(tx_pkts > 0, F.lit(1.0) - rx_pkts / tx_pkts).otherwise(F.lit(0.0))
    return [(rx_bytes * 8 / seconds).cast("long").alias("bps"), (rx_pkts / seconds).cast("long").alias("pps"), loss.alias("loss")]


def per_core(value: Column, cores: Column) -> Column:
    return value / cores


def percent(part: Column, whole: Column) -> Column:
    """As '%5.2f%%' prints it in C: the double itself is rounded, a tie to the even digit (format_string would round the shortest
    decimal that reads as the double, a tie up)."""
    return F.format_string("%5s%%", F.call_function("format_number", F.lit(100.0) * part / whole, F.lit("0.00")))


def humanised(value: Column) -> Column:
    """With an SI suffix: 12345678 gives '12.3M'."""
    def at(scale: float, suffix: str) -> Column:
        return F.concat(F.format_number(value / F.lit(scale), 1), F.lit(suffix))

    return F.when(value >= 1e9, at(1e9, "G")).when(value >= 1e6, at(1e6, "M")).when(value >= 1e3, at(1e3, "k")).otherwise(at(1.0, ""))


def stem(path: Column) -> Column:
    """The file name without directories and without any extension."""
    return F.regexp_extract(F.regexp_replace(path, "^.*/", ""), r"^[^.]+", 0)


def experiment_name(trace: Column, dist: Column, zipf: Column, flows: Column, nf: Column, batch: Column) -> Column:
    """trace-single-core-nf, with synthetic traces named by their distribution and an optional logical batch."""
    synthetic = F.when(dist == "zipf", F.concat(F.lit("zipf-s"), F.replace(zipf.cast("string"), F.lit("."), F.lit("-")), F.lit("-f"), flows.cast("string"))).otherwise(F.concat(F.lit("uniform-f"), flows.cast("string")))
    suffix = F.when(batch.isNotNull(), F.concat(F.lit("-lbatch"), batch.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.coalesce(stem(trace), synthetic), F.lit("-single-core-"), nf, suffix)


def nf_and_technique(name: Column) -> list[Column]:
    """'fw_batch_lazy_multicore' is nf fw, technique lazy; without 'batch' the technique is baseline."""
    parts = F.split(name, "_")
    technique = F.when(F.array_contains(parts, "batch"), F.get(parts, 2)).otherwise(F.lit("baseline"))
    return [F.get(parts, 0).alias("nf"), technique.alias("technique")]
