"""Stable buckets and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def user_bucket(user_id: Column) -> Column:
    """MD5 of the id as a 128-bit number, modulo 100, without leaving the JVM.

    The two halves are taken apart: 2**64 is 16 modulo 100.
    """
    digest = F.md5(user_id.cast("string").cast("binary"))

    def half(start: int) -> Column:
        return F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)")

    return ((((half(1) % 100) * 16) + (half(17) % 100)) % 100).cast("int")


def fingerprint(params: Column) -> Column:
    """SHA-256 of a map written as JSON in key order, with a blank after ``,`` and ``:``."""

    def text(entry: Column) -> Column:
        value = F.to_json(F.array(entry["value"]))
        return F.concat(
            F.lit('"'), entry["key"], F.lit('": '), F.substr(value, F.lit(2), F.length(value) - 2)
        )

    pairs = F.transform(F.array_sort(F.map_entries(params)), text)
    return F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), 256)


def unit_hash(*cols: Column) -> Column:
    """A repeatable pseudo-random number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))
