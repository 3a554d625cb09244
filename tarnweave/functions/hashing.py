"""The bucket hash: sum of byte k times 3^(k+1), modulo 2^64, modulo the number of buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WRAP = 1 << 64


def to_bucket(text: Column, buckets: int) -> Column:
    """Bucket of the text's UTF-8 bytes. Decimals hold the sums, which would overflow a long."""
    wide = "decimal(38,0)"
    octets = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1,"), ","), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("decimal(3,0)"))
    start = F.struct(F.lit(0).cast(wide).alias("sum"), F.lit(3).cast(wide).alias("power"))

    def step(acc: Column, byte: Column) -> Column:
        wrap = F.expr(f"cast({_WRAP}BD as decimal(20,0))")
        product = (acc["power"].cast("decimal(20,0)") * byte.cast("decimal(3,0)")).cast(wide)
        power = (acc["power"].cast("decimal(20,0)") * F.lit(3).cast("decimal(1,0)")).cast(wide)
        return F.struct(((acc["sum"] + product) % wrap).cast(wide).alias("sum"), (power % wrap).cast(wide).alias("power"))

    return F.aggregate(octets, start, step, lambda acc: (acc["sum"] % F.lit(buckets).cast("decimal(20,0)")).cast("int"))
