"""python -m chronolake.cli PATH put KEY VALUE | get KEY | del KEY | scan | fill N BYTES | bench N BYTES"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.store import Store


def generated(spark: SparkSession, n: int, size: int, prefix: str = "key_") -> DataFrame:
    """n puts of zero-padded keys and random alphanumeric values."""
    return spark.range(n).select(F.col("id").alias("op_idx"), F.format_string(f"{prefix}%010d", "id").alias("user_key"), F.lit(1).alias("type"), F.randstr(F.lit(size), F.lit(0)).alias("value"))


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in ("put", "get", "del", "scan", "fill", "bench"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("chronolake").getOrCreate()
    path, command, *rest = args
    with Store.open(spark, path) as store:
        if command == "put":
            store.put(*rest)
        elif command == "del":
            store.delete(*rest)
        elif command == "get":
            value = store.get(*rest)
            print("NOT_FOUND" if value is None else value)
            return int(value is None)
        elif command == "scan":
            store.for_each(lambda k, v: print(f"{k}\t{v}"))
        else:
            n, size = int(rest[0]), int(rest[1]) if len(rest) > 1 else 512
            t = time.time()
            store.write_ops(generated(spark, n, size, "fill_" if command == "fill" else "key_"))
            print(f"{n} writes, {n / (time.time() - t):.0f} a second")
            if command == "bench":
                keys = spark.range(n).select(F.format_string("key_%010d", F.floor(F.rand(1) * n).cast("long")).alias("user_key"))
                t = time.time()
                found = store.multi_get(keys).where("found").count()
                print(f"{n} reads, {found} found, {n / (time.time() - t):.0f} a second")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
