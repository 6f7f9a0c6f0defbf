"""Folders for what several steps read: below ``spark.checkpoint.dir``, which all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.session import checkpoint_root, materialise

__all__ = ["bounded_sample", "fresh_folder", "materialise"]


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_root(spark)}/{kind}/{uuid.uuid4().hex}"


def bounded_sample(rows: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """At most ``most`` of ``total`` rows: those of the smallest hashes of ``key``.

    A bound on the hash leaves about a third more than wanted before rows are ordered, so tasks send the driver no more
    than that together, however many there are.
    """
    share = min(1.0, 1.3 * most / max(total, 1))
    point = F.shiftrightunsigned(F.xxhash64(key), 12) / float(1 << 52)
    return rows.filter(point < share).orderBy(point, key).limit(most)
