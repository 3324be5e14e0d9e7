"""Locale tags and the collations Spark has for them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@functools.lru_cache
def _known(spark: SparkSession) -> frozenset[str]:
    """Names of the collations that tell case and accents apart."""
    rows = spark.sql("SELECT name FROM collations() WHERE name NOT LIKE '%\\_CI%' AND name NOT LIKE '%\\_AI%' AND name NOT LIKE '%RTRIM%'").collect()
    return frozenset(r[0] for r in rows)


def collation(spark: SparkSession, tag: str) -> str:
    """The collation of a tag; an unknown region falls back to its language, an unknown language to the root."""
    if tag == "und":
        return "UNICODE"
    known = _known(spark)
    language, *rest = tag.split("-")
    script = [p for p in rest if len(p) == 4]
    region = [p for p in rest if len(p) < 4]
    base = "_".join([language, *script])
    if region:
        of = [n for n in known if n.rpartition("_")[0] == base and len(n.rpartition("_")[2]) == 3]
        letters = lambda n: n.rpartition("_")[2]  # noqa: E731  three letters for a country, the tag has two
        matches = [n for n in of if letters(n).startswith(region[0])] or [n for n in of if letters(n)[0] == region[0][0] and region[0][1] in letters(n)[1:]]
        if len(matches) == 1:
            return matches[0]
    for name in (base, language):
        if name in known:
            return name
    return "UNICODE"


def collated(spark: SparkSession, c: Column, tag: str) -> Column:
    return F.collate(c, collation(spark, tag))
