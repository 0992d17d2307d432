"""Parameterised report queries over marts, with optional predicates.

A template marks optional conditions as [[AND column = :name]]. A parameter that isn't given
is null and its condition holds for all rows, so the plan is the same text whatever is chosen
and values never become part of the SQL.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_OPTIONAL = re.compile(r"\[\[\s*AND\s+(.*?)\]\]", re.S | re.I)
_PARAMETER = re.compile(r":(\w+)")


def expand(template: str, types: Mapping[str, str] | None = None) -> str:
    """Optional conditions as ordinary ones that a null parameter switches off; types: SQL types other than string."""

    def one(m: re.Match) -> str:
        kind = lambda p: (types or {}).get(p, "string")
        cond = _PARAMETER.sub(lambda p: f"cast(:{p[1]} as {kind(p[1])})", m[1].strip())
        names = dict.fromkeys(_PARAMETER.findall(m[1]))
        return "AND (" + " OR ".join(f"cast(:{p} as {kind(p)}) IS NULL" for p in names) + f" OR {cond})"

    return _OPTIONAL.sub(one, template)


def report(spark: SparkSession, template: str, marts: Mapping[str, DataFrame], types: Mapping[str, str] | None = None, **values) -> DataFrame:
    """The rows of a template over marts by name; parameters that aren't given are null."""
    sql = expand(template, types)
    args = {p: values.get(p) for p in _PARAMETER.findall(sql)}
    for name, df in marts.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args)
