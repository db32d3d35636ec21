"""Insert-or-ignore, orphan checks and retraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_ignore(
    existing: DataFrame,
    new: DataFrame,
    keys: list[str],
    order: list[str],
    small: bool = False,
) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose key it lacks; among new rows the first wins.

    ``small`` says that the keys of ``new`` may be broadcast. The existing keys are then
    only scanned for them, not shuffled.
    """
    rest = [c for c in existing.columns if c not in keys]
    if rest:
        first = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
        fresh = new.groupBy(*keys).agg(first).select(*keys, "row.*")
    else:
        fresh = new.select(*keys).distinct()
    known = existing.select(*keys)
    if small:
        known = known.join(F.broadcast(fresh.select(*keys)), keys, "left_semi")
    return existing.unionByName(fresh.join(known, keys, "left_anti"))


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``children`` that refer to no row of ``parents``."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti")


def retract(log: DataFrame, retracted: DataFrame, key: str = "source_id") -> DataFrame:
    """The log without some sources. Views over it lose their rows without further steps."""
    return log.join(retracted.select(key).distinct(), key, "left_anti")
