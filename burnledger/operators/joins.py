"""Join of a fact with a lookup table whose size is not known in advance."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
SALT = "__salt"


def broadcast_limit(df: DataFrame) -> int:
    """The session's broadcast threshold in bytes; -1 switches broadcasting off."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.strip().lower()
    digits = text.rstrip("bkmg")
    suffix = text[len(digits):len(digits) + 1] or "b"
    return int(digits) * units[suffix]


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's own size estimate is within the broadcast threshold."""
    limit = broadcast_limit(df)
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(str(size)) <= limit
    except AttributeError:  # no access to the plan, e.g. on a remote session
        return False


def lookup_join(fact: DataFrame, lookup: DataFrame, on: dict[str, str], how: str = "inner",
                condition: Callable[[DataFrame, DataFrame], Column] | None = None,
                salt_by: list[str] | None = None, keep_salt: bool = False) -> DataFrame:
    """Equi-join ``fact`` with ``lookup`` (keys ``{fact column: lookup column}``).

    A lookup within the broadcast threshold is left to Catalyst, which then
    broadcasts it: the fact is not shuffled. A larger lookup is copied once per
    salt and both sides are hashed on key and salt, so that one key holding a
    large part of the fact is spread over ``SALTS`` tasks. The salt is a hash
    of ``salt_by`` columns: a recomputed task assigns the same one. With
    ``keep_salt`` the salt stays in the result, and a next lookup on the same
    key finds the fact already in place. The lookup columns used as keys are
    dropped.
    """
    keys, drop = dict(on), list(on.values())
    if salt_by and not fits_broadcast(lookup):
        if SALT not in fact.columns:
            fact = fact.withColumn(SALT, F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int"))
        lookup = lookup.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys[SALT] = "__copy"
        drop.append("__copy")
    terms = [fact[left] == lookup[right] for left, right in keys.items()]
    if condition is not None:
        terms.append(condition(fact, lookup))
    joined = fact.join(lookup, reduce(and_, terms), how)
    if how not in ("left_semi", "left_anti"):
        joined = joined.drop(*drop)
    return joined if keep_salt else joined.drop(SALT)


def fold_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row tables side by side without a cross join.

    The rows are stacked with NULL for the columns a table lacks and folded by
    ``max``, which skips NULL.
    """
    stacked = first
    for other in others:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
