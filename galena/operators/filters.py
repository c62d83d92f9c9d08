"""Filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, text: str, columns: list[str], children: list[tuple[DataFrame, str, str, str]] = ()) -> DataFrame:
    """Rows where the text occurs, without regard to case, in a column or in a child (child, its key, own key, its column).

    Children become one semi join over the union of the matching keys, not an OR of EXISTS.
    """
    needle = text.lower()
    own = reduce(Column.__or__, [F.contains(F.lower(c), F.lit(needle)) for c in columns])
    if not children:
        return df.where(own)
    flags = [df]
    for i, (child, key, mine, column) in enumerate(children):
        keys = child.where(F.contains(F.lower(column), F.lit(needle))).select(F.col(key).alias(f"__k{i}")).distinct().withColumn(f"__f{i}", F.lit(True))
        flags.append(flags[-1].join(keys, F.col(mine) == F.col(f"__k{i}"), "left"))
    hit = reduce(Column.__or__, [own, *[F.col(f"__f{i}").isNotNull() for i in range(len(children))]])
    return flags[-1].where(hit).select(*df.columns)


def filter_hierarchy(own: DataFrame, inherited: DataFrame, tree: DataFrame, key: str, node: str, name: str, parent: str, slug: str, mode: str = "override") -> DataFrame:
    """Keys whose node, or its parent, is ``slug``. ``override``: inherited nodes count only for keys without own ones."""
    given = inherited.select(key, node)
    if mode == "override":
        given = given.join(own.select(key).distinct(), key, "left_anti")
    nodes = own.select(key, node).unionByName(given)
    wanted = tree.where((F.col(name) == slug) | (F.col(parent) == slug)).select(node)
    return nodes.join(F.broadcast(wanted), node, "left_semi").select(key).distinct()


def filter_child_all(parents: DataFrame, children: DataFrame, on: str, predicates: list[Column]) -> DataFrame:
    """Parents with one child that meets all predicates at once."""
    return parents.join(children.where(reduce(Column.__and__, predicates)).select(on), on, "left_semi")


def tristate(column: str, wanted: str) -> Column:
    """``yes``, ``no`` or ``unknown``: a null is never taken for false."""
    if wanted == "unknown":
        return F.col(column).isNull()
    return F.col(column).eqNullSafe(F.lit(wanted == "yes"))


def fresh_within(column: str, as_of: str, hours: int) -> Column:
    """Whether a time lies in the ``hours`` up to ``as_of``; the future isn't fresh."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return F.coalesce((F.col(column) <= now) & (F.col(column) >= now - F.make_interval(hours=F.lit(hours))), F.lit(False))


def url_allowlist(column: str, hosts: list[str]) -> Column:
    """The URL if it is https, has no user or port, and an allowed host; else null, also for malformed ones."""
    host = F.lower(F.regexp_extract(column, "^https?://([^/?#:@]+)(?:[/?#]|$)", 1))
    return F.when(F.col(column).startswith("https://") & host.isin(hosts), F.col(column))
