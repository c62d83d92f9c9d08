"""Provenance: unpivoting records, resolving candidates, conflicts, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.operators.joins import join_counted
from galena.sources.tables import materialize


def unpivot_facts(df: DataFrame, id: list[str], fields: list[str]) -> DataFrame:
    """(id, field, value) with trimmed text; null and empty values are no facts."""
    rows = df.select(*id, *[F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias(f) for f in fields])
    return rows.unpivot(id, fields, "field", "value").where(F.col("value").isNotNull())


def resolve_candidates(values: DataFrame, entity: list[str], value: str, priority: str, confidence: str, at: str, id: str) -> DataFrame:
    """The selected value of each entity: priority ascending, confidence and time descending, id.

    ``conflict``: more than one distinct value; ``reason``: what the first two candidates differ in.
    One window gives the order and its successor; distinct values are counted as min <> max.
    """
    rows = values.where(F.col(value).isNotNull())
    order = Window.partitionBy(*entity).orderBy(F.col(priority).asc(), F.col(confidence).desc(), F.col(at).desc(), F.col(id).asc(), F.col(value).asc())
    whole = Window.partitionBy(*entity)
    ranked = rows.withColumns({"__rank": F.row_number().over(order), "__p": F.lead(priority).over(order), "__c": F.lead(confidence).over(order), "conflict": F.min(value).over(whole) != F.max(value).over(whole)})
    reason = F.when(F.col("__p").isNull(), "single-value").when(F.col(priority) != F.col("__p"), "priority").when(F.col(confidence) != F.col("__c"), "confidence").otherwise("recency")
    return ranked.where("__rank = 1").select(*entity, F.col(value).alias("selected"), "conflict", reason.alias("reason"), F.col(id).alias("selected_id"))


def sync_conflicts(open_: DataFrame, resolved: DataFrame, entity: list[str]) -> DataFrame:
    """Conflicts after a run: opened, kept open, or resolved automatically."""
    now = resolved.where("conflict").select(*entity, F.lit(True).alias("__now"))
    before = open_.select(*entity, F.lit(True).alias("__before"))
    both = before.join(now, entity, "full_outer")
    return both.select(*entity, F.when(F.col("__before").isNull(), "OPENED").when(F.col("__now").isNull(), "AUTO_RESOLVED").otherwise("OPEN").alias("status"))


def pivot_selected(resolved: DataFrame, entity: list[str], field: str, value: str, spec: dict[str, str]) -> DataFrame:
    """One row for each entity with typed columns; a value of another type becomes null."""
    wide = resolved.groupBy(*entity).pivot(field, list(spec)).agg(F.first(value))
    return wide.select(*entity, *[F.col(f).try_cast(kind).alias(f) for f, kind in spec.items()])


def change_detect(previous: DataFrame, incoming: DataFrame, key: str, lastmod: str, digest: str) -> DataFrame:
    """created, updated or unchanged for each incoming key: by lastmod first, then by content hash."""
    p = previous.select(F.col(key).alias("__k"), F.col(lastmod).alias("__m"), F.col(digest).alias("__d"))
    rows = incoming.join(p, F.col(key) == F.col("__k"), "left")
    status = F.when(F.col("__k").isNull(), "created").when(F.coalesce(F.col(lastmod) <= F.col("__m"), F.lit(False)) | F.col(digest).eqNullSafe(F.col("__d")), "unchanged").otherwise("updated")
    return rows.select(key, status.alias("status"))


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of a table's rows that depends neither on their order nor on how they are dealt out.

    Each row's SHA-256 is cut into four numbers of 60 bits; their sums over all rows, and the number of rows,
    are hashed. Sums combine in the map tasks, so nothing is gathered.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(columns)]), 256)
    pieces = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"s{k}") for k in range(4)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("rows"), *pieces)
    return sums.select(F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.coalesce(f"s{k}", F.lit(0)).cast("string") for k in range(4)]), 256).alias("digest"), "rows")


def worst_class(df: DataFrame, key: str, klass: str, order: list[str]) -> DataFrame:
    """The class of each key that stands last in ``order``."""
    names = F.array(*map(F.lit, order))
    return df.groupBy(key).agg(F.max(F.array_position(names, F.col(klass))).alias("__r")).select(key, F.element_at(names, F.col("__r").cast("int")).alias("class"))


def backfill_link(links: DataFrame, target: str, member: str) -> DataFrame:
    """The only member of each target; targets with several members get none."""
    return links.groupBy(target).agg(F.min(member).alias(member), F.max(member).alias("__high")).where(F.col(member) == F.col("__high")).drop("__high")


def rekey_plan(df: DataFrame, id: str, old: str, new: Column) -> DataFrame:
    """Old and new key of each row whose key changes, and whether the new one is taken by another row."""
    rows = df.select(id, F.col(old).alias("old_key"), new.alias("new_key"))
    taken = rows.groupBy("new_key").agg(F.count("*").alias("__n"))
    return rows.join(taken, "new_key").where(~F.col("old_key").eqNullSafe(F.col("new_key"))).select(id, "old_key", "new_key", (F.col("__n") > 1).alias("collision"))


def run_summary(rows: DataFrame, run: str, outcome: str) -> DataFrame:
    """Counters of each run (created, updated, unchanged, error) and its status: PARTIAL if anything failed."""
    n = {name: F.count_if(F.col(outcome) == kind).alias(name) for name, kind in (("created", "created"), ("updated", "updated"), ("unchanged", "unchanged"), ("errors", "error"))}
    return rows.groupBy(run).agg(F.count("*").alias("seen"), *n.values()).withColumn("status", F.when(F.col("errors") > 0, "PARTIAL").otherwise("SUCCESS"))


def product_plan(clusters: DataFrame, existing: DataFrame) -> DataFrame:
    """What happens to the product of each cluster of a split plan, and whether its key collides.

    ``clusters``: grp, cluster, product (of the first record), key (planned), shared (records of the product outside
    the plan); ``existing``: key, product. The first cluster of a product keeps it unless others share it; a cluster
    whose planned key is there already reuses that product; all others are created. Two clusters with one planned
    key collide, and so does a key that belongs to a product outside the plan's own.
    """
    # A product may have any number of clusters: its first one and the number of each key are aggregated and joined back.
    rows = materialize(clusters.join(existing.select(F.col("key"), F.col("product").alias("there")), "key", "left").withColumn("__known", F.coalesce("product", F.lit(""))))
    first = rows.groupBy("__known").agg(F.count("*").alias("__n"), F.min(F.struct("grp", "cluster")).alias("__first"))
    keys = rows.groupBy("key").agg(F.count("*").alias("__planned"))
    rows = join_counted(join_counted(rows, first, "__known", "__n"), keys, "key", "__planned")
    is_first = F.col("__first") == F.struct("grp", "cluster")
    action = F.when(is_first & (F.col("shared") == 0), "KEEP").when(F.col("there").isNotNull(), "REUSE").otherwise("CREATE")
    outside = F.coalesce(F.col("there") != F.col("product"), F.lit(False))
    collision = F.when(F.col("__planned") > 1, "DUPLICATE_PLANNED_KEY").when(outside & (action == "KEEP"), "KEY_OUTSIDE_PLAN")
    return rows.select("grp", "cluster", action.alias("action"), collision.alias("collision"))


def apply_split(rows: DataFrame, plan: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """``rows`` with the owner that the plan gives them. The plan must name a row once: else rows would multiply.

    The counts before and after are compared before the result is handed on.
    """
    if plan.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a record is in the plan twice")
    moved = materialize(rows.join(plan.select(*keys, F.col(owner).alias("__to")), keys, "left").withColumn("split", F.col("__to").isNotNull()).withColumn(owner, F.coalesce("__to", owner)).drop("__to"))
    if moved.count() != rows.count():
        raise ValueError("the split would change the number of records")
    return moved
