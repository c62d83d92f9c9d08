"""Product identifiers anywhere in JSON payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions.reference import gtin_valid
from galena.sources.tables import materialize

# Keys of identifiers, in lower case and without other signs, by type.
KEYS = {
    "EAN": ["ean", "ean8", "ean13"],
    "GTIN": ["gtin", "gtin8", "gtin12", "gtin13", "gtin14", "barcode"],
    "UPC": ["upc", "upca"],
    "MPN": ["mpn"],
    "OFFICIAL_SKU": ["sku", "itemsku", "productid"],
}
# How many digits a code of each type has.
LENGTHS = {"EAN": [8, 13], "GTIN": [8, 12, 13, 14], "UPC": [12]}
#: A list of {type, rawValue} under this key names its types itself.
LISTED = "officialIdentifiers"


def identifier_type(key: Column) -> Column:
    """The type of identifier that a key names, in any spelling (``EAN13``, ``item-SKU``); null if none."""
    bare = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    return F.coalesce(*[F.when(bare.isin(names), kind) for kind, names in KEYS.items()])


def identifier_value(kind: Column, raw: Column) -> Column:
    """The normal form of an identifier: digits of a right length whose check digit fits, or upper-case text of few signs; else null."""
    digits = F.regexp_replace(raw, "[\\s-]", "")
    fits = reduce(Column.__or__, [(kind == k) & F.length(digits).isin(n) for k, n in LENGTHS.items()])
    text = F.regexp_replace(F.upper(F.trim(raw)), "\\s+", " ")
    coded = F.when(fits & gtin_valid(digits), digits)
    return F.when(kind.isin(list(LENGTHS)), coded).when(kind.isin("MPN", "OFFICIAL_SKU") & text.rlike("^[A-Z0-9][A-Z0-9 ._/-]*$"), text)


def identifier_walk(df: DataFrame, id: str, value: str) -> DataFrame:
    """(id, path, field, type, raw, normalized, valid) of all identifiers in a variant column, at any depth.

    A key that names a type holds a text, a number, or lists of them; a list of ``officialIdentifiers`` names the type in each
    entry (UNCLASSIFIED if it is none). Blank values, booleans, nulls and objects are no values. The walk goes on level by level
    while objects or lists are left, so it ends with the deepest payload; what is no object or list leaves it at once.
    """
    v = F.col("v")
    is_list, is_object = F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    text = F.trim(F.try_variant_get(v, "$", "string"))
    told = F.when(~is_list & ~is_object & (F.schema_of_variant(v) != "BOOLEAN") & (text != ""), text)
    inferred, own = identifier_type(F.col("key")), F.coalesce(F.col("key") == LISTED, F.lit(False))
    # What becomes of a child: walk into it, read it as values of a type, or read it as a list of typed entries.
    walked = F.col("mode") == "walk"
    named = F.try_variant_get(v, "$.type", "string")
    typed = F.when(named.isin(list(KEYS)), named).otherwise("UNCLASSIFIED")
    entry = F.try_variant_get(v, "$.rawValue", "variant")

    def step(mode: str, field: Column, kind: Column, path: Column, child: Column) -> Column:
        return F.struct(F.lit(mode).alias("mode"), field.alias("field"), kind.alias("type"), path.alias("path"), child.alias("v"))

    none = F.lit(None).cast("string")
    steps = [
        F.when(walked & ~own, step("walk", none, none, F.col("path"), v)),
        F.when(walked & ~own & inferred.isNotNull(), step("value", F.col("key"), inferred, F.col("path"), v)),
        F.when(walked & own & is_list, step("listed", F.col("key"), none, F.col("path"), v)),
        F.when(F.col("mode") == "value", step("value", F.col("field"), F.col("type"), F.col("path"), v)),
        F.when((F.col("mode") == "listed") & is_object & entry.isNotNull(), step("value", F.col("field"), typed, F.concat("path", F.lit(".rawValue")), entry)),
    ]
    level = df.select(id, F.lit("walk").alias("mode"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("type"), F.lit("$").alias("path"), F.col(value).alias("v")).where(v.isNotNull())
    found: list[DataFrame] = []
    while True:
        below = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("below")))
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        children = below.select(id, "mode", "field", "type", "key", F.concat("path", name).alias("path"), F.col("below").alias("v"))
        rows = children.select(id, F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("s")).select(id, "s.*")
        rows = rows.select("*", is_list.alias("list"), (is_list | is_object).alias("more"), told.alias("raw"))
        rows = materialize(rows.where((F.col("mode") != "value") & F.col("more") | (F.col("mode") == "value") & (F.col("list") | F.col("raw").isNotNull())))
        found.append(rows.where("mode = 'value' AND NOT list").select(id, "path", "field", "type", "raw"))
        level = rows.where("more AND (mode <> 'value' OR list)").select(id, "mode", "field", "type", "path", "v")
        if level.isEmpty():
            break
    values = reduce(DataFrame.unionByName, found).withColumn("normalized", identifier_value(F.col("type"), F.col("raw")))
    return values.withColumn("valid", F.col("normalized").isNotNull())


def identifier_report(values: DataFrame) -> DataFrame:
    """For each type: values, valid, invalid, and different valid ones."""
    return values.groupBy("type").agg(F.count("*").alias("found"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_distinct(F.when(F.col("valid"), F.col("normalized"))).alias("different"))
