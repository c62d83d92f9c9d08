"""Classification by rules held as rows, and matching decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions.text import title_match


# Names and patterns of commercial contexts, kinds and formats of references that are no collector's.
RETAILERS = ["alcampo", "asda", "carrefour", "carrefour; super u", "edeka", "frankfurt duty free", "hamleys", "hertie", "idee & spiel", "intermarché", "jc penney", "karstadt", "kaufhof", "kaufhof real/metro", "kaufland", "migros", "montgomery ward", "müller", "netto", "nkd", "otto versand", "quelle", "real/metro", "rossmann", "sears", "smyths toys", "spiel & spaß", "spielzeug ring", "target", "target toys r us", "thalia", "toom baumarkt", "toys r us", "vedes", "woolworth", "zara"]
ORGANIZATIONS = ["adac", "bvg", "cruz roja", "dfb stars", "dlrg", "e-esa", "eidgenössischer schwingerverband", "elpida", "fao", "german-maltese circle", "johanniter-unfall-hilfe e.v.", "nhl", "öfb", "police nationale", "pulizija malta", "puttinu cares", "sbb", "share the smile", "sparkasse", "tcs (the touring club of switzerland)", "thw", "wwf"]
GENERIC = "^(aucun|blister-pack|color|edicions limitada|export exclusif|exklusiv sets|francia|give-away|kindergarten set|méxico|netherland|oui|special plus|symbol-box|yes)$"
PUBLICATIONS = "(magazin|magazine|revista|comic|books?\\b|hörspiel|audio|aventura de la historia|aventures de l'histoire|collection argentina|collector'?s book|éditions|verlag|hachette|france loisirs|casterman|hoëbeke|schneiderbuch|yps\\b)"
EVENTS = "(toy fair|funpark|factory tour|festival|exposition|museum|musée|tourism|tourismus|city of culture|rijks museum|van gogh museum|drupa|zirndorf)"
INSTITUTIONS = "(ministerium|stadt |universität|feuerwehr|verband|foundation|stiftung|touring club|symfon|symphon|wasserwirtschaft)"
OTHER_KINDS, OTHER_FORMATS = ["PART", "MERCHANDISE", "CATALOGUE", "PROMOTIONAL_ITEM"], ["Magazin", "Keychains", "Decoration toy"]
BOXED = "kind = 'SET' and format in ('Standard Box', 'Carrying Case')"
PACKED = "format in ('Special', 'Blister', 'Bag', 'Pillow Box', 'Easter Egg')"  # formats named after a brand are left to the caller
BUILT = "(instructions or part_types >= 8)"
#: Class of an article, the first rule that holds. Facts: assigned, kind, format, variant_kind, figures, pieces,
#: animal, people, building, direct_building, vehicle, strong_vehicle, accessory, instructions, part_types.
CLASS_RULES = [
    ("not assigned", "UNKNOWN"),
    ("kind = 'CATALOGUE' or format = 'Magazin'", "CATALOGUE"),
    ("kind in ('PROMOTIONAL_ITEM', 'MERCHANDISE') or variant_kind = 'PROMOTION'", "PROMOTIONAL"),
    ("kind = 'PART'", "PART"),
    ("kind = 'ACCESSORY'", "ACCESSORY"),
    ("format = 'DS' and animal and not people and coalesce(figures, 0) <= 1 and not building and not vehicle", "ANIMAL"),
    ("(kind = 'FIGURE' or format = 'Figures') and coalesce(figures, 1) > 1", "FIGURE_PACK"),
    ("kind = 'FIGURE' or format = 'Figures'", "SINGLE_FIGURE"),
    ("format = 'Duo Pack'", "FIGURE_PACK"),
    (f"{PACKED} and figures > 1", "FIGURE_PACK"),
    (f"{PACKED} and figures is not null", "SINGLE_FIGURE"),
    ("format in ('Keychains', 'Decoration toy', 'Puzzle', 'Calendar') or accessory", "ACCESSORY"),
    (f"{BOXED} and coalesce(pieces, 0) >= 150", "MAIN_SET"),
    (f"{BOXED} and strong_vehicle", "VEHICLE_SET"),
    (f"{BOXED} and (direct_building or building and {BUILT})", "BUILDING_SET"),
    (f"{BOXED} and vehicle and {BUILT}", "VEHICLE_SET"),
    (BOXED, "SMALL_SET"),
    ("kind = 'SET' and format = 'DS'", "ACCESSORY"),
]
CLASS_ORDER = ["MAIN_SET", "BUILDING_SET", "VEHICLE_SET", "SMALL_SET", "FIGURE_PACK", "SINGLE_FIGURE", "ANIMAL", "ACCESSORY", "PART", "CATALOGUE", "PROMOTIONAL", "UNKNOWN"]


def reference_group(identity_class: Column, normalized: Column, base: Column, kind: Column, form: Column) -> Column:
    """COMMERCIAL, SPECIAL or NON_COLLECTOR: numbers of three or four digits, or of five from 70000 to 72999, are commercial."""
    normal, number = F.upper(F.trim(normalized)), F.upper(F.trim(F.coalesce(base, normalized)))
    none = identity_class.isin("PLACEHOLDER", "AMBIGUOUS") | normal.rlike("^(N/?A|UNKNOWN|NONE|NULL|UNASSIGNED)$") | number.rlike("^0+$")
    other = kind.isin(OTHER_KINDS) | F.coalesce(form.isin(OTHER_FORMATS), F.lit(False))
    return F.when(none, "NON_COLLECTOR").when(number.rlike("^([0-9]{3,4}|7[0-2][0-9]{3})$") & ~other, "COMMERCIAL").otherwise("SPECIAL")


def commercial_context(label: Column, tags: Column) -> Column:
    """What a partner's name stands for, from the most certain evidence to the least."""
    name = F.regexp_replace(F.trim(label), "\\s+", " ")
    low = F.lower(name)
    promoted = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)) == "promotional") | low.rlike("\\b(promocional|promotional)\\b")
    return (
        F.when(F.coalesce(name == "", F.lit(True)) | low.rlike(GENERIC), "OTHER_DOCUMENTED_CONTEXT")
        .when(low.rlike(PUBLICATIONS), "MAGAZINE_PUBLICATION")
        .when(low.rlike(EVENTS), "EVENT_VENUE")
        .when(low.isin(RETAILERS), "RETAILER_DISTRIBUTOR")
        .when(low.isin(ORGANIZATIONS) | low.rlike(INSTITUTIONS), "ORGANIZATION_ASSOCIATION")
        .when(promoted, "PROMOTIONAL_CAMPAIGN")
        .when(low.rlike("^exclusive (greece lyra|brazil trol)$"), "OTHER_DOCUMENTED_CONTEXT")
        .otherwise("BRAND_LICENSE_PARTNER")
    )


def lookup_decision(identity_class: Column, base: Column, using_base: Column, found: Column) -> Column:
    """(status, reason) of a lookup in an outside catalogue: never more than one local and one outside match."""

    def told(status: str, reason: str | None = None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))

    number = F.coalesce(F.trim(base), F.lit(""))
    return (
        F.when(identity_class != "ASSIGNED", told("SKIP", "UNSAFE_IDENTITY"))
        .when(~number.rlike("^[0-9]{3,8}$") | number.rlike("^0+$"), told("SKIP", "NON_NUMERIC_REFERENCE"))
        .when(using_base != 1, told("REVIEW", "REUSED_BASE"))
        .when(found == 0, told("ABSENT"))
        .when(found != 1, told("REVIEW", "MULTIPLE_SOURCE_MATCHES"))
        .otherwise(told("MATCH_UNIQUE"))
    )


def wave_match(references: DataFrame, local: DataFrame) -> DataFrame:
    """Status and target product of each reference. ``local``: ref, variant_id, product_id, variant_kind, assigned."""
    n = local.groupBy("ref").agg(F.count_distinct("variant_id").alias("variants"), F.count_distinct("product_id").alias("products"), F.min("product_id").alias("product"), F.bool_and("assigned").alias("safe"), F.min(F.struct("variant_id", "variant_kind"))["variant_kind"].alias("kind"))
    rows = references.join(n, "ref", "left")
    status = F.when(F.col("variants").isNull(), "ABSENT").when(~F.col("safe"), "BLOCKED_IDENTITY").when((F.col("variants") == 1) & (F.col("kind") == "MARKET"), "MARKET_VARIANT_ONLY").when(F.col("variants") == 1, "MATCH_UNIQUE").when(F.col("products") == 1, "MATCH_PRODUCT_UNIQUE").otherwise("MATCH_MULTIPLE")
    target = F.when(F.coalesce("safe", F.lit(False)) & (F.col("products") == 1), F.col("product"))
    return rows.select(*references.columns, status.alias("status"), target.alias("target"), F.coalesce("variants", F.lit(0)).alias("variants"))


def offer_match(gtins: Column, known: Column, title: Column, brand: Column, reference: Column) -> Column:
    """(confidence in percent, reason): an equal code, a code that contradicts, or the brand and the reference in the title."""

    def told(confidence: int, reason: str) -> Column:
        return F.struct(F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    none = F.array().cast("array<string>")
    codes = F.transform(F.coalesce(gtins, none), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    known = F.coalesce(known, none)
    named = title_match(title, brand) & title_match(title, reference)
    return F.when(F.arrays_overlap(codes, known), told(100, "GTIN")).when((F.size(codes) > 0) & (F.size(known) > 0), told(0, "GTIN_CONFLICT")).when(F.coalesce(named, F.lit(False)), told(95, "BRAND_AND_REFERENCE")).otherwise(told(0, "NONE"))


def import_plan(references: DataFrame, observations: DataFrame, existing: DataFrame, agree: list[str]) -> DataFrame:
    """Status, preferred name (fr, de, en) and agreed facts of each reference. ``observations``: ref, confirmed, locale, name and facts."""
    seen = observations.where("confirmed")
    first = {k: F.min(F.when((F.col("locale") == k) & F.col("name").isNotNull(), F.struct("at", "name")))["name"] for k in ("fr", "de", "en")}
    facts = [F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in agree]
    per = seen.groupBy("ref").agg(F.count("*").alias("seen"), F.coalesce(*first.values()).alias("preferred"), *facts)
    rows = references.select("ref").join(per, "ref", "left").join(existing.select("ref").distinct().withColumn("there", F.lit(True)), "ref", "left")
    status = F.when(F.col("there"), "COLLISION_LOCAL_REFERENCE").when(F.col("seen").isNull(), "NO_OFFICIAL_CONFIRMATION").when(F.col("preferred").isNull(), "MISSING_OFFICIAL_NAME").otherwise("READY")
    return rows.select("ref", status.alias("status"), "preferred", *agree)


IMAGE_KINDS = ["box_front", "box_back", "main"]


def display_images(media: DataFrame, reviewed: DataFrame, official_hosts: list[str], disabled: list[str]) -> DataFrame:
    """(variant_id, place, url, kind): the images of each variant in the order of display, each address once.

    ``media``: variant_id, seq, url, kind, source, source_kind, can_display. What may not be displayed, comes from a
    disabled source or host, or has no safe address is left out; the collector's own photos need an explicit yes, and
    official ones an official host. Own photos come first, then official ones (the reviewed image of a variant before
    them: variant_id, url, kind), others, and the community's last; in each, boxes come before main images and the rest.
    """
    host = F.lower(F.regexp_extract("url", "^https://([^/?#:@]+)(?:[/?#]|$)", 1))
    rows = media.select("variant_id", "seq", "url", "kind", F.lower("source").alias("source"), "source_kind", "can_display", F.lit(False).alias("reviewed"))
    extra = reviewed.select("variant_id", F.lit(-1).cast(media.schema["seq"].dataType).alias("seq"), "url", "kind", F.lit("official").alias("source"), F.lit("OFFICIAL").alias("source_kind"), F.lit(True).alias("can_display"), F.lit(True).alias("reviewed"))
    told = rows.unionByName(extra).withColumn("host", host)
    allowed = F.coalesce(F.col("can_display"), F.lit(True)) & ~F.col("source").isin(disabled) & ~F.col("host").isin(disabled)
    safe = F.col("host") != ""
    tier = (
        F.when(F.col("source") == "personal", F.when(F.coalesce(F.col("can_display"), F.lit(False)) & (safe | F.startswith("url", F.lit("/collection-photos/"))), 0))
        .when(F.col("source_kind") == "OFFICIAL", F.when(safe & F.col("host").isin(official_hosts), 1))
        .when(safe & (F.col("source") == "community"), 3)
        .when(safe, 2)
    )
    at = F.array_position(F.array(*map(F.lit, IMAGE_KINDS)), F.lower("kind"))
    rank = F.when(at > 0, at - 1).otherwise(len(IMAGE_KINDS))
    kept = told.where(allowed).withColumn("tier", tier).where("tier is not null").withColumn("order", F.struct("tier", (~F.col("reviewed")).alias("r"), rank.alias("k"), "seq"))
    first = kept.groupBy("variant_id", "url").agg(F.min(F.struct("order", "kind")).alias("m"))
    place = F.row_number().over(Window.partitionBy("variant_id").orderBy("m.order", "url"))
    return first.select("variant_id", place.cast("long").alias("place"), "url", F.col("m.kind").alias("kind"))


def classify(rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule (predicate, label) that holds. Rules are data: text in order."""
    first, *rest = rules
    return reduce(lambda c, r: c.when(F.expr(r[0]), r[1]), rest, F.when(F.expr(first[0]), first[1])).otherwise(default)


def priority_of(c: Column, order: list[str], step: int = 10) -> Column:
    """The rank of a label: the first of ``order`` is the highest."""
    names = F.array(*map(F.lit, order))
    at = F.array_position(names, c)
    return F.when(at > 0, (F.lit(len(order)) - at) * step).otherwise(0).cast("int")


def candidate_status(evidence: DataFrame, key: str) -> DataFrame:
    """Status of each candidate from its evidence flags: imported, official, conflicting, corroborated, discovered."""
    e = evidence.groupBy(key).agg(F.bool_or("imported").alias("i"), F.bool_or("official").alias("o"), F.count_distinct("claim").alias("claims"), F.count_distinct("source").alias("sources"))
    status = F.when(F.col("i"), "IMPORTED").when(F.col("o"), "OFFICIAL").when(F.col("claims") > 1, "CONFLICTING").when(F.col("sources") > 1, "CORROBORATED").otherwise("DISCOVERED")
    return e.select(key, status.alias("status"), "sources")


def oversize_candidate(form: Column, variant: Column, product: Column) -> Column:
    """Whether a decoration toy is called XXL, as a word of its variant's or product's name."""
    names = F.concat(F.coalesce(variant, F.lit("")), F.lit(" "), F.coalesce(product, F.lit("")))
    return F.coalesce((form == "Decoration toy") & F.lower(names).rlike("(^|[^a-z0-9])xxl([^a-z0-9]|$)"), F.lit(False))


def candidate_plan(discovered: DataFrame, community: DataFrame, official: DataFrame, local: DataFrame, markets: list[str]) -> DataFrame:
    """A candidate for each reference that discovery snapshots list, with the evidence for it from all snapshots.

    ``discovered``: ref, order (of snapshots and their entries, no two alike), announced (year), url; ``community``: ref, announced; ``official``: ref, market,
    confirmed; ``local``: ref of products that are there. The first entry of a reference speaks for it, the others are counted as passed over. ``sources``
    has a bit for discovery (1), one for the community (2) and one for each market with a confirmation (4, 8, ..). A reference that is there
    already is a candidate only if it is confirmed. Years of the first entry and of all community rows that differ are a conflict.

    Every snapshot is reduced to a row for each reference by aggregates that combine in the map tasks; null years and references tell nothing.
    """
    first = discovered.where("ref IS NOT NULL").groupBy("ref").agg(F.min_by(F.struct("announced", "url"), "order").alias("f"), (F.count("*") - 1).alias("passed_over"))
    seen = community.groupBy("ref").agg(F.count("*").alias("community"), F.collect_set("announced").alias("told"))
    bit = F.coalesce(*[F.when(F.col("market") == m, 4 << i) for i, m in enumerate(markets)])
    confirmed = official.where("confirmed").groupBy("ref").agg(F.count("*").alias("official"), F.bit_or(bit).alias("bits"))
    rows = first.join(seen, "ref", "left").join(confirmed, "ref", "left").join(local.select("ref").distinct().withColumn("imported", F.lit(True)), "ref", "left")
    none = F.array().cast("array<int>")
    years = F.array_sort(F.array_distinct(F.concat(F.coalesce("told", none), F.when(F.col("f.announced").isNotNull(), F.array("f.announced")).otherwise(none))))
    rows = rows.select("ref", "f.*", "passed_over", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("community", "official", "bits")), F.coalesce("imported", F.lit(False)).alias("imported"), years.alias("years"))
    sources = 1 + F.when(F.col("community") > 0, 2).otherwise(0) + F.col("bits")
    conflict = F.size("years") > 1
    status = F.when(F.col("imported"), "IMPORTED").when(F.col("official") > 0, "OFFICIAL_CONFIRMED").when(conflict, "CONFLICTING").when(sources > 1, "CORROBORATED").otherwise("DISCOVERED")
    reason = F.when(status == "CONFLICTING", F.array_join("years", ", "))
    return rows.where(~F.col("imported") | (F.col("official") > 0)).select("ref", "url", "announced", "community", "official", "passed_over", sources.cast("int").alias("sources"), status.alias("status"), reason.alias("conflict"))


def with_zero_rows(counts: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Counts in the order of ``names``, with 0 for names that don't occur."""
    listed = counts.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], f"place int, {column} string")
    return F.broadcast(listed).join(counts, column, "left").select("place", column, F.coalesce("n", F.lit(0)).alias("n"))
