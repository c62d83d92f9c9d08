"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Words of a window become a template: numbers, units after them and names (capitalised words inside a
sentence) are replaced by typed placeholders, other words are lower-cased without the marks around
them. Every window of ``WINDOW`` words of a benchmark item (shorter items: all their words) is a row
with its template and its *anchor*, the longest ordinary word. Words of a document that are anchors
are found inside its array of words, and hash-joined to the windows; around each of them the document's own
window is canonicalised and compared, so all windows are checked while only few are built.

A document leaks an item if at least ``MIN_SHARE`` of the item's windows occur in it as templates and
the slots are consistent: in one place of the document, a number or name of the item stands for the
same value wherever it occurs. This finds copies and re-parameterised questions.

The benchmark is the stated query set. Its windows are broadcast only if they are at most
``BROADCAST_ROWS`` rows (about 100 bytes each); beyond that the same join shuffles by anchor. Up to
``ANCHOR_LITERALS`` distinct anchors are a set inside the plan; beyond that every word of a document becomes
a row, with the block of words around it, and is joined to the anchors.

Defined results: a null text has no words; items without words match nothing; documents with a null
id are judged together under the null id; repeated rows are judged together and each returned; an
empty benchmark finds nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.common import cut

WINDOW = 8
MIN_SHARE = 0.5
BROADCAST_ROWS = 500_000
ANCHOR_LITERALS = 20_000
BLOCK = 64
# Marks around words, units, placeholders.
MARKS = ".,;:!?\"'()[]{}"
UNITS = ["%", "kg", "g", "mg", "km", "m", "cm", "mm", "mi", "ft", "in", "lb", "oz", "l", "ml", "s", "sec", "min", "h", "hr", "hours", "minutes", "seconds", "days", "usd", "eur", "dollars", "euros", "miles", "meters", "metres", "feet", "inches", "pounds", "kilograms", "grams", "liters", "litres", "degrees"]
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
NUMBER_RE = "^[$€£+-]?[0-9][0-9.,:/]*%?$"
NAME_RE = "^\\p{Lu}[\\p{L}'-]+$"
STOP_RE = "[.!?:][\"')\\]]*$"


def words_of(text: Column) -> Column:
    """Words of a text; one empty word if there is none."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")


def bare(word: Column) -> Column:
    """A word without the marks around it, lower-cased; a word of marks only stays."""
    inner = F.lower(F.btrim(word, F.lit(MARKS)))
    return F.when(inner == "", word).otherwise(inner)


def template(window: Column) -> Column:
    """The template of a window of words. Its first word is never a name: it may begin a sentence."""

    def one(word: Column, i: Column) -> Column:
        before = F.get(window, i - 1)
        inner = F.btrim(word, F.lit(MARKS))
        return (
            F.when(inner.rlike(NUMBER_RE), NUMBER)
            .when(bare(word).isin(UNITS) & F.coalesce(F.btrim(before, F.lit(MARKS)).rlike(NUMBER_RE), F.lit(False)), UNIT)
            .when((i > 0) & inner.rlike(NAME_RE) & ~F.coalesce(before.rlike(STOP_RE), F.lit(True)), NAME)
            .otherwise(bare(word))
        )

    return F.transform(window, one)


def slots(window: Column, shape: Column) -> Column:
    """The words of a window that stand in its placeholders, in order."""
    pairs = F.arrays_zip(shape.alias("shape"), window.alias("word"))
    return F.transform(F.filter(pairs, lambda p: p["shape"].isin(NUMBER, UNIT, NAME)), lambda p: bare(p["word"]))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """A row for each window of the benchmark: its template, its longest ordinary word (the anchor) and the next one, how far apart."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.element_at("words", 1) != "")
    items = items.withColumn("width", F.least(F.size("words"), F.lit(WINDOW))).withColumn("n_windows", F.size("words") - F.col("width") + 1)
    rows = items.select("item_id", "n_windows", "width", "words", F.explode(F.sequence(F.lit(1), F.col("n_windows"))).alias("window"))
    rows = rows.withColumn("span", F.slice("words", F.col("window"), F.col("width"))).withColumn("shape", template(F.col("span")))
    ordinary = F.filter(F.transform("shape", lambda w, i: F.struct(F.when(w.isin(NUMBER, UNIT, NAME), -1).otherwise(F.length(w)).alias("size"), w.alias("word"), i.alias("at"))), lambda s: s["size"] > 0)
    rows = rows.withColumn("ordinary", F.sort_array(ordinary, asc=False)).where(F.size("ordinary") > 0)
    best, second = F.get("ordinary", F.lit(0)), F.get("ordinary", F.lit(1))
    return rows.select("item_id", "window", "n_windows", "width", best["word"].alias("anchor"), best["at"].alias("offset"), second["word"].alias("second"), (second["at"] - best["at"]).alias("apart"), F.array_join("shape", " ").alias("shape"), slots(F.col("span"), F.col("shape")).alias("item_slots"))


def document_words(docs: DataFrame) -> DataFrame:
    """doc_id, begin (place of the block), block, at, word: every word once, with the block of words around it.

    A block is ``BLOCK`` words and the WINDOW - 1 words on either side, so a row for a word carries a
    few hundred bytes and not its document. The outer forms keep Spark from splitting texts twice.
    """
    context = WINDOW - 1
    words = docs.select("doc_id", words_of(docs["text"]).alias("words"))
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(BLOCK))
    blocks = F.transform(starts, lambda i: F.struct((i - F.least(i, F.lit(context))).alias("begin"), F.least(i, F.lit(context)).alias("lead"), F.slice("words", F.greatest(i - context, F.lit(0)) + 1, BLOCK + context + F.least(i, F.lit(context))).alias("words")))
    rows = words.select("doc_id", F.explode_outer(blocks).alias("b")).select("doc_id", F.col("b.begin").alias("begin"), F.col("b.lead").alias("lead"), F.col("b.words").alias("block"))
    told = rows.select("doc_id", "begin", "lead", "block", F.posexplode_outer("block").alias("at", "word"))
    return told.where((F.col("at") >= F.col("lead")) & (F.col("at") < F.col("lead") + BLOCK)).drop("lead")


def anchored_words(docs: DataFrame, anchors: list[str]) -> DataFrame:
    """The columns of ``document_words`` for the words that are anchors; no other word becomes a row."""
    context = WINDOW - 1
    # A generator holds the array, so that Spark splits a text once.
    held = docs.select("doc_id", F.explode_outer(F.array(words_of(docs["text"]))).alias("words"))
    shortest, marks_only = min(map(len, anchors)), [a for a in anchors if not a.strip(MARKS)]

    def is_anchor(word: Column) -> Column:
        inner = F.lower(F.btrim(word, F.lit(MARKS)))
        found = (F.length(word) >= shortest) & inner.isin(anchors)
        return found | ((inner == "") & word.isin(marks_only)) if marks_only else found

    at = F.array_compact(F.transform("words", lambda w, i: F.when(is_anchor(w), i)))
    lead = lambda i: F.least(i, F.lit(context))
    around = F.transform(at, lambda i: F.struct((i - lead(i)).alias("begin"), F.slice("words", i - lead(i) + 1, lead(i) + 1 + context).alias("block"), lead(i).alias("at"), F.get("words", i).alias("word")))
    return held.select("doc_id", F.explode(around).alias("hit")).select("doc_id", "hit.*")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) of each leak, with the item's share of windows found and whether slots changed."""
    windows = item_windows(benchmark)
    anchors = windows.select("anchor").distinct()
    listed = [r["anchor"] for r in anchors.limit(ANCHOR_LITERALS + 1).collect()]
    if windows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        windows, anchors = F.broadcast(windows), F.broadcast(anchors)
    if not listed:
        words = document_words(docs).limit(0)
    else:
        words = anchored_words(docs, sorted(listed)) if len(listed) <= ANCHOR_LITERALS else document_words(docs)
    hits = words.withColumn("anchor", bare(F.col("word")))
    if len(listed) > ANCHOR_LITERALS:
        hits = hits.join(anchors, "anchor", "left_semi")
    hits = hits.join(windows, "anchor")
    hits = hits.where((F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("width") <= F.size("block")))
    # The next word has to be there too; this spares most templates.
    hits = hits.where(F.col("second").isNull() | (bare(F.get("block", F.col("at") + F.col("apart"))) == F.col("second")))
    hits = hits.withColumn("span", F.slice("block", F.greatest(F.col("at") - F.col("offset") + 1, F.lit(1)), F.col("width")))
    hits = hits.withColumn("doc_shape", template(F.col("span"))).where(F.array_join("doc_shape", " ") == F.col("shape"))
    pairs = F.zip_with("item_slots", slots(F.col("span"), F.col("doc_shape")), lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    shift = (F.col("begin") + F.col("at") - F.col("offset") - F.col("window")).alias("shift")
    place = hits.select("doc_id", "item_id", shift, "window", "n_windows", pairs.alias("pairs"))
    # One place of an item in a document: its windows follow each other, and its slots have to agree.
    places = place.groupBy("doc_id", "item_id", "shift").agg(F.first("n_windows").alias("n_windows"), F.collect_set("window").alias("windows"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    places = places.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"]))))
    changed = F.exists("pairs", lambda p: p["item"] != p["doc"])
    joint = places.groupBy("doc_id", "item_id").agg(F.first("n_windows").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_set("windows")))).alias("found"), F.bool_and(changed).alias("changed"))
    return joint.where(F.col("found") >= MIN_SHARE * F.col("n_windows")).select("doc_id", "item_id", (F.col("found") / F.col("n_windows")).alias("share"), "changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids, comma-joined), n_changed of each document."""
    by_doc = leaks(docs, benchmark).groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("items"), F.count_if("changed").alias("n_changed"))
    joined = docs.select("doc_id").join(by_doc, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item. Texts are shuffled only if more than ``BROADCAST_ROWS`` of them do."""
    found = cut(leaks(docs, benchmark).select(F.col("doc_id").alias("__id")).distinct())
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]), "left_anti")
