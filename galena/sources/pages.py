"""Page jobs: labelled fields, records, JSON-LD, official observations, images, listings, manifests.

What a regular expression can tell is a column expression. Records of community pages need the nesting of
their tags and are read by a parser, in Arrow batches, one page after the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions.values import parse_measures

# Languages by the name of their flag, months of listings, words that mean nothing.
LOCALES = {"English": "en", "Español": "es", "Deutsch": "de", "Français": "fr"}
# Where no month can begin, one look at the letter there tells.
MONTHS = "(?=[JFMASOND])(?:J(?:anvier|uin|uillet)|F[ée]vrier|M(?:ars|ai)|A(?:vril|o[uû]t)|Septembre|Octobre|Novembre|D[ée]cembre)"
NOTHING = re.compile("(?:\\(n/a\\)|n/a|none)?", re.I)
VOID = {"br", "img", "meta", "link", "hr", "input"}


def meaningful(text: str) -> str | None:
    """A text with its blanks folded and ``(wrong?)`` taken out; None if it says that there is nothing."""
    text = re.sub("\\(wrong\\?\\)", "", " ".join(text.split()), flags=re.I).strip()
    return None if NOTHING.fullmatch(text) else text


class _Page(HTMLParser):
    """A page as a list of (tag, attributes, text) in order; text has no tag, ``/tag`` is an end.

    A stack for each tag finds the end of every element as the page is read: ``ends[k]`` is the place of the end of the element
    at k, the number of items if it has none, and k itself for elements that hold nothing. So a page is read once, whatever its nesting.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, dict[str, str], str]] = []
        self.ends: list[int] = []
        self.open: dict[str, list[int]] = {}

    def _add(self, tag: str, attributes: dict[str, str], text: str) -> None:
        self.items.append((tag, attributes, text))
        self.ends.append(len(self.ends))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.items))
        self._add(tag, {k: v or "" for k, v in attrs}, "")

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self.ends[self.open[tag].pop()] = len(self.items)
        self._add(f"/{tag}", {}, "")

    def handle_data(self, data: str) -> None:
        self._add("", {}, data)

    def close(self) -> None:
        super().close()
        for places in self.open.values():
            for k in places:
                self.ends[k] = len(self.items)

    def inside(self, at: int) -> range:
        """The places inside the element at ``at``."""
        return range(at + 1, max(self.ends[at], at + 1))

    def text(self, places: range | list[int]) -> str:
        return " ".join(" ".join(self.items[k][2] for k in places if not self.items[k][0]).split())

    def until_break(self, at: int) -> list[int]:
        """What follows the element at ``at``, up to the next line break or the end of what is around."""
        k = at + 1 if self.items[at][0] in VOID else self.ends[at] + 1
        out, seen = [], set()
        while k < len(self.items) and self.items[k][0] != "br":
            tag, attributes, _ = self.items[k]
            if tag == "a" and attributes.get("aria-label") in ("Edit", "Report error") or "counter" in attributes.get("class", "").split():
                after = max(self.ends[k], k) + 1
                seen.update(x[0] for x in self.items[k:after])
                k = after
                continue
            if tag.startswith("/") and tag[1:] not in seen:
                break
            seen.add(tag)
            out.append(k)
            k += 1
        return out


def _linked(page: _Page, heading: str, path: str) -> list[dict]:
    """Links ``KEY - name`` to ``path`` in the block under a heading."""
    for k, (tag, _, _) in enumerate(page.items):
        if tag == "h4" and page.text(page.inside(k)).upper() == heading:
            block = next((j for j in range(k + 1, len(page.items)) if page.items[j][0] == "div"), None)
            found = []
            for j in page.inside(block) if block is not None else ():
                tag, attributes, _ = page.items[j]
                if tag == "a" and f"/{path}/" in attributes.get("href", ""):
                    told = re.fullmatch(r"(\S+)\s+-\s+(.+)", " ".join((attributes.get("title") or page.text(page.inside(j))).split()))
                    found += [{"key": told[1], "name": told[2], "url": attributes["href"]}] if told else []
            return found
    return []


def _image_kind(label: str) -> str:
    return "box_back" if re.search(r"\bback\b|rear", label) else "box_front" if re.search(r"\bbox\b|front", label) else "gallery"


def community_record(html: str, placeholder: str) -> dict:
    """The record of a community page: what it has not is None or empty."""
    page = _Page()
    page.feed(html)
    page.close()
    items = page.items
    heading = next((page.text(page.inside(k)) for k, x in enumerate(items) if x[0] == "h1"), "")
    told = re.fullmatch(r"\S+\s+(.+?)\s*-\s*(.*)", heading)
    fields: dict[str, tuple[str | None, list[str]]] = {}
    names: list[dict] = []
    for k, (tag, attributes, _) in enumerate(items):
        if tag == "strong":
            label = page.text(page.inside(k)).rstrip(":").strip().lower()
            if label not in fields:
                rest = page.until_break(k)
                links = [items[j][1] for j in rest if items[j][0] == "a"]
                fields[label] = (meaningful(page.text(rest)), [a["href"] for a in links if a.get("href") and "/editor/" not in a["href"]])
        elif tag == "img" and attributes.get("alt") in LOCALES and (name := meaningful(page.text(page.until_break(k)))):
            names.append({"locale": LOCALES[attributes["alt"]], "name": name})
    text = lambda label: fields.get(label, (None, []))[0]

    def year(label: str) -> int | None:
        found = re.search(r"\b(?:19|20)[0-9]{2}\b", text(label) or "")
        return int(found[0]) if found else None

    markets = [h.rstrip("/").rsplit("/", 1)[1] for h in fields.get("export market", (None, []))[1] if "/export-markets/" in h]
    markets = markets or [m for x in re.split("[,/]", text("export market") or "") if (m := x.strip()) and m.lower() != "none"]
    images: dict[str, str] = {}
    main = next((a.get("content") for t, a, _ in items if t == "meta" and a.get("property") == "og:image"), None)
    if main and main != placeholder:
        images[main] = "main"
    for k, (tag, a, _) in enumerate(items):
        if tag == "a" and a.get("rel", "").startswith("lightbox[set]") and a.get("href") not in (None, placeholder):
            label = " ".join([a.get("title", ""), *(f"{items[j][1].get('title', '')} {items[j][1].get('alt', '')}" for j in page.inside(k) if items[j][0] == "img")]).lower()
            images.setdefault(a["href"], _image_kind(label))
    notes = [a["href"] for k, (t, a, _) in enumerate(items) if t == "a" and a.get("href") and (re.search(r"\.pdf(?:$|\?)", a["href"], re.I) or re.search("instruction manual|instructions|notice", f"{page.text(page.inside(k))} {a.get('title', '')}".lower()))]
    tags = [x for k, (_, a, _) in enumerate(items) if "tags" in a.get("class", "").split() for j in page.inside(k) if items[j][0] == "a" and (x := page.text(page.inside(j)))]
    figures = text("figures")
    english = next((n["name"] for n in names if n["locale"] == "en"), None)
    signal = " ".join(x for x in (text("format"), text("exclusive"), *tags) if x)
    return {
        "reference": told[1] if told else None,
        "name": english or (meaningful(told[2]) if told else None),
        "translations": names,
        "release_year": year("released"),
        "discontinued_year": year("discontinued"),
        "theme": text("theme"),
        "format": text("format"),
        "exclusive": text("exclusive"),
        "markets": markets,
        "tags": tags,
        "promotion": bool(re.search("promotion", signal, re.I)),
        "figure_count": int(figures) if figures and figures.isdigit() else None,
        "figures": _linked(page, "FIGURES IN THIS SET", "figures"),
        "parts": _linked(page, "PARTS IN THIS SET", "parts"),
        "images": [{"kind": k, "url": u} for u, k in images.items()],
        "instructions": notes,
    }


#: Records that a task holds as Python objects.
RECORDS = 500
_ENTITY = "array<struct<key:string,name:string,url:string>>"
RECORD_DDL = f"reference string, name string, translations array<struct<locale:string,name:string>>, release_year int, discontinued_year int, theme string, format string, exclusive string, markets array<string>, tags array<string>, promotion boolean, figure_count int, figures {_ENTITY}, parts {_ENTITY}, images array<struct<kind:string,url:string>>, instructions array<string>"


def page_records(pages: DataFrame, placeholder: str = "", html: str = "html", key: str = "page_id") -> DataFrame:
    """The record of each community page, nested; a null page has an empty record."""

    def job(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A record takes much more room as Python objects than as a row, so few are held at once.
        for frame in (whole[k : k + RECORDS] for whole in frames for k in range(0, len(whole), RECORDS)):
            rows = [community_record(body or "", placeholder) for body in frame["__html"]]
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RECORD_DDL.split(", ")], dtype=object)
            out.insert(0, key, frame[key].to_numpy())
            yield out

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(html).alias("__html")).mapInPandas(job, f"{key} {kind}, {RECORD_DDL}")


def _told(html: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, pattern, group), "\\s+", " ")), F.lit(""))


def json_ld_product(html: Column) -> Column:
    """The first Product (variant) of the JSON-LD blocks: by itself, in an array or in ``@graph``; malformed blocks are skipped."""
    blocks = F.regexp_extract_all(html, F.lit("(?s)<script type=.application/ld\\+json.>(.*?)</script>"), F.lit(1))
    parsed = F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())

    def entries(v: Column) -> Column:
        graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
        return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), graph, F.array(v))

    flat = F.flatten(F.transform(parsed, entries))
    flat = F.flatten(F.transform(flat, entries))  # an array of graphs

    def is_product(v: Column) -> Column:
        types = F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
        return F.coalesce(F.array_contains(types, "Product"), F.lit(False))

    return F.get(F.filter(flat, is_product), F.lit(0))


def official_observation(html: Column, product: Column | None = None) -> Column:
    """What an official product page tells: identity, measures, media, and the list price apart from the current offer.

    ``product``: a column with ``json_ld_product`` of the page, so that its blocks are parsed once and not for each field.
    """
    product = json_ld_product(html) if product is None else product

    def field(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(product, path, kind)

    def price(value: Column) -> Column:
        amount = F.replace(value, F.lit(","), F.lit(".")).try_cast("double")
        return F.when(amount >= 0, amount)

    def detail(label: str) -> Column:
        return _told(html, f"(?is)<span class=.title.>\\s*(?:{label})[^<]*</span>\\s*([^<]*)<")

    reference = F.coalesce(_told(html, "(?i)(?:Artikelnummer|Référence de l.article|Item number)\\s*:\\s*([A-Za-z]*[0-9]{3,8}[A-Za-z]?)"), F.nullif(F.trim(field("$.sku")), F.lit("")))
    package, bare = parse_measures(detail("Packungsma|Dimensions de l.emballage|Package dimensions")), parse_measures(detail("Produktma|Dimensions du produit|Product dimensions"))
    weight = parse_measures(detail("Gewicht|Poids|Weight"))["weight_g"]
    people = F.regexp_extract(html, "(?is)(?:Figuren|Personnages|Figures)\\s*:\\s*(.*?)(?:(?:Tiere|Animals|Animaux|Zubehör|Accessories|Accessoires)\\s*:|<)", 1)
    numbers = F.regexp_extract_all(people, F.lit("\\b([0-9]+)\\s+"), F.lit(1))
    figures = F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0), lambda a, x: a + F.coalesce(x.try_cast("int"), F.lit(0))))
    urls = F.filter(F.coalesce(field("$.image", "array<string>"), F.array().cast("array<string>")), lambda u: u.isNotNull())
    kinds = F.transform(urls, lambda u: F.when(u.rlike("(?i)box[_ -]?front"), "box_front").when(u.rlike("(?i)box[_ -]?back"), "box_back").when(u.rlike("(?i)product[_ -]?detail"), "main").otherwise("gallery"))
    currency = field("$.offers.priceCurrency")
    currency = F.when(currency.rlike("^[A-Z]{3}$"), currency)
    current = F.when(currency.isNotNull(), price(field("$.offers.price")))
    listed = F.when(currency.isNotNull(), price(F.nullif(F.regexp_extract(html, "(?is)<span class=.price--list.>.*?content=.([0-9.,]+)", 1), F.lit(""))))
    crumbs = F.regexp_extract_all(F.regexp_extract(html, "(?is)<nav class=.breadcrumbs.>(.*?)</nav>", 1), F.lit("<a[^>]*>([^<]*)</a>"), F.lit(1))
    year = F.coalesce(_told(html, "<span class=.badge--year.>\\s*((?:19|20)[0-9]{2})\\s*<"), F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("string")), crumbs), lambda c: F.coalesce(c.rlike("^(19|20)[0-9]{2}$"), F.lit(False)) | c.isNull()), -1))
    return F.struct(
        reference.alias("reference"),
        F.coalesce(field("$.name"), _told(html, "(?is)<h1[^>]*>(.*?)</h1>")).alias("name"),
        field("$.description").alias("description"),
        year.try_cast("int").alias("release_year"),
        figures.alias("figure_count"),
        F.coalesce(field("$.numberOfPieces", "int"), field("$.pieceCount", "int")).alias("piece_count"),
        F.struct(package["length_mm"].alias("width"), package["width_mm"].alias("depth"), package["height_mm"].alias("height")).alias("package_mm"),
        F.struct(bare["length_mm"].alias("width"), bare["width_mm"].alias("depth"), bare["height_mm"].alias("height")).alias("product_mm"),
        weight.alias("weight_g"),
        F.array_distinct(kinds).alias("image_kinds"),
        F.transform(F.arrays_zip(urls.alias("url"), kinds.alias("kind")), lambda x: F.concat_ws(" ", x["kind"], x["url"])).alias("images"),
        F.nullif(F.trim(field("$.sku")), F.lit("")).alias("sku"),
        F.nullif(F.trim(field("$.mpn")), F.lit("")).alias("mpn"),
        F.coalesce(*[F.nullif(F.trim(field(f"$.{k}")), F.lit("")) for k in ("gtin", "gtin8", "gtin12", "gtin13", "gtin14")]).alias("gtin"),
        crumbs.alias("breadcrumbs"),
        html.rlike("class=.archive-info").alias("archived"),
        F.coalesce(listed, current).alias("list_price"),
        current.alias("current_price"),
        currency.alias("currency"),
        field("$.offers.availability").alias("availability"),
    )


#: A link to ``/p``, up to the first end of a link.
_LINK = "(?is)<a[^>]*href=.[^\"']*/p[^\"']*.[^>]*>[^<]*+(?:<(?!/a>)[^<]*+)*+</a>"
_ROW = "^\\S+\\s+(.+?)\\s+([0-9]{3,8})\\s+(.+)$"


def _listing_texts(html: Column) -> Column:
    """(a, text) of the links to ``/p``. Each is made once and then read by name: an expression in a lambda runs wherever it stands."""
    anchors = F.regexp_extract_all(html, F.lit(_LINK), F.lit(0))
    return F.transform(anchors, lambda a: F.struct(a.alias("a"), F.trim(F.regexp_replace(F.regexp_replace(a, "<[^>]*>", " "), "\\s+", " ")).alias("text")))


def listing_references(html: Column) -> Column:
    """The references of ``listing_rows`` alone, in order."""
    return F.filter(F.transform(_listing_texts(html), lambda x: F.regexp_extract(x["text"], _ROW, 2)), lambda r: r != "")


def listing_rows(html: Column) -> Column:
    """Offers of an annual listing: links to ``/p``, ``Brand theme reference name [month]``, in order."""

    def cut(x: Column) -> Column:
        url = F.regexp_extract(x["a"], "href=.([^\"']*)", 1).alias("url")
        return F.struct(url, *(F.regexp_extract(x["text"], _ROW, k).alias(c) for k, c in ((1, "theme"), (2, "reference"), (3, "tail"))))

    def told(x: Column) -> Column:
        # The name ends at the first month, price or discount; in "a partir decembre" the month counts, and "a partir" stays.
        name = F.regexp_replace(x["tail"], f"(?i)\\s+(?:(?:sortie pr[ée]vue\\s+)?{MONTHS}|[àa] partir de(?!cembre)|-[0-9]+%).*$", "")
        # Not by nullif(), which reads twice what it is given.
        month = F.get(F.filter(F.array(F.regexp_extract(x["tail"], f"(?i)({MONTHS})", 1)), lambda m: m != ""), F.lit(0))
        return F.struct(x["reference"].alias("reference"), F.trim(name).alias("name"), F.trim(x["theme"]).alias("theme"), month.alias("month"), x["url"].alias("url"))

    rows = F.filter(F.transform(_listing_texts(html), cut), lambda x: x["reference"] != "")
    return F.transform(rows, told)


def last_rows(rows: Column, key: str) -> Column:
    """The last row of each ``key`` in an array of rows. Their places are sorted by it, not searched for each of its values."""

    def lasts(all_: Column) -> Column:
        placed = F.sort_array(F.transform(all_, lambda r, i: F.struct(r[key].alias("key"), i.alias("place"))))
        ends = _once(placed, lambda p: F.filter(p, lambda x, i: (i == F.size(p) - 1) | ~F.get(p, i + 1)["key"].eqNullSafe(x["key"])))
        return F.transform(ends, lambda x: F.get(all_, x["place"]))

    return _once(rows, lasts)


def labelled_field(html: Column, label: str) -> Column:
    """The text after ``<strong>label:</strong>`` up to the line break, without tags; null if it says nothing."""
    raw = F.regexp_extract(html, f"(?is)<strong>\\s*{label}\\s*:?\\s*</strong>(.*?)<br", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "<[^>]*>", " "), "(?i)\\(wrong\\?\\)", ""), "\\s+", " "))
    return F.when(~text.rlike("(?i)^(\\(n/a\\)|n/a|none)?$"), text)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, also where a lambda reads it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_occurrence(html: Column, pattern: str) -> Column:
    """(value, place) of the first occurrence of each distinct match, in order. Matches are sorted, not searched for each value."""
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    placed = F.array_sort(F.transform(found, lambda v, i: F.struct(v.alias("value"), (i + 1).cast("long").alias("place"))))
    firsts = _once(placed, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["value"] != x["value"])))
    ordered = F.array_sort(F.transform(firsts, lambda x: F.struct(x["place"].alias("place"), x["value"].alias("value"))))
    return F.transform(ordered, lambda x: F.struct(x["value"].alias("value"), x["place"].alias("place")))
