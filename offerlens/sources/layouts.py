"""Card layouts of landed pages: which elements are cards, which of their parts are fields, and what the fields mean.

Arrow batches only cut fields out of pages (`cards`); dates, amounts, labels and addresses are column expressions
over them (`records`), which ends in the columns that normalize.from_layout maps to promotion records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import dates, text
from offerlens.sources import pages as landed_pages
from offerlens.sources import selectors


class Layout(NamedTuple):
    """card: selector of the matched element. around: the nearest such ancestor (or itself) that holds the fields; none: itself.

    fields: name to (selector, what): `first` and `all` are the text of the first or of all matches, `each` a list
    of texts, `@a` the first match's attribute. An empty selector is the matched element; `in:` looks below that
    instead of below the one around it.
    """

    card: str
    around: str | None
    fields: dict[str, tuple[str, str]]


# Selectors of the sources' pages.
LAYOUTS = {
    "penny": Layout('a[href*="/produkte/"]', ".ws-product-tile, li, article, div", {
        "title": ('[data-test="product-title"]', "first"), "link_text": ("", "first"), "quantity": ('[data-test="product-information-piece-description"]', "first"), "validity": ('[data-test="product-price-validity"] div', "each"),
        "price": ('[data-test="product-price-type-value"]', "first"), "unit_label": ('[data-test="product-price-type-label"]', "first"), "link": ("", "@href"), "image": ("img", "@src"),
    }),
    "bipa": Layout('a[data-testid^="product-tile-"][href*="/p/"]', None, {"lines": ("p", "each"), "name": ("", "@title"), "link_text": ("", "first"), "link": ("", "@href"), "image": ("img", "@src")}),
    "hofer": Layout(".plp_product", None, {
        "title": (".product-title", "all"), "price": (".at-product-price_lbl", "all"), "old_price": (".price_before", "all"), "info": (".additional-product-info", "all"), "whole": ("", "first"),
        "image_1": (".at-product-images_img", "@data-src"), "image_2": (".at-product-images_img", "@src"), "image_3": ("img", "@data-src"), "image_4": ("img", "@src"),
    }),
    "offer-list": Layout(".offer-list-item", None, {
        "title": ("h3", "first"), "brand": ("dd.brand", "first"), "price": (".price-bubble .price", "first"), "old_price": (".price-bubble .old-price", "first"), "validity": ("dd.valid", "first"), "info": (".info", "all"),
        "image": ("img.offer-list-item-img", "@src"), "shop_link": (".retailer a[href]", "@href"), "link": ("a[href]", "@href"),
    }),
    "category": Layout("article", None, {
        "link": ('a[href^="/l/"]', "@href"), "title": ("p.text-card-text-primary", "first"), "image_text": ("img", "@alt"), "price": (".text-card-text-accent", "first"), "old_price": (".line-through", "first"), "labels": (".text-card-text-secondary", "each"), "image": ("img", "@src"),
    }),
    "product-links": Layout('a[href^="/p/"]', "li,div,article", {"whole": ("", "first"), "link": ("", "@href"), "image": ("in:img", "@src"), "image_near": ("img", "@src")}),
}
# Labels of prices and units on cards.
UNIT_PRICE = r"(?i)\d+(?:[.,]\d+)?\s*(kg|l|Stk|waschgang|100 g|100 ml)"
PER_UNIT = r"(?i)/\s*(kg|g|l|ml|cl|stk|stueck|stuck)"
ONLY = r"(?i)Preis nur\s+([\d,.]+)\s*€"
VALID_UNTIL = r"(?i)(?:Gueltig bis|Gültig bis)\s+(\d{2}\.\d{2}\.\d{4})"


def _field(page: selectors.Page, matched: selectors.Element, around: selectors.Element | None, selector: str, what: str) -> list[str]:
    if selector == "":
        found = [matched]
    elif selector.startswith("in:"):
        found = page.find(selector[3:], matched)
    else:
        found = page.find(selector, around) if around is not None else []
    if what == "all":
        return [selectors.squeezed("".join(e.text() for e in found))] if found else []
    if what == "each":
        return [e.text() for e in found]
    return [found[0].text() if what == "first" else found[0].attributes.get(what[1:], "")] if found else []


def cards_of(html: str | None, layout: Layout) -> list[dict[str, list[str]]]:
    page = selectors.Page(html)
    out = []
    for e in page.find(layout.card) if layout.card else page.elements[:1]:
        around = page.closest(e, layout.around) if layout.around else e
        out.append({name: _field(page, e, around, *how) for name, how in layout.fields.items()})
    return out


def cards(pages: DataFrame, layout: str | Layout) -> DataFrame:
    """Each card of each page: the pages' columns without html, position from 0 and fields (map of lists of texts).

    An empty card selector takes each page as one card. Null and broken pages have no cards of any other.
    """
    layout = LAYOUTS[layout] if isinstance(layout, str) else layout
    kept = [f for f in pages.schema.fields if f.name not in ("html", "position", "fields")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, position, fields = [], [], []
            for i, html in enumerate(batch.column("html").to_pylist()):
                for k, card in enumerate(cards_of(html, layout)):
                    at.append(i)
                    position.append(k)
                    fields.append(list(card.items()))
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(rows) for f in kept), pa.array(position, pa.int32()), pa.array(fields, pa.map_(pa.string(), pa.list_(pa.string())))], names=[*(f.name for f in kept), "position", "fields"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "position int", "fields map<string,array<string>>"])
    return pages.select(*(f.name for f in kept), "html").mapInArrow(run, schema)


def _one(name: str, k: int = 0) -> Column:
    """A field's k-th text, empty where there is none."""
    return F.coalesce(F.get(F.col("fields")[name], F.lit(k)), F.lit(""))


def _given(*columns: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def _first(name: str, keep: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.get(F.filter(F.col("fields")[name], keep), F.lit(0)), F.lit(""))


def _penny() -> dict[str, Column]:
    parts = F.split(_one("title"), "•")
    return {
        "title": _given(F.trim(F.get(parts, F.lit(0))), _one("link_text")), "brand": F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")), "price": _one("price"), "quantity_text": _one("quantity"), "unit_price_text": _one("unit_label"),
        "valid_from": dates.date_in_text(_one("validity")), "valid_to": dates.date_in_text(_one("validity", 1)), "link": _one("link"), "image": _one("image"),
    }


def _bipa() -> dict[str, Column]:
    lines = F.filter(F.col("fields")["lines"], lambda x: x != "")
    line = lambda k: F.coalesce(F.get(lines, F.lit(k)), F.lit(""))
    return {
        "title": _given(line(1), _one("name"), _one("link_text")), "brand": line(0), "price": _first("lines", lambda x: x.startswith("€")), "quantity_text": line(2), "unit_price_text": _first("lines", lambda x: x.rlike(UNIT_PRICE)),
        "valid_from": F.col("fetched_at"), "valid_to": F.col("page_valid_to"), "snapshot": F.lit(True), "link": _one("link"), "image": _one("image"),
    }


def _hofer() -> dict[str, Column]:
    begin = F.coalesce(dates.date_in_text(_one("whole")), F.col("page_date"))
    return {
        "title": _one("title"), "price": _one("price"), "old_price": _one("old_price"), "quantity_text": _one("info"), "unit_price_text": _one("info"), "description": _one("info"),
        "valid_from": begin, "valid_to": F.when(begin.isNotNull(), dates.add_days(F.col("next_page_date"), -1)), "link": F.lit(""), "image": _given(*(_one(f"image_{k}") for k in (1, 2, 3, 4))),
    }


def _offer_list() -> dict[str, Column]:
    begin, end = dates.date_range(_one("validity"), F.col("fetched_at"))
    return {
        "title": _one("title"), "brand": _one("brand"), "price": _one("price"), "old_price": _one("old_price"), "quantity_text": _one("info"), "unit_price_text": _one("info"), "description": _one("info"),
        "valid_from": begin, "valid_to": end, "link": _given(_one("shop_link"), _one("link")), "image": _one("image"),
    }


def _category() -> dict[str, Column]:
    begin, end = dates.leaflet_dates(F.concat(F.regexp_replace(_one("link"), "/$", ""), F.lit("/")))
    slug = F.regexp_extract(F.col("url"), "(?i)/ppcv/([^/]+)/", 1)
    label = _first("labels", lambda x: x.rlike(PER_UNIT))
    shown = F.when(slug != "", text.humanized(slug)).otherwise("")
    return {
        "title": _given(_one("title"), _one("image_text")), "price": _one("price"), "old_price": _one("old_price"), "quantity_text": label, "unit_price_text": label, "description": F.array_join(F.filter(F.array(shown, label), lambda x: x != ""), " / "),
        "source_category": shown, "valid_from": begin, "valid_to": end, "snapshot": begin.isNull() & end.isNull(), "link": _one("link"), "image": _one("image"),
    }


def _product_links() -> dict[str, Column]:
    whole = _one("whole")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"(?i)^.+?Preis nur\s+[\d,.]+\s*€", ""), r"(?i)Entfernt:\s*[\d,.]+\s*km", ""), r"(?is)Kategorie:\s*(.+)$", "")
    return {
        "title": text.squeezed(F.regexp_replace(whole, r"(?is)Preis nur\s+[\d,.]+\s*€.*$", "")), "price": F.regexp_extract(whole, ONLY, 1), "description": text.squeezed(rest), "source_category": text.squeezed(F.regexp_extract(whole, r"(?is)Kategorie:\s*(.+)$", 1)),
        "quantity_text": text.squeezed(rest), "unit_price_text": F.lit(""), "valid_from": F.col("fetched_at"), "link": _one("link"), "image": _given(_one("image"), _one("image_near")),
    }


_MEANING = {"penny": _penny, "bipa": _bipa, "hofer": _hofer, "offer-list": _offer_list, "category": _category, "product-links": _product_links}
_TEXTS = ("title", "brand", "price", "old_price", "quantity_text", "unit_price_text", "description", "source_category", "image")


def records(pages: DataFrame, layout: str) -> DataFrame:
    """What a layout's cards say, beside their pages' columns: title, brand, price and old_price (texts), quantity_text,
    unit_price_text, description, source_category, valid_from, valid_to, snapshot, link (absolute) and image.

    pages have url, html and fetched_at. A card without title or price is left out. A page of dated addresses ends
    the day before the next date begins; for that, pages with a source_id are compared within it.
    """
    rows = pages
    if layout == "bipa":
        found = F.regexp_extract_all("html", F.lit(VALID_UNTIL), F.lit(1))
        rows = rows.withColumn("page_valid_to", F.array_min(F.array_compact(F.transform(found, dates.date_in_text))))
    if layout == "hofer":
        rows = with_next_page_date(rows)
    found = cards(rows, layout)
    says = _MEANING[layout]()
    out = found.withColumns({n: F.coalesce(says.get(n, F.lit("")), F.lit("")) for n in _TEXTS})
    link = says["link"]
    out = out.withColumns({"valid_from": says["valid_from"], "valid_to": says.get("valid_to", F.lit(None).cast("timestamp")), "snapshot": says.get("snapshot", F.lit(False)), "link": F.when(link == "", F.col("url")).otherwise(landed_pages.absolute(link, F.col("url")))})
    return out.drop("fields", "page_valid_to", "page_date", "next_page_date").filter((F.col("title") != "") & F.col("price").rlike("[0-9]"))


def with_next_page_date(pages: DataFrame) -> DataFrame:
    """page_date by the address, and the next later one of its source; a source's dates are few, its pages may be many."""
    keys = ["source_id"] if "source_id" in pages.columns else []
    dated = pages.withColumn("page_date", dates.date_in_url(F.col("url")))
    days = dated.filter("page_date is not null").groupBy(*keys, "page_date").agg(F.lit(1).alias("__one"))
    follow = days.withColumn("next_page_date", F.lead("page_date").over(Window.partitionBy(*(keys or ["__one"])).orderBy("page_date"))).drop("__one")
    return dated.join(follow, [*keys, "page_date"], "left")
