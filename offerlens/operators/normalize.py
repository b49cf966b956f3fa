"""From promotion records to offers: one select over the functions, as the landing formats bring them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import dates, numbers, promotions, text, units
from offerlens.operators import classify
from offerlens.sources import layouts, nested, registry

#: What every connector maps its records to.
PROMOTION = (
    "source_id string, retailer_key string, retailer_name string, region string, title string, description string, brand string, price string, old_price string, percent double, minimum int, tags array<string>, "
    "quantity double, unit string, packs double, pack_unit string, pack_unit_type string, source_category string, valid_from timestamp, valid_to timestamp, snapshot boolean, url string, channel string"
)


once = numbers.once


def evidence(at: Column) -> Column:
    return F.struct(F.col("source_id"), F.col("channel"), F.col("url"), F.col("retailer_key").alias("retailer"), F.lit("offer").alias("kind"), at.alias("observed_at"))


def offers(rows: DataFrame, as_of: Column) -> DataFrame:
    """Offers with prices, quantities, promotion, category, status, keys, scores, issues and evidence.

    Rows without a title or with no price (0 counts as none) are dropped.
    """
    c = F.col
    title = text.squeezed(c("title"))
    out = rows.withColumns({
        "title": title, "title_normalized": text.match_title(F.concat_ws(" ", "brand", "title")), "price": numbers.amount(c("price")), "reference": numbers.amount(c("old_price")),
        "unit": units.symbol(c("unit")), "pack_unit": units.symbol(c("pack_unit")), "benefit": promotions.benefit_type(c("title"), c("description"), c("percent")),
        "program_required": promotions.program_required(c("title"), c("description"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")),
        "conditions": F.concat_ws(" / ", F.when(c("percent").isNotNull(), F.concat(text.number_text(c("percent")), F.lit("% Rabatt laut Quelle"))), F.when(c("minimum") > 1, F.concat(F.lit("ab "), c("minimum").cast("string"), F.lit(" Stk.")))),
        "status": dates.status(c("valid_from"), c("valid_to"), c("snapshot"), as_of), "is_active_today": dates.active_today(c("valid_from"), c("valid_to"), as_of), "category": classify.decision(c("title"), c("description"), c("source_category")),
    })
    out = out.filter((c("title") != "") & numbers.truthy(c("price"), "number"))
    out = out.withColumns({
        "base": once(units.comparable_base(c("quantity"), c("unit"), c("packs"), c("pack_unit"), c("pack_unit_type") == "PACKAGING")), "needs": once(promotions.requirement(c("title"), c("conditions"), c("tags"), c("minimum"), c("benefit"))),
        "category_primary": c("category.primary"), "category_secondary": c("category.secondary"), "is_active": c("status") == "active", "signature": text.signature(c("title"), c("brand")),
    })
    single = (c("needs.required") <= 1) & ~c("needs.mechanic").isin("x-plus-y", "x-for-y", "multi-buy")
    out = out.withColumns({"unit_price": once(units.unit_price(c("price"), c("base"))), "savings": once(promotions.savings(c("price"), c("reference"), c("percent"), F.lit(False), c("needs"))), "discount_type": promotions.discount_type(c("benefit"), c("program_required"), c("minimum"), c("needs.mechanic"))})
    out = out.withColumns({
        "comparison_group": units.comparison_group(c("signature"), c("base"), c("unit_price"), single), "category_key": text.slug(F.coalesce(F.nullif("category_secondary", F.lit("")), "category_primary"), "unkategorisiert"),
        "main_category_key": text.slug(c("category_primary"), "unkategorisiert"), "completeness": numbers.share_of(c("price").isNotNull(), c("valid_from").isNotNull(), c("valid_to").isNotNull(), c("category_secondary") != ""),
        "parsing_confidence": F.when(c("unit_price.comparable"), 0.9).otherwise(0.82), "evidence": F.array(evidence(as_of)),
        "issues": F.array_compact(F.array(F.when(c("valid_from").isNull() | c("valid_to").isNull(), "Gueltigkeitszeitraum unvollstaendig"), F.when(~c("unit_price.comparable"), "Vergleichseinheit unsicher oder nicht ableitbar"), F.when(c("program_required"), "Angebot erfordert Kundenprogramm oder App"), F.when(c("category.needs_review"), F.array_join("category.reasons", ", ")))),
    })
    audience = F.when(c("program_required"), "program").otherwise("public")
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    name = F.coalesce(F.nullif("signature", F.lit("")), "title_normalized")
    amount = F.coalesce(F.nullif(units.amount_key(c("base")), F.lit("")), F.lit("na"))
    return out.withColumns({
        "offer_key": text.joined_key(c("retailer_key"), c("category_key"), name, amount, text.number_text(c("price")), c("discount_type"), audience, day(c("valid_from")), day(c("valid_to"))),
        "dedupe_key": text.joined_key(c("retailer_key"), c("category_key"), name, amount, c("discount_type"), audience, text.number_text(c("price")), F.coalesce(day(c("valid_to")), F.lit("-"))),
        "search_text": text.match_title(F.concat_ws(" ", "title", "brand", "category_primary", "category_secondary", "retailer_name", "conditions")), "comparison_safe": c("unit_price.comparable") & single,
        "sort_score": numbers.sort_score(c("is_active"), c("unit_price.comparable") & single, c("program_required"), c("conditions"), c("needs.required"), c("parsing_confidence"), c("unit_price.amount")),
    })


def _columns(**given: Column) -> list[Column]:
    """The promotion record's columns, null where a connector has nothing."""
    return [given.get(f.split()[0], F.lit(None)).cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in PROMOTION.split(", ")]


def from_promotions(landed: DataFrame) -> DataFrame:
    """Nested promotion records (title, discountedPrice, product.brand.name, ...) with source columns beside them."""
    p = F.col("promotion")
    given = lambda c: F.when(c.cast("string") != "$undefined", c)
    return landed.select(*_columns(
        source_id=F.col("source_id"), retailer_key=F.col("retailer_key"), retailer_name=F.col("retailer_name"), region=F.col("region"), channel=F.col("channel"), title=F.coalesce(p["fullDisplayName"], p["title"]), description=p["description"],
        brand=p["product"]["brand"]["name"], price=F.coalesce(p["discountedPrice"], p["newPrice"]).cast("string"), old_price=F.coalesce(p["originalPrice"], p["oldPrice"]).cast("string"), percent=p["discountPercentage"], minimum=p["minimalAcceptance"],
        tags=p["tags"], quantity=p["product"]["productQuantity"], unit=F.coalesce(p["product"]["productQuantityUnit"]["shortName"], p["product"]["productQuantityUnit"]["name"]), packs=p["product"]["packageQuantity"],
        pack_unit=F.coalesce(p["product"]["packageQuantityUnit"]["shortName"], p["product"]["packageQuantityUnit"]["name"]), pack_unit_type=p["product"]["packageQuantityUnit"]["type"], source_category=F.try_element_at(p["productGroups"], F.lit(1))["title"],
        valid_from=dates.iso_prefix(p["validFrom"]), valid_to=dates.iso_prefix(p["validTo"]), snapshot=p["snapshotCurrent"], url=F.coalesce(given(p["clickoutUrl"]), F.col("source_url")),
    ))


def from_aggregator_json(landed: DataFrame) -> DataFrame:
    """Aggregator offers (price, oldPrice, quantity, unit.shortName, product.name, ...)."""
    o = F.col("offer")
    return landed.select(*_columns(
        source_id=F.col("source_id"), retailer_key=F.col("retailer_key"), retailer_name=F.col("retailer_name"), channel=F.col("channel"), title=F.coalesce(o["product"]["name"], o["description"]), description=o["description"], brand=o["brand"]["name"],
        price=o["price"].cast("string"), old_price=F.coalesce(o["oldPrice"], o["referencePrice"]).cast("string"), quantity=o["quantity"], unit=o["unit"]["shortName"], source_category=o["product"]["categoryName"], valid_from=dates.iso_prefix(o["validFrom"]), valid_to=dates.iso_prefix(o["validTo"]), url=F.col("source_url"),
    ))


def from_search_hits(landed: DataFrame) -> DataFrame:
    """Search-index hits with prices in cents."""
    h = F.col("hit")
    euros = lambda c: (c / 100).cast("string")
    found = units.quantities_in_text(F.coalesce(h["packageLabel"], h["volumeLabelShort"], F.lit("")))
    first = F.try_element_at(found, F.lit(1))
    return landed.select(*_columns(
        source_id=F.col("source_id"), retailer_key=F.col("retailer_key"), retailer_name=F.col("retailer_name"), channel=F.col("channel"), title=h["name"], description=F.coalesce(h["descriptionShort"], h["descriptionLong"]), brand=h["brand"]["name"],
        price=euros(h["price"]["regular"]["value"]), old_price=euros(h["price"]["crossed"]), percent=h["price"]["discountPercentage"], tags=h["price"]["regular"]["tags"], quantity=first["quantity"], unit=first["unit"], source_category=h["category"], snapshot=F.lit(True), url=F.col("source_url"),
    ))


def from_flyer_products(landed: DataFrame) -> DataFrame:
    """Products of active flyers, valid as the flyer is."""
    flyer = F.col("flyer")
    rows = landed.filter(F.coalesce(flyer["isActive"], F.lit(False))).select("*", F.explode(F.map_values(flyer["products"])).alias("p"))
    p = F.col("p")
    first = F.try_element_at(units.quantities_in_text(F.regexp_replace(F.concat_ws(" ", p["title"], p["description"]), "<[^>]+>", " ")), F.lit(1))
    return rows.select(*_columns(
        source_id=F.col("source_id"), retailer_key=F.col("retailer_key"), retailer_name=F.col("retailer_name"), channel=F.col("channel"), title=p["title"], description=F.regexp_replace(p["description"], "<[^>]+>", " "), brand=p["brand"], price=p["price"].cast("string"),
        quantity=first["quantity"], unit=first["unit"], source_category=F.coalesce(p["wonCategoryPrimary"], p["categoryPrimary"]), valid_from=dates.iso_prefix(F.coalesce(flyer["offerStartDate"], flyer["startDate"])), valid_to=dates.iso_prefix(F.coalesce(flyer["offerEndDate"], flyer["endDate"])), url=p["url"],
    ))


def from_cards(landed: DataFrame) -> DataFrame:
    """Cards of a page (a map of fields beside the source columns)."""
    f = F.col("fields")
    found = units.quantities_in_text(F.coalesce(f["title"], F.lit("")))
    first, second = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(2))
    return landed.select(*_columns(
        source_id=F.col("source_id"), retailer_key=F.col("retailer_key"), retailer_name=F.col("retailer_name"), channel=F.col("channel"), title=f["title"], brand=f["brand"], price=f["price"], old_price=f["old_price"], quantity=first["quantity"], unit=first["unit"], packs=second["quantity"], pack_unit=second["unit"], snapshot=F.lit(True), url=f["link"],
    ))


def from_layout(layout: str) -> Callable[[DataFrame], DataFrame]:
    """Pages with cards of this layout (source columns, url, html, fetched_at)."""

    def connector(landed: DataFrame) -> DataFrame:
        rows = layouts.records(landed, layout)
        found = units.quantities_in_text(F.when(F.col("quantity_text") != "", F.col("quantity_text")).otherwise(F.col("title")))
        first, second = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(2))
        columns = ("source_id", "retailer_key", "retailer_name", "channel", "title", "description", "brand", "price", "old_price", "source_category", "valid_from", "valid_to", "snapshot")
        return rows.select(*_columns(**{n: F.col(n) for n in columns}, quantity=first["quantity"], unit=first["unit"], packs=second["quantity"], pack_unit=second["unit"], url=F.col("link")))

    return connector


def evidence_only(landed: DataFrame) -> DataFrame:
    """Pages that are kept as evidence and hold no offers."""
    return landed.select(*_columns()).limit(0)


def from_promotion_pages(landed: DataFrame) -> DataFrame:
    """Promotion records as they are, or pages (url, html, retailer_name) with such records in their scripts."""
    if "promotion" in landed.columns:
        return from_promotions(landed)
    return from_promotions(nested.promotions(nested.payloads(landed)))


registry.CONNECTORS.update({"aktionsfinder": from_promotion_pages, "marktguru": from_aggregator_json, "search": from_search_hits, "official": from_flyer_products, "cards": from_cards, "wogibtswas": from_layout("product-links"), "evidence": evidence_only})
registry.CONNECTORS.update({name: from_layout(name) for name in layouts.LAYOUTS})
