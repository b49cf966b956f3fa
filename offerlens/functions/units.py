"""Units: symbols, comparable quantities, quantities in titles, unit prices and comparison groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions import numbers, text

QUANTITY = r"(?i)(\d+(?:[.,]\d+)?)\s*(kg|g|ml|cl|l|stk|stueck|stück)\b"


def symbol(c: Column) -> Column:
    u = text.ascii_lower(c)
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(u, w))
    return (
        F.when(u == "", "").when(has("kilogramm") | (u == "kg"), "kg").when(has("gramm") | (u == "g"), "g")
        .when(has("milliliter") | (u == "ml"), "ml").when(has("zentiliter") | (u == "cl"), "cl").when(has("liter") | (u == "l"), "l")
        .when(has("stueck", "stk"), "Stk").otherwise(text.squeezed(c))
    )


def comparable(quantity: Column, unit: Column) -> Column:
    """struct(quantity, unit, comparable): g to kg, ml and cl to l; only kg, l and Stk compare."""
    missing = ~numbers.truthy(quantity, "number") | ~numbers.truthy(unit, "string")
    q = F.when(unit.isin("g", "ml"), quantity / 1000).when(unit == "cl", quantity / 100).otherwise(quantity)
    u = F.when(unit == "g", "kg").when(unit.isin("ml", "cl"), "l").otherwise(unit)
    return F.when(missing, F.struct(F.lit(None).cast("double").alias("quantity"), F.lit("").alias("unit"), F.lit(False).alias("comparable"))).otherwise(
        F.struct(q.cast("double").alias("quantity"), u.alias("unit"), u.isin("kg", "l", "Stk").alias("comparable"))
    )


def comparable_base(quantity: Column, unit: Column, packs: Column, pack_unit: Column, is_packaging: Column) -> Column:
    """The comparable quantity times the number of packs, or the pieces of the pack where there is no quantity."""
    one = comparable(quantity, unit)
    times = F.when(numbers.truthy(packs, "number") & F.coalesce(is_packaging, F.lit(False)), packs).otherwise(1)
    total = numbers.once(one["quantity"] * times, lambda x: numbers.fixed(x, 3))
    pieces = numbers.truthy(packs, "number") & (pack_unit == "Stk")
    shape = lambda q, u, ok: F.struct(q.cast("double").alias("quantity"), u.alias("unit"), ok.alias("comparable"))
    return F.when(numbers.truthy(quantity, "number") & numbers.truthy(unit, "string"), shape(total, one["unit"], one["comparable"])).when(pieces, shape(packs, F.lit("Stk"), F.lit(True))).otherwise(shape(F.lit(None), F.lit(""), F.lit(False)))


def quantities_in_text(c: Column) -> Column:
    """array<struct<quantity, unit>> in order; the first is the product's, the second the pack's."""
    found = F.arrays_zip(F.regexp_extract_all(c, F.lit(QUANTITY), 1).alias("q"), F.regexp_extract_all(c, F.lit(QUANTITY), 2).alias("u"))
    return F.transform(found, lambda f: F.struct(numbers.amount(f["q"], "plain").alias("quantity"), symbol(f["u"]).alias("unit")))


def package_type(unit_type: Column, unit_name: Column) -> Column:
    name = text.ascii_lower(unit_name)
    return F.when(unit_type == "PACKAGING", "pack").when(name.rlike("(flasche|dose|glas|beutel|pack|packung|rolle|kapsel)"), "pack").when(name.rlike("(stk|stueck)"), "piece").otherwise("")


def unit_price(price: Column, base: Column) -> Column:
    """struct(amount, unit, comparable, confidence)"""
    ok = base["comparable"] & numbers.truthy(price, "number") & numbers.truthy(base["quantity"], "number")
    return F.struct(F.when(ok, numbers.money(price / base["quantity"])).alias("amount"), F.when(ok, base["unit"]).otherwise("").alias("unit"), F.coalesce(ok, F.lit(False)).alias("comparable"), F.when(ok, 0.9).otherwise(0.4).alias("confidence"))


def unit_price_in_text(c: Column) -> Column:
    """Price for a unit as labels give it: 1,99 / kg, 0,50 per 100 g, (1 l = 1.20). struct(amount, unit)"""
    per = r"(?i)(\d+(?:[.,]\d+)?)\s*(?:€|eur)?\s*(?:/|per|pro)\s*(\d+)?\s*(kg|g|ml|cl|l|stk)\b"
    is_ = r"(?i)(\d+)?\s*(kg|g|ml|cl|l|stk)\s*=\s*(?:€|eur)?\s*(\d+(?:[.,]\d+)?)"
    first = c.rlike(per)
    pick = lambda a, b: F.nullif(F.when(first, F.regexp_extract(c, per, a)).otherwise(F.regexp_extract(c, is_, b)), F.lit(""))
    price, count, unit = numbers.amount(pick(1, 3), "plain"), F.coalesce(pick(2, 1).try_cast("double"), F.lit(1.0)), symbol(pick(3, 2))
    base = comparable(count, unit)
    return F.struct(F.when(base["comparable"], numbers.money(price / base["quantity"])).alias("amount"), base["unit"].alias("unit"))


def amount_key(base: Column) -> Column:
    given = numbers.truthy(base["quantity"], "number") & numbers.truthy(base["unit"], "string")
    return F.when(given, F.concat_ws("-", text.number_text(base["quantity"]), base["unit"])).otherwise("")


def quantity_key(base: Column) -> Column:
    return F.replace(amount_key(base), F.lit("."), F.lit("_"))


def comparison_group(signature: Column, base: Column, price: Column, single: Column) -> Column:
    ok = (signature != "") & price["comparable"] & (price["amount"] > 0) & (amount_key(base) != "") & single
    return F.when(F.coalesce(ok, F.lit(False)), F.concat_ws("::", signature, amount_key(base))).otherwise("")
