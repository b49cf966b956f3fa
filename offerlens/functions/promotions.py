"""Promotions: what has to be bought, what that saves, and which kind of discount it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions import numbers, text

# Words of estimated references, and the wordings of promotions.
ESTIMATED = "estimated|history|historisch|product-search|produktseite|reference"


TAG = r"(?i)\b(?:pt-)?(\d+)plus(\d+)\b"
PLUS = r"\b(\d+)\s*\+\s*(\d+)\b"
FOR_RAW = r"(?i)\b(\d+)\s*(?:fur|fuer|für)\s*(\d+)\b"
FOR = r"\b(\d+)\s*(?:fur|fuer)\s*(\d+)\b"
FROM = r"\bab\s+(\d+)\s*(?:stk|stueck|stuck|dosen|flaschen|packungen|rollen|beutel|glaser|glaeser)\b"


def _requirement(required, payable, mechanic: str) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(required).cast("int").alias("required"), as_col(payable).cast("int").alias("payable"), F.lit(mechanic).alias("mechanic"))


def requirement(title: Column, conditions: Column, tags: Column, minimum: Column, benefit: Column, loyalty_tags: Column | None = None) -> Column:
    """struct(required, payable, mechanic) by the first rule that holds: minimum, tag NplusM, N + M, N für M, ab N pieces, multi-buy."""
    said = F.concat_ws(" ", title, conditions)
    words = text.match_title(said)
    none = F.array().cast("array<string>")
    tagged = F.array_join(F.concat(F.coalesce(tags, none), F.coalesce(loyalty_tags, none) if loyalty_tags is not None else none), " ")
    number = lambda c, pattern, k: F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).try_cast("int")
    return (
        F.when(minimum > 1, _requirement(minimum, None, "threshold"))
        .when(tagged.rlike(TAG), _requirement(number(tagged, TAG, 1) + number(tagged, TAG, 2), number(tagged, TAG, 1), "x-plus-y"))
        .when(said.rlike(PLUS), _requirement(number(said, PLUS, 1) + number(said, PLUS, 2), number(said, PLUS, 1), "x-plus-y"))
        .when(said.rlike(FOR_RAW), _requirement(number(said, FOR_RAW, 1), number(said, FOR_RAW, 2), "x-for-y"))
        .when(words.rlike(FOR), _requirement(number(words, FOR, 1), number(words, FOR, 2), "x-for-y"))
        .when(words.rlike(FROM), _requirement(number(words, FROM, 1), None, "threshold"))
        .when(benefit == "multi-buy", _requirement(2, None, "multi-buy"))
        .otherwise(_requirement(1, None, "single"))
    )


def savings(current: Column, reference: Column, percent: Column, estimated: Column, needs: Column) -> Column:
    """struct(reference_total, current_total, amount, percent); nulls where there is no reference or nothing is saved.

    An estimated reference is no reference; without one, a percentage strictly between 0 and 100 gives it.
    """
    given = F.when(~F.coalesce(estimated, F.lit(False)) & (reference > 0), reference)
    from_percent = F.when((percent > 0) & (percent < 100), numbers.once(current / (1 - percent / 100), numbers.money))
    pays_less = lambda ref: needs["payable"].isNotNull() & (given.isNull() | (current >= ref))
    totals = lambda ref: F.struct(
        numbers.once(ref * needs["required"], numbers.money).alias("before"), numbers.once(F.when(pays_less(ref), ref * needs["payable"]).otherwise(current * needs["required"]), numbers.money).alias("now")
    )

    def result(t: Column) -> Column:
        percent_of = lambda saved: F.when(saved > 0, numbers.once(saved / t["before"] * 100, numbers.money))
        shape = lambda saved: F.struct(t["before"].alias("reference_total"), t["now"].alias("current_total"), F.when(saved > 0, saved).alias("amount"), percent_of(saved).alias("percent"))
        return numbers.once(numbers.once(t["before"] - t["now"], numbers.money), shape)

    return numbers.once(numbers.once(F.coalesce(given, from_percent), totals), result)


def is_estimated(display_type: Column, flag: Column, source: Column) -> Column:
    return (F.coalesce(display_type, F.lit("")) == "estimated-reference-price") | F.coalesce(flag, F.lit(False)) | F.lower(F.coalesce(source, F.lit(""))).rlike(ESTIMATED)


def benefit_type(title: Column, description: Column, percent: Column) -> Column:
    said = text.ascii_lower(F.concat_ws(" ", title, description))
    return F.when(numbers.truthy(percent, "number") | said.rlike("%|statt"), "price-cut").when(said.rlike(r"\b\d+\+\d+\b|\bgratis\b"), "multi-buy").otherwise("unknown")


def discount_type(benefit: Column, program: Column, minimum: Column, mechanic: Column) -> Column:
    return (
        F.when(mechanic.isin("x-plus-y", "x-for-y") | (benefit == "multi-buy"), "multi-buy").when((F.coalesce(minimum, F.lit(0)) > 1) | (mechanic == "threshold"), "threshold")
        .when(benefit == "price-cut", "price-cut").when(program, "card-required").otherwise("unknown")
    )


def program_required(*parts: Column) -> Column:
    return text.ascii_lower(F.concat_ws(" ", *parts)).rlike("(joe|karte|kundenkarte|app|konto|club)")
