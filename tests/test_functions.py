"""Case tables of the column functions: one row for each branch."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from offerlens.functions import dates, numbers, promotions, text, units
from offerlens.operators import classify

def as_of():
    return F.lit("2024-05-15 10:00:00").cast("timestamp")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(v, kind="string"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize(
    "function, given, want",
    [
        (text.squeezed, "  a \t b ", "a b"), (text.squeezed, None, ""), (text.match_title, "Crème brûlée, 2 Stück", "creme brulee 2 stuck"), (text.match_title, "Straße", "stra e"),
        (text.ascii_lower, "Öl Straße é", "oel strasse é"), (text.search_words, "Käse-Brot!", "kaese brot"), (text.search_words, "Café Crème", "cafe cre me"), (text.search_words, "Cafe\u0301x Ａ", "cafe x a"), (text.match_title, "Łódź šunka ž ő ＡＢ cafe\u0301", "odz sunka z o ab cafe"), (text.slug, "Obst & Gemüse!", "obst-gemuse"), (text.raw_key, "Obst & Gemüse!", "obst-gem-se-"),
        (text.humanized, "obst-gemuse", "obst gemuse"), (text.entities_decoded, "a &amp;lt; &quot;b&quot;", 'a &lt; "b"'), (text.is_broad, "Drogerie / Hygiene", True), (text.is_broad, "Buero / Schule", False),
    ],
)
def test_text(spark, function, given, want):
    assert one(spark, function(lit(given))) == want


def test_phrases_signatures_and_keys(spark):
    assert one(spark, text.has_phrase(lit("rote apfel saft"), lit("apfel saft"))) is True
    assert one(spark, text.has_phrase(lit("rote apfelsaft"), lit("apfel"))) is False
    assert one(spark, text.has_phrase(lit("rote"), lit(""))) is False
    assert one(spark, text.signature(lit("Bio Milch 1,5 % 1 Liter und Butter"), lit("Marke"))) == "marke-bio-milch-butter"
    assert one(spark, text.aggregator_signature(lit("Käse vom Markt"), lit("Spar"))) == "kase-vom"
    assert one(spark, text.joined_key(lit("a"), lit(None), lit(""), lit("b"))) == "a::na::na::b"
    assert one(spark, text.number_text(lit(5.0, "double"))) == "5"
    assert one(spark, text.display_category(lit("Haushalt"), lit("Kaese"))) == "Kaese"


@pytest.mark.parametrize(
    "variant, given, want",
    [
        *[("promotion", g, w) for g, w in ((None, None), ("", None), ("1,99", 1.99), ("1.234,50", 1234.5), ("€ 2", 2.0), ("abc", None), ("12.5", 12.5))],
        ("official", "abc", 0.0), ("official", "", None), ("plain", "$undefined", None), ("plain", "1,5", 1.5), ("plain", "€ 2", None),
    ],
)
def test_amounts(spark, variant, given, want):
    assert one(spark, numbers.amount(lit(given), variant)) == want


def test_rounding_and_clamps(spark):
    assert one(spark, numbers.half_up(F.lit(-2.5))) == -2
    assert one(spark, numbers.money(F.lit(0.125))) == 0.13
    for v, want in ((0.015, 0.01), (0.045, 0.04), (1.005, 1.0), (2.675, 2.67), (0.375, 0.38), (-0.125, -0.13), (1e15, 1e15), (8.345, 8.35), (None, None)):
        assert one(spark, numbers.money(lit(v, "double"))) == want, v
    from decimal import ROUND_HALF_UP, Decimal

    thousandths = spark.range(200_001).select((F.col("id") / 1000).alias("v")).select("v", numbers.money(F.col("v")).alias("m"), numbers.cents(F.col("v")).alias("c")).collect()
    for r in thousandths:
        cents = int((Decimal(r.v) * 100).quantize(Decimal(1), ROUND_HALF_UP))
        assert r.c == cents and r.m == cents / 100, r
    assert one(spark, numbers.clamped(lit(None, "double"), 0, 1)) is None
    assert [one(spark, numbers.truthy(lit(v, k), k if k != "double" else "number")) for v, k in ((0.0, "double"), (2.0, "double"), (float("nan"), "double"), (None, "double"), ("", "string"), ("x", "string"))] == [False, True, False, False, False, True]


def test_dates(spark):
    assert one(spark, dates.date_in_text(lit("gültig ab 03.05.2024 im Markt"))) == datetime(2024, 5, 3, 12)
    assert one(spark, dates.date_in_text(lit("31.02.2024"))) is None
    assert one(spark, dates.date_in_url(lit("https://x/d.07-05-2024.html"))) == datetime(2024, 5, 7, 12)
    begin, end = dates.date_range(lit("28.12. - 03.01."), as_of())
    assert (one(spark, begin), one(spark, end)) == (datetime(2024, 12, 28, 12), datetime(2025, 1, 3, 12))
    begin, end = dates.date_range(lit("01.02.2023 - 05.02.2023"), as_of())
    assert (one(spark, begin), one(spark, end)) == (datetime(2023, 2, 1, 12), datetime(2023, 2, 5, 12))
    assert one(spark, dates.date_range(lit("bald"), as_of())[0]) is None
    assert one(spark, dates.latest_date(lit("01.02.2023 und 05.02.2023"))) == datetime(2023, 2, 5, 12)
    begin, end = dates.date_range(lit("30.01.2023 - 31.02.2023"), as_of())
    assert (one(spark, begin), one(spark, end)) == (datetime(2023, 1, 30, 12), datetime(2023, 3, 3, 12))
    assert one(spark, dates.date_range(lit("1.2.2023 - 5.2.2023"), as_of())[0]) is None
    assert one(spark, dates.leaflet_dates(lit("/blatt-06-05-2024-12-05-2024/"))[1]) == datetime(2024, 5, 12, 12)


@pytest.mark.parametrize(
    "begin, end, snapshot, want",
    [(None, None, True, "active"), ("2024-06-01", None, False, "upcoming"), (None, "2024-05-01", False, "expired"), ("2024-05-01", "2024-06-01", False, "active"), (None, "2024-06-01", False, "active"), (None, None, False, "unknown")],
)
def test_status(spark, begin, end, snapshot, want):
    assert one(spark, dates.status(lit(begin, "timestamp"), lit(end, "timestamp"), F.lit(snapshot), as_of())) == want


@pytest.mark.parametrize("given, want", [("Kilogramm", "kg"), ("g", "g"), ("Milliliter", "ml"), ("cl", "cl"), ("Liter", "l"), ("Stück", "Stk"), ("Bund", "Bund"), (None, "")])
def test_unit_symbols(spark, given, want):
    assert one(spark, units.symbol(lit(given))) == want


def test_unit_prices(spark):
    base = units.comparable_base(lit(500, "double"), lit("g"), lit(2, "double"), lit("Pkg"), F.lit(True))
    assert one(spark, base).asDict() == {"quantity": 1.0, "unit": "kg", "comparable": True}
    assert one(spark, units.comparable_base(lit(None, "double"), lit(""), lit(6, "double"), lit("Stk"), F.lit(False))).quantity == 6
    assert one(spark, units.comparable(lit(3, "double"), lit("Bund"))).comparable is False
    assert one(spark, units.unit_price(lit(1.99, "double"), base)).amount == 1.99
    assert one(spark, units.unit_price_in_text(lit("0,50 € per 100 g"))).amount == 5.0
    assert one(spark, units.unit_price_in_text(lit("(1 l = 1.20)"))).asDict() == {"amount": 1.2, "unit": "l"}
    found = one(spark, units.quantities_in_text(lit("Saft 1,5 l, 6 Stk, 5 Gurken")))
    assert [(q.quantity, q.unit) for q in found] == [(1.5, "l"), (6.0, "Stk")]
    assert one(spark, units.comparison_group(lit("milch"), base, units.unit_price(lit(1.0, "double"), base), F.lit(True))) == "milch::1-kg"
    assert one(spark, units.comparison_group(lit("milch"), base, units.unit_price(lit(1.0, "double"), base), F.lit(False))) == ""


@pytest.mark.parametrize(
    "title, conditions, tags, minimum, benefit, want",
    [
        ("x", "", None, 3, "unknown", (3, None, "threshold")), ("x", "", ["pt-2plus1"], None, "unknown", (3, 2, "x-plus-y")), ("Aktion 2+1 gratis", "", None, None, "unknown", (3, 2, "x-plus-y")), ("3 für 2", "", None, None, "unknown", (3, 2, "x-for-y")),
        ("x", "ab 4 Stk", None, None, "unknown", (4, None, "threshold")), ("x", "ab 3Stk", None, None, "unknown", (3, None, "threshold")), ("x", "Ab  6 Gläser", None, None, "unknown", (6, None, "threshold")), ("x", "", ["PT-2plus1"], None, "unknown", (3, 2, "x-plus-y")), ("4 FÜR 3", "", None, None, "unknown", (4, 3, "x-for-y")), ("x", "", None, None, "multi-buy", (2, None, "multi-buy")), ("x", "", None, None, "unknown", (1, None, "single")),
    ],
)
def test_requirements(spark, title, conditions, tags, minimum, benefit, want):
    tags = F.array(*[F.lit(t) for t in tags]) if tags else lit(None, "array<string>")
    r = one(spark, promotions.requirement(lit(title), lit(conditions), tags, lit(minimum, "int"), lit(benefit)))
    assert (r.required, r.payable, r.mechanic) == want


def saved(spark, current, reference, percent, estimated, title="x"):
    needs = promotions.requirement(lit(title), lit(""), lit(None, "array<string>"), lit(None, "int"), lit("unknown"))
    s = one(spark, promotions.savings(lit(current, "double"), lit(reference, "double"), lit(percent, "double"), F.lit(estimated), needs))
    return s.amount, s.percent


def test_savings(spark):
    assert saved(spark, 1.99, 2.49, None, True) == (None, None)
    assert saved(spark, 2.0, 2.5, None, False) == (0.5, 20.0)
    assert saved(spark, 3.0, None, 25.0, False) == (1.0, 25.0)
    assert saved(spark, 3.0, None, 100.0, False) == saved(spark, 3.0, None, 0.0, False) == (None, None)
    assert saved(spark, 2.0, 2.0, None, False, "2+1") == (2.0, 33.33)
    assert saved(spark, 3.0, 2.0, None, False) == (None, None)


def test_benefits_and_discounts(spark):
    assert one(spark, promotions.benefit_type(lit("statt 3"), lit(None), lit(None, "double"))) == "price-cut"
    assert one(spark, promotions.benefit_type(lit("1+1"), lit(None), lit(None, "double"))) == "multi-buy"
    assert one(spark, promotions.discount_type(lit("unknown"), F.lit(True), lit(None, "int"), lit("single"))) == "card-required"
    assert one(spark, promotions.program_required(lit("mit Kundenkarte"))) is True


@pytest.mark.parametrize(
    "title, context, want",
    [
        ("Smart TV 55 Zoll", "", ("Technik / Elektronik", "Unterhaltungselektronik", 0.98)), ("Frische Milch", "", ("Lebensmittel", "Milchprodukte", 0.88)), ("Genuss", "", ("Lebensmittel", "Lebensmittel", 0.76)),
        ("Irgendwas", "", ("Lebensmittel", "Lebensmittel", 0.35)), ("Papier", "", ("Haushalt", "Papier & Buero", 0.88)), ("Irgendwas", "Bier", ("Getraenke", "Bier", 0.88)),
    ],
)
def test_classification(spark, title, context, want):
    c = one(spark, classify.classified(lit(title), lit(context)))
    assert (c.primary, c.secondary, round(c.confidence, 9)) == want


def test_decision_reviews(spark):
    d = one(spark, classify.decision(lit("Irgendwas")))
    assert d.needs_review and d.reasons == ["category-low-confidence", "subcategory-low-confidence"]
    d = one(spark, classify.decision(lit("Frische Milch")))
    assert (d.secondary, round(d.subcategory_confidence, 9), d.needs_review) == ("Milchprodukte", 0.84, False)


def test_words_are_found_as_single_patterns_find_them(spark):
    """All words of all rules in one pass, against each rule's own pattern."""
    import random
    import re

    r = random.Random(7)
    every = sorted({x.word for x in classify.rules()})
    texts = ["", "x", *every] + [" ".join(r.choice(every)[: r.randrange(1, 12)] + r.choice(["", "", "s", " ", "ab"]) + r.choice(every) for _ in range(r.randrange(1, 4))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    by = classify.DEFAULT
    got = df.select("i", by.any.numbers(F.col("t")).alias("a"), by.first.numbers(F.col("t")).alias("o")).collect()
    patterns = [p for _, _, p in classify.SUB_RULES] + [p for _, p, _ in classify.TAXONOMY]
    for row in got:
        t = texts[row.i]
        assert sorted(row.a) == [k for k, p in enumerate(patterns) if re.search(p, t)], t
        assert sorted(row.o) == [k for k, (p, _, _) in enumerate(classify.OVERRIDES) if re.search(p, t, re.ASCII)] or not t.isascii(), t


def test_classification_of_several_texts(spark):
    """Scores by hand: the title's hits, hits of context and source, equal and empty texts, precedence on ties."""

    def plain(title, context, source):
        import re

        key = lambda c: re.sub("[^a-z0-9]+", " ", (c or "").lower()).strip()
        t, o = key(title), [key(context), key(source)]
        hay = " ".join(x for x in (t, *o)).strip()
        for p, m, s in classify.OVERRIDES:
            if re.search(p, hay):
                return m, s, 0.98
        def score(p):
            n = 4 if t and re.search(p, t) else 0
            for i, x in enumerate(o):
                if x and re.search(p, x):
                    n += 4 if x == t or (i == 0 and not t) else 2
            return n
        best = max(((score(p), -i, m, s) for i, (m, s, p) in enumerate(classify.SUB_RULES)))
        if best[0] >= 2:
            return best[2], best[3], 0.88
        best = max(((score(p), -i, m) for i, (m, p, _) in enumerate(classify.TAXONOMY)))
        label = " ".join((source or "").split())
        if best[0] >= 2:
            return best[2], label or best[2], min(1.0, 0.52 + best[0] * 0.06)
        return "Lebensmittel", label or "Lebensmittel", 0.35

    import itertools

    words = ["", None, "Milch", "Hundefutter Rind", "Bio", "haushalt", "Drucker", "irgendwas", "Apfel Saft", "kinder  garten"]
    rows = list(itertools.product(words, words, words))
    df = spark.createDataFrame(rows, "t string, c string, s string")
    for row in df.select("t", "c", "s", classify.classified(F.col("t"), F.col("c"), F.col("s")).alias("x")).collect():
        want = plain(row.t, row.c, row.s)
        assert (row.x.primary, row.x.secondary) == want[:2] and abs(row.x.confidence - want[2]) < 1e-12, (row, want)


def test_rules_are_a_table(spark):
    table = classify.rules_table(spark)
    assert table.filter("kind = 'sub'").select("number").distinct().count() == len(classify.SUB_RULES)
    kept = [classify.Rule(*r) for r in table.filter("main <> 'Tierbedarf'").collect()]
    other = classify.Classifier([*kept, classify.Rule("override", 99, "Neu", "Ganz neu", "hund")])
    row = spark.range(1).select(classify.classified(F.lit("Hund Futter"), by=other).alias("a"), classify.classified(F.lit("Hundefutter"), by=other).alias("b")).first()
    assert (row.a.primary, row.a.secondary) == ("Neu", "Ganz neu") and row.b.primary != "Tierbedarf"
