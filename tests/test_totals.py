from pyspark.sql import functions as F

from offerlens.operators import classify, metadata
from offerlens.plans import served

SCHEMA = "main_key string, sub_key string, category_primary string, category_secondary string, retailer_key string, is_active boolean, price double"


def test_levels_of_totals(spark):
    rows = [("a", "x", "", "", "r", True, 1.1), ("a", "x", "", "", "s", False, 2.2), ("a", "y", "", "", "r", True, 0.1), (None, "x", "", "", "r", None, None)]
    got = {(r.level, r.main_key, r.sub_key): (r.offer_count, r.active_count, r.retailer_count, float(r.price_sum)) for r in metadata.totals(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("sub", "a", "x"): (2, 1, 2, 3.3), ("sub", "a", "y"): (1, 1, 1, 0.1), ("sub", "", "x"): (1, 0, 1, 0.0), ("main", "a", ""): (3, 2, 2, 3.4), ("main", "", ""): (1, 0, 1, 0.0), ("all", "", ""): (4, 2, 2, 3.4)}
    assert metadata.totals(spark.createDataFrame([], SCHEMA)).count() == 0


def test_labels_in_german_order(spark):
    rows = [("", "", m, s, "r", True, 1.0) for m, s in (("Öl", "Zucker"), ("Obst", "Öl"), ("Haushalt", "obst"), ("Haushalt", None), ("Lebensmittel", " "), ("Zucker", "Äpfel"))]
    got = [(r.label, r.n) for r in metadata.label_counts(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()]
    assert got == [("Öl", 2), ("Zucker", 2), ("Äpfel", 1), ("obst", 1), ("Obst", 1)]


def test_options_of_the_taxonomy(spark):
    rules = classify.rules_table(spark).filter("kind = 'sub'")
    (row,) = metadata.subcategory_options(rules, "number").collect()
    assert sorted(row.options) == sorted(m for m, _, _ in classify.TAXONOMY) and all(row.options[m] == [s for s, _ in subs] for m, _, subs in classify.TAXONOMY)


def test_basket_totals(spark):
    rows = [(1, "rote Milch", "r", 1.1, 1.1), (2, "Brot", "s", 2.25, 2.25), (3, "Brot alt", "s", 9.0, 9.0), (4, "Salz", "s", 0.5, 0.5)]
    df = spark.createDataFrame(rows, "offer_id long, title string, retailer_key string, price double, unit_price double").withColumns({c: F.lit("") for c in ("category_secondary", "brand", "category_primary", "category_key", "main_key", "sub_key", "unit")} | {"is_active": F.lit(True), "comparison_safe": F.lit(True), "program_required": F.lit(False)})
    got = served.basket_suggestions(df, "Milch, Brot\nSalz,Kaviar, ")
    assert [(r.item_count, r.matched_count, float(r.total), r.retailer_count) for r in got["summary"].collect()] == [(4, 3, 3.85, 2)]
    assert [(r.retailer_key, r.n, float(r.total)) for r in got["mix"].collect()] == [("s", 2, 2.75), ("r", 1, 1.1)]
    none = served.basket_suggestions(df, "Kaviar")
    assert [(r.item_count, r.matched_count, float(r.total), r.retailer_count) for r in none["summary"].collect()] == [(1, 0, 0.0, 0)] and none["mix"].count() == 0
