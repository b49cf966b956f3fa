import glob
import os

import pytest
from pyspark.sql import functions as F

from offerlens.operators import overrides
from offerlens.sources import versions

COLUMNS = "offer_id long, retailer_key string, title string, title_normalized string, brand string, category_primary string, category_secondary string, category_key string, main_category_key string, search_text string, rule_id long"


def offers(spark):
    rows = [(i, f"r{i % 6}", t, t.lower(), "b", "Haushalt", s, "k", "m", "old", None) for i, (t, s) in enumerate([("Milch", "Milch"), ("Brot", "Brot"), ("Zeitung", "Papier"), ("Milch", "Milch"), ("Seife", "PAPIER"), ("Zeitung", "Papier"), ("Milch", "Milch"), ("Kohl", "Gemuese")])]
    return spark.createDataFrame(rows, COLUMNS)


def no_rules(spark):
    return spark.createDataFrame([], overrides.RULE_SCHEMA)


def now():
    return F.lit("2025-05-10").cast("timestamp")


def files(root):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/versions/*/*/*.parquet")}


def test_rules_are_put_over_their_equals(spark):
    put = lambda rules, new: spark.createDataFrame(overrides.with_rules(rules, new(rules)).collect(), overrides.RULE_SCHEMA)
    rules = no_rules(spark)
    for new in (
        lambda r: overrides.article_rule(r, "A", "a", now(), title=" milch "), lambda r: overrides.article_rule(r, "B", "b", now(), display="MILCH!"), lambda r: overrides.article_rule(r, "C", "c", now(), title="milch", retailer="r1"),
        lambda r: overrides.subcategory_rule(r, "  Papier ", "Buero", now()), lambda r: overrides.subcategory_rule(r, "papier", "Haushalt", now()), lambda r: overrides.ignore_rule(r, now(), title="milch"),
    ):
        rules = put(rules, new)
    got = {(r.rule_id, r.kind, r.retailer_key, r.title_normalized, r.from_sub, r.to_primary, r.to_sub) for r in rules.collect()}
    assert got == {(1, "article", "", "milch", "", "B", "b"), (2, "article", "r1", "milch", "", "C", "c"), (3, "subcategory", "", "", "papier", "Haushalt", "papier"), (4, "ignore", "", "milch", "", None, None)}


def test_a_change_rewrites_the_parts_it_reaches(spark, tmp_path):
    root = f"{tmp_path}/t"
    first = versions.write(offers(spark), root, "retailer_key", 16)
    was = files(root)
    rules = no_rules(spark)
    rules, counts = overrides.change_stored(spark, root, rules, overrides.article_rule(rules, "Getraenke", "Milchgetraenke", now(), title="milch", retailer="r0"))
    assert counts == {"matched": 2, "modified": 2, "deleted": 0}
    second = versions.state(spark, root)
    assert (first.number, second.number) == (1, 2) and len({p for p in second.parts if second.parts[p] != first.parts[p]}) == 1
    assert {p: t for p, t in files(root).items() if p in was} == was  # no file of the first version was touched
    rows = {r.offer_id: r for r in versions.read(spark, root).collect()}
    assert len(rows) == 8 and {i for i, r in rows.items() if r.category_secondary == "Milchgetraenke"} == {0, 6}
    assert (rows[0].rule_id, rows[0].main_category_key, rows[0].category_key, rows[0].search_text) == (1, "getraenke", "milchgetraenke", "milch b getraenke milchgetraenke") and rows[3].search_text == "old"
    assert {r.offer_id for r in versions.read(spark, root, at=first).filter("search_text = 'old'").collect()} == set(range(8))  # readers of the first version still see it


def test_kinds_and_counts(spark, tmp_path):
    root = f"{tmp_path}/t"
    versions.write(offers(spark), root, "retailer_key", 16)
    rules, counts = overrides.change_stored(spark, root, no_rules(spark), overrides.subcategory_rule(no_rules(spark), "Papier", "Buero / Schule", now()))
    assert counts["matched"] == 3 and counts["deleted"] == 0
    rules, counts = overrides.change_stored(spark, root, rules, overrides.ignore_rule(rules, now(), display="Zeitung"))
    assert counts == {"matched": 2, "modified": 2, "deleted": 2}
    rows = {r.offer_id: r for r in versions.read(spark, root).collect()}
    assert set(rows) == {0, 1, 3, 4, 6, 7}
    number = versions.state(spark, root).number
    _, counts = overrides.change_stored(spark, root, rules, overrides.ignore_rule(rules, now(), title="nothing"))
    assert counts == {"matched": 0, "modified": 0, "deleted": 0} and versions.state(spark, root).number == number


def test_a_table_without_rows_left(spark, tmp_path):
    root = f"{tmp_path}/t"
    versions.write(offers(spark).filter("title = 'Milch'"), root, "retailer_key", 16)
    overrides.change_stored(spark, root, no_rules(spark), overrides.ignore_rule(no_rules(spark), now(), title="milch"))
    assert versions.read(spark, root).count() == 0 and versions.state(spark, root).parts == {}


def test_two_writers_of_one_version(spark, tmp_path):
    root = f"{tmp_path}/t"
    base = versions.write(offers(spark), root, "retailer_key", 4)
    every = versions.read(spark, root)
    versions.rewrite(every.filter("offer_id < 5"), root, base.parts, base)
    with pytest.raises(versions.Conflict):
        versions.rewrite(every.filter("offer_id < 3"), root, base.parts, base)
    assert versions.read(spark, root).count() == 5 and versions.state(spark, root, 1) == base
    with pytest.raises(ValueError):
        versions.rewrite(every, root, list(base.parts)[:1], versions.state(spark, root))
    assert versions.state(spark, f"{tmp_path}/none") is None
