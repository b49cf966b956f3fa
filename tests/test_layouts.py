import datetime as dt

import pytest
from pyspark.sql import functions as F

from offerlens.operators import normalize
from offerlens.sources import layouts, selectors

NOW = dt.datetime(2025, 5, 10, 12)

PAGE = """<html><body id=top class="a b"><!-- <p class=x> --><ul class="nav main"><li><a href="/p/1" data-k='v w'>One</a><li><a href='/q/2.pdf'>Two &amp; <b>more</b></a></ul>
<p>first<p class="x">second <br/>line<div class="x y"><p>in <span>deep</span></div><table><tr><td>1<td>2<tr><td>3</table><input data-test="a b" disabled><script>var x = "<p class='x'>";</script></body></html>"""


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("li", ["One", "Two & more"]), ("ul > li > a", ["One", "Two & more"]), ("body > a", []), (".nav.main a", ["One", "Two & more"]), ("#top .x", ["second line", "in deep"]), ("p.x", ["second line"]), ("div p", ["in deep"]),
        ('a[href^="/p/"]', ["One"]), ("a[href$='.pdf']", ["Two & more"]), ("a[href*=q]", ["Two & more"]), ('a[data-k~="w"]', ["One"]), ('a[data-k="v w"]', ["One"]), ('a[href^=""]', []), ("[disabled]", [""]), ('[data-test="a b"]', [""]),
        ("td", ["1", "2", "3"]), ("tr", ["12", "3"]), ("b, span", ["more", "deep"]), ("div *", ["in deep", "deep"]), ("p", ["first", "second line", "in deep"]), ("html body div > p > span", ["deep"]), ('a[href="x,y"], li > a[href="/p/1"]', ["One"]),
    ],
)
def test_selectors(selector, texts):
    assert [e.text() for e in selectors.Page(PAGE).find(selector)] == texts


def test_selectors_look_below_an_element_and_up():
    page = selectors.Page(PAGE)
    (div,) = page.find("div")
    assert [e.text() for e in page.find("body p", div)] == ["in deep"] and page.find("li", div) == []
    span = page.find("span", div)[0]
    assert page.closest(span, "li, div") is div and page.closest(span, "span") is span and page.closest(span, "table") is None


@pytest.mark.parametrize("bad", ["", ">", "a >", "a[", "a:hover", "a[b=c"])
def test_what_is_no_selector(bad):
    with pytest.raises(ValueError):
        selectors._compounds(bad)


def test_odd_pages_end():
    for html in (None, "", "<", "<a", "</p></div>", "<p" * 2000, "<div>" * 20000 + "x", "<p>" * 20000, "<a href=x" + " b" * 5000 + ">", "\x00<b>\x00</b>"):
        page = selectors.Page(html)
        assert page.elements[0].end == len(page.elements) and page.elements[0].text() is not None
        page.find("div p > a")


PENNY = """<div class="ws-product-tile"><a href="/produkte/milch-1"><img src="/m.png"></a><div data-test="product-title">Frische Milch • Ja! Natürlich</div><span data-test="product-information-piece-description">1 l</span>
<div data-test="product-price-validity"><div>Do. 08.05.2025</div><div>Mi. 14.05.2025</div></div><b data-test="product-price-type-value">1,49</b><i data-test="product-price-type-label">1 l = 1,49</i></div>
<ul><li><a href="/produkte/brot">Brot<b data-test="product-price-type-value">2.99</b></a><li><a href="/produkte/leer">Leer</a><li><a href="/rezepte/x">Rezept</a></ul>"""
BIPA = """<p>Gültig bis 14.05.2025, andere gueltig BIS 12.05.2025</p><a data-testid="product-tile-1" href="/p/seife" title="t"><img src="s.jpg"><p>Dove</p><p></p><p>Seife</p><p>90 g</p><p>€ 1,99</p><p>1 kg = 22,11</p></a>
<a data-testid="tile-2" href="/p/x"><p>A</p><p>B</p><p>€ 1</p></a><a data-testid="product-tile-3" href="/q/x"><p>€ 1</p></a><a data-testid="product-tile-4" href="/p/y" title="Nur Titel"><p>Marke</p></a>"""
HOFER = """<div class="plp_product wide"><img data-src="late.png" src="now.png"><h2 class="product-title">Apfel<span> rot</span></h2><span class="at-product-price_lbl">€ 1,99</span><s class="price_before">2,49</s><p class="additional-product-info">1 kg</p></div>
<div class="plp_product"><img class="at-product-images_img" src="best.png"><div class="product-title">Birne</div><div class="at-product-price_lbl">0,99</div>ab 09.05.2025</div><div class="plp_product_teaser"><div class="product-title">x</div><div class="at-product-price_lbl">1</div></div>"""
LIST = """<ul><li class="offer-list-item"><a href="/offers/1"><img class="offer-list-item-img" src="i.png"></a><h3>Butter</h3><dl><dt>Marke<dd class="brand">Schärdinger<dt>Gültig<dd class="valid">08.05. - 14.05.</dl>
<div class="price-bubble"><span class="price">€ 1,99</span><span class="old-price">€ 2,99</span></div><p class="info">250 g</p><div class="retailer"><a href="https://shop.at/b">Shop</a></div></li><li class="offer-list-item"><h3>Ohne Preis</h3></li></ul>"""
CATEGORY = """<article><a href="/l/kaese-08-05-2025-14-05-2025/"><img src="k.png" alt="Bildtext"></a><p class="text-card-text-primary">Käse</p><span class="text-card-text-accent">3,49 €</span><span class="line-through">4,99</span>
<span class="text-card-text-secondary">250 g</span><span class="text-card-text-secondary">13,96 / kg</span></article><article><a href="/l/y"><img alt="Nur Bild"></a><b class="text-card-text-accent">2</b></article><article><p>kein Angebot</p></article>"""
LINKS = """<div><img src="near.png"><a href="/p/77">Zahnpasta Mint Preis nur 1,79 € 75 ml Entfernt: 2,3 km Kategorie: Drogerie</a></div><a href="/p/78">Ohne Preis</a><a href="/h/1">Preis nur 1 €</a>"""


def offers(spark, layout, html, url="https://h.at/a/"):
    df = spark.createDataFrame([("s", "r", "R", "official-site", url, html, NOW), ("s", "r", "R", "official-site", url, None, NOW)], "source_id string, retailer_key string, retailer_name string, channel string, url string, html string, fetched_at timestamp")
    rows = layouts.records(df, layout).orderBy("position").collect()
    normal = {r.title: r for r in normalize.offers(normalize.from_layout(layout)(df), F.lit("2025-05-10").cast("timestamp")).select("title", "price", "reference", "valid_from", "valid_to", "url", "unit_price.amount", "status").collect()}
    return rows, normal


def noon(day):
    return dt.datetime(2025, 5, day, 12)


def test_penny(spark):
    rows, normal = offers(spark, "penny", PENNY)
    assert [(r.title, r.brand, r.price, r.quantity_text, r.unit_price_text, r.link, r.image) for r in rows] == [("Frische Milch", "Ja! Natürlich", "1,49", "1 l", "1 l = 1,49", "https://h.at/produkte/milch-1", "/m.png"), ("Brot2.99", "", "2.99", "", "", "https://h.at/produkte/brot", "")]
    assert (rows[0].valid_from, rows[0].valid_to, rows[1].valid_from) == (noon(8), noon(14), None)
    milk = normal["Frische Milch"]
    assert (milk.price, milk.amount, milk.status, milk.url) == (1.49, 1.49, "active", "https://h.at/produkte/milch-1")


def test_bipa(spark):
    rows, normal = offers(spark, "bipa", BIPA)
    assert [(r.title, r.brand, r.price, r.quantity_text, r.unit_price_text, r.link, r.image, r.valid_from, r.valid_to, r.snapshot) for r in rows] == [("Seife", "Dove", "€ 1,99", "90 g", "1 kg = 22,11", "https://h.at/p/seife", "s.jpg", NOW, noon(12), True)]
    assert normal["Seife"].price == 1.99


def test_hofer(spark):
    rows, _ = offers(spark, "hofer", HOFER, "https://h.at/d.08-05-2025.html")
    assert [(r.title, r.price, r.old_price, r.quantity_text, r.image, r.valid_from, r.valid_to, r.link) for r in rows] == [
        ("Apfel rot", "€ 1,99", "2,49", "1 kg", "late.png", noon(8), None, "https://h.at/d.08-05-2025.html"), ("Birne", "0,99", "", "", "best.png", noon(9), None, "https://h.at/d.08-05-2025.html"),
    ]
    pages = spark.createDataFrame([(s, f"https://h.at/d.{d}-05-2025.html", HOFER, NOW) for s, d in (("a", "08"), ("a", "12"), ("a", "12"), ("b", "10"), ("a", "20"))], "source_id string, url string, html string, fetched_at timestamp")
    ends = {(r.source_id, r.url[15:17], r.valid_to) for r in layouts.records(pages, "hofer").filter("title = 'Apfel rot'").collect()}
    assert ends == {("a", "08", noon(11)), ("a", "12", noon(19)), ("a", "20", None), ("b", "10", None)}


def test_offer_list(spark):
    rows, normal = offers(spark, "offer-list", LIST)
    assert [(r.title, r.brand, r.price, r.old_price, r.quantity_text, r.link, r.image, r.valid_from, r.valid_to) for r in rows] == [("Butter", "Schärdinger", "€ 1,99", "€ 2,99", "250 g", "https://shop.at/b", "i.png", noon(8), noon(14))]
    assert (normal["Butter"].reference, normal["Butter"].amount) == (2.99, 7.96)


def test_category(spark):
    rows, _ = offers(spark, "category", CATEGORY, "https://h.at/ppcv/milch-produkte/x")
    assert [(r.title, r.price, r.old_price, r.unit_price_text, r.description, r.source_category, r.link, r.image, r.valid_from, r.valid_to, r.snapshot) for r in rows] == [
        ("Käse", "3,49 €", "4,99", "13,96 / kg", "milch produkte / 13,96 / kg", "milch produkte", "https://h.at/l/kaese-08-05-2025-14-05-2025/", "k.png", noon(8), noon(14), False),
        ("Nur Bild", "2", "", "", "milch produkte", "milch produkte", "https://h.at/l/y", "", None, None, True),
    ]


def test_product_links(spark):
    rows, normal = offers(spark, "product-links", LINKS)
    assert [(r.title, r.price, r.description, r.source_category, r.link, r.image) for r in rows] == [("Zahnpasta Mint", "1,79", "75 ml", "Drogerie", "https://h.at/p/77", "near.png")]
    assert normal["Zahnpasta Mint"].price == 1.79


def test_no_pages(spark):
    df = spark.createDataFrame([], "source_id string, url string, html string, fetched_at timestamp")
    assert all(layouts.records(df, name).count() == 0 for name in layouts.LAYOUTS)
