"""Classification of offers into main and subcategories by ordered, weighted patterns.

The patterns are lists of words, so they are kept as a table of rules by word. A text is matched against all words
of all rules in one pass: `Words` folds them into a prefix tree written as one regular expression, which gives at
each place the longest word that begins there, and a map from that word to the rules it satisfies.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import numbers, text

# Fixed values: (main category, its pattern, ((subcategory, pattern), ...)), in order of precedence on equal scores.
TAXONOMY = (
    ("Lebensmittel", "(lebensmittel|essen|nahrung|bio|genuss)", (
        ("Obst & Gemuese", "(obst|gemuse|gemuese|salat|kartoffel|zwiebel|tomate|apfel|banane|zitrone|beere)"),
        ("Brot & Gebaeck", "(brot|gebaeck|geback|backwaren|semmel|weckerl|croissant|toast)"),
        ("Fleisch, Wurst & Fisch", "(fleisch|wurst|schinken|salami|speck|fisch|lachs|thunfisch|geflugel|gefluegel|huhn|rind|schwein)"),
        ("Milchprodukte", "(milch|butter|joghurt|topfen|sahne|rahm|quark)"),
        ("Kaese", "(kase|kaese|mozzarella|emmentaler|gouda|camembert|parmesan|bergkaese|frischkaese|schnittkaese)"),
        ("Tiefkuehl- & Fertigprodukte", "(tiefkuhl|tiefkuehl|pizza|fertig|mikrowelle|tk|frost|lasagne|pommes)"),
        ("Suesswaren & Knabbereien", "(schokolade|susswaren|suesswaren|knabberei|chips|kekse|bonbon|praline|snack|nusse|nuesse)"),
        ("Pasta, Reis & Konserven", "(nudel|pasta|reis|konserve|dose|dosen|bohnen|linsen|kichererbse|passata)"),
        ("Saucen, Oele & Gewuerze", "(sauce|oel|ol|gewurz|gewuerz|essig|ketchup|mayonnaise|senf)"),
        ("Fruehstueck & Aufstriche", "(marmelade|honig|musli|muesli|cornflakes|aufstrich|nougatcreme|brotaufstrich)"))),
    ("Getraenke", "(getrank|getraenk|trinken|durst)", (
        ("Wasser", "(wasser|mineralwasser|sprudel)"),
        ("Softdrinks & Energy", "(cola|limonade|softdrink|energy|energydrink|eistee|iso|getrank|getraenk)"),
        ("Saefte & Sirupe", "(saft|nektar|sirup|smoothie)"),
        ("Bier", "(bier|pils|weizen|radler)"),
        ("Wein & Sekt", "(wein|rotwein|weisswein|rose|sekt|prosecco|champagner)"),
        ("Spirituosen", "(whisky|rum|gin|vodka|likor|likoer|spirituose|schnaps)"),
        ("Kaffee & Tee", "(kaffee|espresso|cappuccino|tee|matcha|bohne|kaffeekapsel|kapseln)"),
        ("Milchgetraenke", "(kakao|milchdrink|milchgetrank|joghurtdrink|proteindrink)"))),
    ("Drogerie / Hygiene", "(drogerie|hygiene|pflege|kosmetik|beauty)", (
        ("Haarpflege", "(shampoo|spulung|spuelung|haar|haarkur|styling)"),
        ("Koerperpflege", "(dusch|deo|deodorant|bodylotion|seife|creme|pflege|lotion|balsam)"),
        ("Mund- & Zahnpflege", "(zahnpasta|zahnburste|zahnbuerste|mundspulung|mundspuelung|zahn)"),
        ("Rasur", "(rasierer|rasur|klinge|aftershave)"),
        ("Kosmetik & Make-up", "(kosmetik|make up|makeup|mascara|lippenstift|foundation|parfum)"),
        ("Damenhygiene", "(binden|tampon|slipeinlage|einlagen|damenhygiene)"),
        ("Babyhygiene", "(windel|feuchttucher|feuchttuecher|babycreme|babyshampoo)"),
        ("Haushaltspapier", "(toilettenpapier|kuchenrolle|kuechenrolle|taschentucher|taschentuecher|haushaltspapier)"),
        ("Gesundheit & Nahrungsergaenzung", "(vitamin|magnesium|omega|zink|nahrungserganzung|nahrungsergaenzung|kapsel|kapseln|tablette|tabletten|pastille|pastillen|supplement)"))),
    ("Haushalt", "(haushalt|wohnen|reinigen|putzen)", (
        ("Waschmittel & Reiniger", "(waschmittel|weichspuler|weichspueler|reiniger|putzmittel|spulmittel|spuelmittel|entkalker|geschirrspul|spueltabs|spultabs|spuelmaschinentabs|spulmaschinentabs|waschcaps|tabs|vollwaschmittel|colorwaschmittel)"),
        ("Kuechenhelfer", "(geschirr|pfanne|topf|besteck|messer|kochen|kueche|kuche)"),
        ("Aufbewahrung & Folien", "(folie|frischhalte|alu|beutel|aufbewahrung|dose|box)"),
        ("Deko & Wohnen", "(deko|kerze|vase|kissen|wohnen)"),
        ("Papier & Buero", "(papier|buero|buro|ordner|heft|stift|druckerpapier)"),
        ("Papierwaren", "(toilettenpapier|kuechenrolle|kuchenrolle|serviette|taschentuecher|taschentucher)"))),
    ("Buero / Schule", "(buero|buro|schule|schreibwaren|ordnen|etikett|drucker|scanner|papierwaren|kreativ|basteln)", (
        ("Schreibwaren", "(schreibwaren|stift|kugelschreiber|filzstift|marker|textmarker|bleistift|fineliner|heft|collegeblock|notizbuch|radierer|spitzer)"),
        ("Papier & Ordnen", "(papier|briefkorb|stehsammler|ordner|register|mappe|formular|geschaftsbuch|geschaeftsbuch|etikett|fotopapier|kuvert)"),
        ("Drucker & Scanner", "(drucker|scanner|toner|tinte|patrone|speichermedien|speicherkarte|festplatte|usb|pc zubehor|pc zubehoer|computerzubehor|computerzubehoer)"),
        ("Schule & Lernen", "(schule|schultasche|rucksack|federschachtel|lineal|zirkel|geodreieck|lernen)"),
        ("Basteln & Kreativ", "(basteln|kreativ|farben|pinsel|kleber|schere|buntpapier|malblock|knete|glitzer|sticker|party)"))),
    ("Tierbedarf", "(tier|haustier|hund|katze|tierbedarf)", (
        ("Hundefutter", "(hund|hundefutter|hundesnack)"),
        ("Katzenfutter", "(katze|katzenfutter|katzensnack)"),
        ("Katzenstreu & Pflege", "(katzenstreu|katzenpflege)"),
        ("Tierzubehoer", "(napf|leine|spielzeug|tierzubehor|tierzubehoer)"))),
    ("Garten / Pflanzen", "(garten|pflanze|blume)", (
        ("Pflanzen & Blumen", "(pflanze|blume|orchidee|rose|topfpflanze)"),
        ("Erde & Duenger", "(erde|kompost|dunger|duenger|hochbeeterde|blumenerde)"),
        ("Gartenzubehoer", "(gartenzubehor|gartenzubehoer|schlauch|topf|saatsamen|samen|hochbeet|beet|gartenhaus)"))),
    ("Kleidung / Mode", "(bekleidung|mode|kleidung)", (
        ("Damenbekleidung", "(damen|leggings|kleid|bluse|bh)"),
        ("Herrenbekleidung", "(herren|hemd|boxershorts|unterhemd)"),
        ("Kinderbekleidung", "(kinder|babykleidung|strampler)"),
        ("Schuhe & Accessoires", "(schuh|socke|guertel|gurtel|mütze|muetze|tasche)"))),
    ("Technik / Elektronik", "(technik|elektronik|geraet|gerat)", (
        ("Kuechengeraete", "(mikrowelle|toaster|wasserkocher|kaffeemaschine|fritteuse|grill|kontaktgrill|standgrill|heissluftfritteuse|heisluftfritteuse)"),
        ("Unterhaltungselektronik", "(tv|fernseher|lautsprecher|kopfhorer|kopfhoerer)"),
        ("Computer & Mobile", "(notebook|laptop|tablet|smartphone|monitor|drucker|scanner|speichermedien|festplatte|usb|computerzubehor|computerzubehoer|pc zubehor|pc zubehoer)"),
        ("Werkzeug & Akkus", "(werkzeug|bohrer|akkuschrauber|akku|maschine)"))),
    ("Freizeit / Sonstiges", "(freizeit|hobby|camping|schule|spiel)", (
        ("Spielzeug", "(spielzeug|lego|puppe|pluesch|plueschtier|hot wheels|barbie|spiel)"),
        ("Games & Konsolen", "(games|spielkonsole|nintendo switch|playstation|xbox|videospiel)"),
        ("Schreibwaren & Schule", "(schule|schreibwaren|heft|stift|malblock)"),
        ("Sport & Camping", "(sport|camping|fahrrad|helm|outdoor|grill|freizeit)"),
        ("Autozubehoer", "(autozubehor|autozubehoer|motoroel|reifen)"))),
    ("Baby / Kinder", "(baby|kinder|kind)", (
        ("Babybedarf", "(baby|schnuller|strampler|babyflasche)"),
        ("Kinderpflege", "(kinderpflege|babyshampoo|babycreme|windel)"))),
)

# Fixed values: (pattern, main category, subcategory) that go before any score, first match.
OVERRIDES = (
    (r"\b(gefrierschrank|kuehlschrank|kühlschrank|kuhlschrank|kuehltruhe|kühltruhe|no frost)\b", "Technik / Elektronik", "Kuechengeraete"),
    (r"\b(hochbeet|hochbeeterde|blumenerde|pflanzerde|komposterde|erde|duenger|dunger)\b", "Garten / Pflanzen", "Erde & Duenger"),
    (r"\b(gartenhaus|rasenmaeher|rasenmäher|heckenschere|schlauchwagen|bewaesserung|bewässerung|pavillon)\b", "Garten / Pflanzen", "Gartenzubehoer"),
    (r"\b(akku schrauber|akkuschrauber|bohrer|bit set|bit-set|werkzeugkoffer|schraubendreher|stichsaege|stichsäge)\b", "Technik / Elektronik", "Werkzeug & Akkus"),
    (r"\b(tv|smart tv|fernseher|oled|q led|qled|monitor|lautsprecher|soundbar)\b", "Technik / Elektronik", "Unterhaltungselektronik"),
    (r"\b(vitamin|magnesium|omega|zink|nahrungserganzung|nahrungsergaenzung|kapsel|kapseln|tablette|tabletten|pastille|pastillen)\b", "Drogerie / Hygiene", "Gesundheit & Nahrungsergaenzung"),
    (r"\b(spueltabs|spultabs|spuelmaschinentabs|spulmaschinentabs|geschirrspueltabs|geschirrspultabs|waschcaps|reiniger tabs)\b", "Haushalt", "Waschmittel & Reiniger"),
    (r"\b(formular|geschaftsbuch|geschaeftsbuch|briefkorb|stehsammler|etiketten|fotopapier|ordner|register|kuvert)\b", "Buero / Schule", "Papier & Ordnen"),
    (r"\b(schreibwaren|kugelschreiber|filzstift|textmarker|bleistift|notizbuch|collegeblock|heft|fineliner)\b", "Buero / Schule", "Schreibwaren"),
    (r"\b(drucker|scanner|toner|tinte|patrone|speichermedien|speicherkarte|festplatte|usb stick|usb-stick|computerzubehor|computerzubehoer|pc-zubehor|pc-zubehoer)\b", "Buero / Schule", "Drucker & Scanner"),
    (r"\b(hot wheels|pluesch|plueschtier)\b", "Freizeit / Sonstiges", "Spielzeug"),
    (r"\b(nintendo switch|videospiel|konsole|games)\b", "Freizeit / Sonstiges", "Games & Konsolen"),
    (r"\b(kontaktgrill|standgrill|heissluftfritteuse|heisluftfritteuse)\b", "Technik / Elektronik", "Kuechengeraete"),
)

SUB_RULES = tuple((main, sub, pattern) for main, _, subs in TAXONOMY for sub, pattern in subs)


class Rule(NamedTuple):
    """One word of one rule; of equally good rules the lowest number counts. Kind is override, sub or main."""

    kind: str
    number: int
    main: str
    sub: str
    word: str


def words_of(pattern: str) -> list[str]:
    """The words of a pattern that is a list of them."""
    return re.sub(r"^(\\b)?\(|\)(\\b)?$", "", pattern).split("|")


def rules() -> list[Rule]:
    """All rules by word: overrides, then subcategories, then main categories, each numbered in order of precedence."""
    kinds = (("override", [(m, s, p) for p, m, s in OVERRIDES]), ("sub", SUB_RULES), ("main", [(m, m, p) for m, p, _ in TAXONOMY]))
    return [Rule(kind, i, m, s, w) for kind, known in kinds for i, (m, s, p) in enumerate(known) for w in words_of(p)]


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), "kind string, number int, main string, sub string, word string")


def _tree(words: Iterable[str]) -> str:
    """A pattern for the longest of these words, shared beginnings written once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    ways = [re.escape(c) + _tree(rest) for c, rest in heads.items() if c]
    if not ways:
        return ""
    joined = ways[0] if len(ways) == 1 and not ends else f"(?:{'|'.join(ways)})"
    return joined + "?" if ends else joined


class Words:
    """Finds which numbers' words a text holds. whole: only where no letter or digit is next to the word."""

    def __init__(self, numbered: Iterable[tuple[int, str]], whole: bool = False):
        by_word: dict[str, set[int]] = {}
        for n, word in numbered:
            by_word.setdefault(word, set()).add(n)
        edge = r"\b" if whole else ""
        self.pattern = f"(?={edge}({_tree(by_word)}){edge})"
        letter = str.isalnum
        # A shorter word that begins like a found one is in the text too; as a whole word, if it ends at an edge in it.
        self.found = {w: sorted(set().union(*(by_word[v] for k in range(1, len(w) + 1) if (v := w[:k]) in by_word and (not whole or k == len(w) or letter(w[k - 1]) != letter(w[k]))))) for w in by_word}

    def numbers(self, c: Column) -> Column:
        """The distinct numbers, in no order; none for a text without."""
        table = F.map_from_arrays(F.array(*map(F.lit, self.found)), F.array(*(F.array(*map(F.lit, ns)) for ns in self.found.values())))
        return F.array_distinct(F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(self.pattern), F.lit(1))), lambda w: table[w])))


class Classifier:
    """Classification by a list of rules, as expressions whose size doesn't grow with the number of texts or calls."""

    def __init__(self, known: list[Rule]):
        of = {kind: {r.number: r for r in known if r.kind == kind} for kind in ("override", "sub", "main")}
        self.overrides, self.subs, self.mains = (list(of[k].values()) for k in ("override", "sub", "main"))
        place = {kind: {n: i for i, n in enumerate(of[kind])} for kind in of}
        shift = len(self.subs)
        self.any = Words([(place[r.kind][r.number] + (shift if r.kind == "main" else 0), r.word) for r in known if r.kind != "override"])
        self.first = Words([(place["override"][r.number], r.word) for r in known if r.kind == "override"], whole=True)

    def scored(self, texts: list[Column]) -> Column:
        """array<struct(score, order)> of the rules hit, subs before mains. 4 for a hit in the title, 2 for one in each
        other text, 4 where that equals the title or is the first of them beside an empty title. Texts are match titles."""

        def rate(e: Column) -> Column:
            title = e["t0"]
            points = [F.lit(4), *(F.when((e[f"t{i}"] == title) | ((title == "") if i == 1 else F.lit(False)), 4).otherwise(2) for i in range(1, len(texts)))]
            hit = [e[f"r{i}"] for i in range(len(texts))]
            total = lambda r: sum((F.when(F.array_contains(h, r), p).otherwise(0) for h, p in zip(hit[1:], points[1:])), F.when(F.array_contains(hit[0], r), points[0]).otherwise(0))
            return F.transform(F.array_distinct(F.flatten(F.array(*hit))), lambda r: F.struct(total(r).alias("score"), (-r).alias("order")))

        parts = [*(t.alias(f"t{i}") for i, t in enumerate(texts)), *(self.any.numbers(t).alias(f"r{i}") for i, t in enumerate(texts))]
        return numbers.once(F.struct(*parts), rate)

    def best(self, scored: Column, keep: Callable[[Column], Column]) -> Column:
        """The best struct(score, order) of the rules that keep names; null where none was hit."""
        return F.array_max(F.filter(scored, lambda x: keep(-x["order"])))


def _at(values: list, i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i)


DEFAULT = Classifier(rules())


def _texts(title: Column, context: Column | None, source: Column | None) -> list[Column]:
    return [text.match_title(title), *(text.match_title(c) for c in (context, source) if c is not None)]


def _label(source: Column | None) -> Column:
    return F.nullif(text.squeezed(source), F.lit("")) if source is not None else F.lit(None).cast("string")


def _choose(e: Column, by: Classifier) -> Column:
    """e has scored, override (a number or null) and label."""
    n = len(by.subs)
    sub, main = by.best(e["scored"], lambda r: r < n), by.best(e["scored"], lambda r: r >= n)
    out = lambda m, s, c: F.struct(m.alias("primary"), s.alias("secondary"), c.cast("double").alias("confidence"))
    names = lambda known, i: (_at([r.main for r in known], i), _at([r.sub for r in known], i))
    broad = _at([r.main for r in by.mains], -main["order"] - n)
    return (
        F.when(e["override"].isNotNull(), out(*names(by.overrides, e["override"]), F.lit(0.98))).when(sub["score"] >= 2, out(*names(by.subs, -sub["order"]), F.lit(0.88)))
        .when(main["score"] >= 2, out(broad, F.coalesce(e["label"], broad), F.least(F.lit(1.0), 0.52 + main["score"] * 0.06))).otherwise(out(F.lit("Lebensmittel"), F.coalesce(e["label"], F.lit("Lebensmittel")), F.lit(0.35)))
    )


def _facts(texts: list[Column], source: Column | None, by: Classifier) -> Column:
    hay = F.trim(F.concat_ws(" ", *texts))
    return F.struct(by.scored(texts).alias("scored"), F.array_min(by.first.numbers(hay)).alias("override"), _label(source).alias("label"))


def classified(title: Column, context: Column | None = None, source: Column | None = None, by: Classifier = DEFAULT) -> Column:
    """struct(primary, secondary, confidence): override, best subcategory, best main category, or the default."""
    return numbers.once(_facts(_texts(title, context, source), source, by), lambda e: _choose(e, by))


def decision(title: Column, context: Column | None = None, source: Column | None = None, by: Classifier = DEFAULT) -> Column:
    """classified() with the subcategory found again inside the chosen main category, confidences and review reasons."""

    def decide(e: Column) -> Column:
        return F.struct(e["scored"].alias("scored"), _choose(e, by).alias("c"))

    def inside(e: Column) -> Column:
        # a subcategory that is called like its main category says nothing more
        telling = [r.main if _key(r.sub) != _key(r.main) else None for r in by.subs]
        every = [r.main for r in by.subs]
        c, n = e["c"], len(by.subs)
        best = by.best(e["scored"], lambda r: (r < n) & (_at(every, r) == c["primary"]))
        known = F.when((best["score"] >= 2) & (_at(telling, -best["order"]) == c["primary"]), _at([r.sub for r in by.subs], -best["order"]))
        return F.struct(c["primary"].alias("primary"), F.coalesce(known, F.lit("")).alias("secondary"), c["confidence"].alias("confidence"))

    def review(c: Column) -> Column:
        none = c["secondary"] == ""
        confidence = F.when(none, F.least(F.lit(0.35), c["confidence"])).otherwise(F.greatest(F.lit(0.45), F.least(F.lit(0.95), c["confidence"] - 0.04)))
        reasons = F.array_compact(F.array(F.when(c["confidence"] < 0.5, "category-low-confidence"), F.when(none, "subcategory-low-confidence")))
        return F.struct(c["primary"].alias("primary"), c["secondary"].alias("secondary"), c["confidence"].alias("category_confidence"), confidence.alias("subcategory_confidence"), ((c["confidence"] < 0.5) | none).alias("needs_review"), reasons.alias("reasons"))

    # each step is a lambda over its input, so that its many references don't copy the expression into the plan
    facts = F.array(_facts(_texts(title, context, source), source, by))
    return F.transform(F.transform(F.transform(facts, decide), inside), review)[0]


def _key(label: str) -> str:
    """text.match_title of the taxonomy's own labels, which are plain letters and marks."""
    return re.sub("[^a-z0-9]+", " ", label.lower()).strip()
