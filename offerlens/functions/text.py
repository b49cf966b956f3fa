"""Text columns: whitespace, folding, match titles, slugs, tokens, signatures, keys."""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F



def _decomposed() -> tuple[str, str, str]:
    """By the compatibility decomposition without marks: lower-case characters that leave one other character, these, and
    those of them that bore marks."""
    one, plain, marked = [], [], []
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x20000)]):
        full = unicodedata.normalize("NFKD", c)
        bare = "".join(x for x in full if not "\u0300" <= x <= "\u036f")
        if c.lower() != c or bare == c or not re.search("[a-z0-9]", bare):
            continue
        if len(bare) == 1:
            one.append(c)
            plain.append(bare)
            if len(full) > 1:
                marked.append(c)
    return "".join(one), "".join(plain), "".join(marked)


def _one_of(chars: str) -> str:
    """A pattern's class of the characters. Java asks a class's members one by one, so that each 128 code points and the
    whole are behind the range in which they lie: most characters are out after one comparison."""
    code = lambda c: f"\\x{{{ord(c):x}}}"
    within = lambda cs, inner: f"[{code(min(cs))}-{code(max(cs))}&&[{inner}]]"
    blocks = [list(cs) for _, cs in groupby(sorted(chars), lambda c: ord(c) // 128)]
    return within(chars, "".join(within(cs, "".join(map(code, cs))) for cs in blocks))


ACCENTED, PLAIN, MARKED = _decomposed()
IS_MARKED = _one_of(MARKED)
MARKS = "".join(map(chr, range(0x300, 0x370)))
# Words that say nothing about a product.
SIGNATURE_STOPWORDS = (
    "adeg", "bipa", "billa", "hofer", "lidl", "dm", "pagro", "penny", "spar", "plus", "diskont", "aktion", "sorten", "versch", "oder",
    "und", "packung", "flasche", "dose", "glas", "beutel", "becher", "stuk", "stueck", "liter", "gramm", "kg", "ml", "cl",
)
AGGREGATOR_STOPWORDS = ("adeg", "aktiv", "bipa", "billa", "dm", "drogerie", "hofer", "lidl", "markt", "pagro", "penny", "spar", "diskont")
BROAD_LABELS = "^(lebensmittel|getraenke|drogerie hygiene|haushalt|tierbedarf|garten pflanzen|kleidung mode|technik elektronik|freizeit sonstiges|baby kinder)$"


def squeezed(c: Column) -> Column:
    """Null is empty; runs of white space, Unicode's included, are one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def folded(c: Column) -> Column:
    """Lower case in compatibility form without marks: ä is a, é is e, full-width letters are plain ones; ß stays.
    Ligatures, squared units and other signs that stand for several characters stay, too."""
    return F.translate(F.lower(c), ACCENTED + MARKS, PLAIN)


def match_title(c: Column) -> Column:
    """Folded letters and digits, words apart by one blank."""
    return F.trim(F.regexp_replace(folded(squeezed(c)), "[^a-z0-9]+", " "))


def ascii_lower(c: Column) -> Column:
    """Lower case with ae, oe, ue and ss; other marks stay."""
    out = F.lower(F.coalesce(c, F.lit("")))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def search_words(c: Column) -> Column:
    """Words of a search text, after ae/oe/ue/ss; other marks part words: Crème is cre me."""
    apart = F.regexp_replace(ascii_lower(c), f"({IS_MARKED})", "$1 ")
    return F.trim(F.regexp_replace(F.translate(apart, ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " +"), lambda t: t != "")


def slug(c: Column, fallback: str = "") -> Column:
    s = F.regexp_replace(match_title(c), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def raw_key(c: Column) -> Column:
    """Unfolded and untrimmed key of a label."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")


def has_phrase(words: Column, phrase: Column) -> Column:
    """Whether the words hold the phrase as whole words; an empty phrase is nowhere."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (phrase != "") & F.contains(pad(words), pad(phrase))


def _signature(words: Column, stop: tuple[str, ...], longer_than: int) -> Column:
    kept = F.filter(tokens(words), lambda t: (F.length(t) > longer_than) & ~t.isin(*stop) if stop else F.length(t) > longer_than)
    return F.array_join(F.slice(kept, 1, 8), "-")


def signature(title: Column, brand: Column) -> Column:
    """First eight telling words of brand and title, numbers left out."""
    words = ascii_lower(F.concat_ws(" ", F.coalesce(brand, F.lit("")), F.coalesce(title, F.lit(""))))
    words = F.regexp_replace(F.regexp_replace(words, r"\b\d+[.,]?\d*\b", " "), "[^a-z0-9 ]+", " ")
    return _signature(words, SIGNATURE_STOPWORDS, 2)


def aggregator_signature(title: Column, brand: Column) -> Column:
    return _signature(match_title(F.concat_ws(" ", brand, title)), AGGREGATOR_STOPWORDS, 2)


def plain_signature(title: Column) -> Column:
    return _signature(match_title(title), (), 0)


def is_broad(c: Column) -> Column:
    return match_title(c).rlike(BROAD_LABELS)


def number_text(c: Column) -> Column:
    """A number as scripts print it: 5, not 5.0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def joined_key(*parts: Column, empty: str = "na") -> Column:
    """Parts joined by ::, with empty ones and nulls named, so that no part shifts."""
    return F.concat_ws("::", *[F.coalesce(F.nullif(p.cast("string"), F.lit("")), F.lit(empty)) for p in parts])


def shortened(c: Column, n: int) -> Column:
    return F.left(F.trim(F.coalesce(c, F.lit(""))), F.lit(n))


def humanized(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(" "))


def digest(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def entities_decoded(c: Column) -> Column:
    """The five entities that offers use; &amp; last."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def distinct_strings(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def display_category(secondary: Column, primary: Column) -> Column:
    """The secondary label unless it is empty or broad, then the primary likewise, then what there is."""
    given = lambda c: F.nullif(squeezed(c), F.lit(""))
    return F.when(given(secondary).isNotNull() & ~is_broad(secondary), squeezed(secondary)).when(given(primary).isNotNull() & ~is_broad(primary), squeezed(primary)).otherwise(F.coalesce(given(secondary), given(primary), F.lit("")))


def currency(amount: Column, unit: str = "€") -> Column:
    return F.format_string(f"{unit} %.2f", amount)
