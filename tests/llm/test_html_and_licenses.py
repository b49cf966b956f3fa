import random
import re
import time

from offerlens.llm import html_text, licenses


def text(s):
    return html_text.render(html_text.parse(s))


def test_layout():
    assert text("<p>One<p>Two<div>x<span hidden>no</span> y<br>z</div>") == "One\n\nTwo\n\nx y\nz"
    assert text("<ol start=3><li>a<li>b<ul><li>c</ul><li>f</ol>") == "3. a\n4. b\n   - c\n5. f"
    assert text("<pre> a\n  b</pre>&amp; <b>bold</b>") == " a\n  b\n\n& bold"
    assert text("<dl><dt>T<dd>D1<dd>D2</dl><blockquote>q</blockquote>") == "T\n  D1\n  D2\n\n  q"
    assert text("<title>t</title><style>p{}</style><script>var t='</p>'</script><body>x<!-- c --><p style='display: none'>y</p>") == "x"


def test_tables_line_up():
    assert text("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td colspan=2>all</table>tail") == "Name       Qty\nApple pie  3\nall\n\ntail"
    assert text("<table>stray<tr><td>1<td>2</table>") == "stray\n\n1  2"
    assert text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"


def plain_grid(rows):
    """Cell by cell, as the layout is defined: every place that a span covers is marked."""
    placed, taken, wide = {}, set(), []
    for r, row in enumerate(rows):
        c = 0
        for lines, across, down in row:
            while (r, c) in taken:
                c += 1
            placed[r, c] = lines
            taken |= {(r + i, c + j) for i in range(min(down, len(rows) - r)) for j in range(across)}
            if across > 1:
                wide.append((r, c, across))
            c += across
    width = [0] * (max((c for _, c in taken), default=-1) + 1)
    for (r, c), lines in placed.items():
        if (r, c) not in {(r, c) for r, c, _ in wide}:
            width[c] = max([width[c], *map(len, lines)])
    for r, c, across in wide:
        width[c + across - 1] += max(0, max(map(len, placed[r, c]), default=0) - sum(width[c : c + across]) - 2 * (across - 1))
    out = []
    for r in range(len(rows)):
        cells = sorted((c, lines) for (q, c), lines in placed.items() if q == r)
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            s = ""
            for c, lines in cells:
                if i < len(lines) and lines[i]:
                    s = s.ljust(sum(w + 2 for w in width[:c] if w)) + lines[i]
            out.append(s.rstrip())
    return out


def test_tables_against_brute_force():
    r = random.Random(1)
    for _ in range(1500):
        rows = [[(["x" * r.randrange(6) for _ in range(r.randrange(3))], r.choice([1, 1, 2, 3]), r.choice([1, 1, 2, 4])) for _ in range(r.randrange(5))] for _ in range(r.randrange(7))]
        assert html_text.grid_lines(rows) == plain_grid(rows), rows


def test_large_tables_and_hostile_spans_take_linear_time():
    began = time.process_time()
    out = text("<table>" + "<tr><td>a<td>bb<td>c" * 20_000 + "</table>")
    assert out == "\n".join(["a  bb  c"] * 20_000)
    text("<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 5000 + "</table>")
    assert time.process_time() - began < 60


def test_broken_and_deep_markup():
    assert [text(x) for x in ("", "<", "a < b", "</p></td>x", "<b", "<!-- open", "&#0;&bogus;")][:4] == ["", "<", "a < b", "x"]
    assert text("<div>" * 3000 + "x") == "x"
    assert text("<table><tr><td>" * 200 + "x") == "x"


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", "<title> a  b</title><p>x", 1), (2, None, None, 2), (3, "v", "", 3), (1, "u", "<title> a  b</title><p>x", 1)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.title, r.text) for r in html_text.extract(df).collect() if r.text is not None)
    assert got == [(1, "a b", "x"), (1, "a b", "x"), (3, None, "")]
    assert html_text.extract(df.filter("false")).count() == 0


def names(s):
    return [(m["license"], len(m["rule"])) for m in licenses.scan(s)]


def test_rules_on_whole_texts():
    by = {k: licenses.SENTENCES[k] for k in licenses.SENTENCES}
    for name, rule in licenses.RULES:
        body = "Copyright (c) 2020 Some One\n\n" + "\n\n".join(by[x] + "." for x in rule)
        assert (name, len(rule)) in names(body), rule
        wrapped = "\n".join("# " + line for line in body.replace(". ", ".\n").split("\n"))
        assert names(wrapped), rule


def test_order_gaps_and_place():
    grant, include, as_is = (licenses.SENTENCES[k] + "." for k in ("mit-grant", "mit-include", "mit-as-is"))
    assert ("MIT", 3) in names(f"{grant}\n\n{include}\n\nOne more. And two.\n\n{as_is}")
    assert not names(f"{as_is}\n\n{include}\n\n{grant}")
    s = "Words before. Released under the MIT License. Words after."
    (m,) = licenses.scan(s)
    assert s[m["start"] : m["stop"]].strip() == "Released under the MIT License."
    assert names("// SPDX-License-Identifier: GPL-2.0-only") == [("GPL-2.0-only", 1)]
    assert not names("This text is about a driving licence and permission slips.")


def test_scan_rows(spark):
    df = spark.createDataFrame([(1, "All rights reserved.\nx", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, matches int")
    got = {r.doc_id: [m.license for m in r.matches] for r in licenses.license_scan(df).collect()}
    assert got == {1: ["LicenseRef-all-rights-reserved"], 2: [], 3: []}
    assert licenses.license_scan(df.filter("false")).count() == 0


def test_holders_and_programs_by_name():
    s = licenses.SENTENCES
    binary = [s[k] + e for k, e in (("bsd-grant", ":"), ("bsd-source", "."), ("bsd-binary", "."))]
    as_is = s["bsd-as-is"].replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "ACME, INC. AND CONTRIBUTORS")
    for endorse in (s["bsd-endorse"].replace("the copyright holder", "Acme, Inc."), s["bsd-endorse"].replace("the copyright holder", "the <organization>"), "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"):
        for end in (s["bsd-as-is"], as_is):
            assert names("\n\n".join([*binary, "3. " + endorse + ".", end + "."])) == [("BSD-3-Clause", 5)], endorse
    assert names("\n\n".join([*binary, as_is + "."])) == [("BSD-2-Clause", 4)]
    advert = "3. " + s["bsd-advert"] + ":\n This product includes software developed by Acme.\n\n4. " + s["bsd-endorse"] + "."
    assert names("\n\n".join([*binary, advert, as_is + "."])) == [("BSD-4-Clause", 6)]
    assert names(s["agpl3-later"].replace("This program", "Acme Server") + ".") == [("AGPL-3.0-or-later", 1)]
    assert names(s["mit-grant"] + ".\n\n" + s["mit-include"] + ".\n\n" + s["mit-as-is"] + ". " + s["mit-liability"].replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME") + ".") == [("MIT", 4)]


def test_titles_of_whole_licenses():
    title = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n"
    assert names(title) == [("GPL-3.0-only", 1)]
    assert names("   Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n") == [("Apache-2.0", 1)]
    assert names("            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n                    Version 2, December 2004\n\n") == [("WTFPL", 1)]
    assert len(licenses.KNOWN) == len(licenses.SENTENCES)


def test_every_known_sentence_passes_the_hints():
    assert all(any(h in s for h in licenses.HINTS) for s in licenses.KNOWN)
    for pattern, wording in licenses.HOLDERS:
        plain = re.sub(r"\\.\{\d+,\d+\}\??", "acme", re.sub(r"\(\?:[^()]*\)\?|\(\?:(?:[^()]|\([^()]*\))*\)", " ", pattern))
        assert any(h in wording or h in plain for h in licenses.HINTS) or not wording, pattern


def test_wrapped_spaced_and_cut_sentences():
    for key, sentence in licenses.SENTENCES.items():
        words = sentence.split(" ")
        for joint in ("\n", "  ", " \n * ", " " * 40):
            assert licenses.identify(joint.join(words)) == key, (key, joint)
        rule = next((r for r in licenses.RULES if r[1] == (key,)), None)
        if rule:
            for joint in ("\n", "  ", " " * 40):
                assert (rule[0], 1) in names("Some words before.\n\n" + joint.join(words) + ".\n\nMore."), (key, joint)
    for s in ("All rights\nreserved.", "All  rights  reserved", "This is free\nand unencumbered software released into the public\ndomain"):
        assert len(names(s)) == 1, s
    grant = licenses.SENTENCES["zlib-grant"].replace("purpose,", "purpose.").replace("applications,", "applications.").replace("alter it", "alter it.").replace("and to", "and. to").replace("redistribute", "redistribute!")
    assert names(grant) == [("Zlib", 1)]


def plain_matches(ids):
    """The definition, place by place: longer rules first, then by place; None is an unknown sentence."""
    used, out = set(), []
    for size in range(9, 0, -1):
        for k, name in enumerate(ids):
            for license_, rule in licenses.RULES:
                if len(rule) != size or k in used or name != rule[0]:
                    continue
                chain = [k]
                for want in rule[1:]:
                    near = [q for q in range(chain[-1] + 1, min(len(ids), chain[-1] + licenses.GAP + 2)) if ids[q] == want and q not in used]
                    if not near:
                        break
                    chain.append(near[0])
                if len(chain) == size:
                    used |= set(chain)
                    out.append((k, license_, size))
                    break
    return sorted(out)


def test_rules_against_brute_force():
    r = random.Random(3)
    few = ["mit-title", "mit-grant", "mit-include", "mit-as-is", "mit-liability", "gpl3-later", "gpl-hope", "gpl-see", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "rights-reserved"]
    for _ in range(300):
        ids, at = [], r.randrange(len(few))
        for _ in range(r.randrange(1, 25)):
            at = at + 1 if r.random() < 0.7 else r.randrange(len(few))
            ids.append(None if r.random() < 0.2 else few[at % len(few)])
        places, body = {}, ""
        for k, name in enumerate(ids):
            places[len(body)] = k
            body += (licenses.SENTENCES[name] if name else "Nothing of note here") + ".\n\n"
        got = sorted((places[m["start"]], m["license"], len(m["rule"])) for m in licenses.scan(body))
        assert got == plain_matches(ids), ids


def test_many_known_sentences_and_repeated_rows(spark):
    began = time.process_time()
    body = (licenses.SENTENCES["mit-grant"] + ".\n\n" + licenses.SENTENCES["rights-reserved"] + ".\n\n") * 3000
    assert len(licenses.scan(body)) == 3000
    assert time.process_time() - began < 30
    df = spark.createDataFrame([(1, "All rights reserved"), (1, "All rights reserved"), (None, "All rights reserved")], "doc_id long, text string")
    assert [len(x.matches) for x in licenses.license_scan(df).collect()] == [1, 1, 1]
