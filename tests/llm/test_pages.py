import hashlib
import json
import math
import random
import re
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from derivata.llm import chat, html, licenses, url_filter
from derivata.shipping import ship

ARTICLE = "<article><h1>T &amp; t</h1><p>One<br>two <b>bold</b>.<p>Three</article>"


def test_markup_alone():
    page = f"""<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="home top"><header>no</header><nav><a href=x>no</a></nav>
    <div class="cookie-notice"><p>no</p></div>{ARTICLE}<aside>no</aside><section id="comments"><p>no</p></section><form><label>no</label></form><footer>no</footer></body></html>"""
    assert html.main_text(page, set()) == "T & t\nOne two bold.\nThree"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("a < b <i>c</i> &lt;x&gt; &#233; &nbsp; d", "a < b c <x> é d"),
        ('<p title="a>b">x</p><p>y', "x\ny"),
        ("<ul><li>1<li>2</ul><table><tr><td>a<td>b</table>", "1\n2\na\nb"),
        ("<!-- c --><p>x<!-- d -->y</p><!-- open", "xy"),
        ("<script>never ends", ""),
        ("<article><header><h1>Kept</h1></header><p>x</p><div class='ad'>no</div></article><p>out</p>", "Kept\nx"),
        ("<div><p>x</div></p></b>y", "x\ny"),
        ("<p hidden>no</p><p>x <span class=ad>no</span> y</p>", "x y"),
        ("<" * 2000 + "p", "<" * 2000 + "p"),
    ],
)
def test_odd_pages(page, text):
    got = html.main_text(page, set())
    assert " ".join(got.split()) == " ".join(text.split()) if "span" in page else got == text


def test_style_tree_removes_templates(spark):
    ship(spark)
    rows = [(i, f"http://h.com/{i}", f'<div class="x"><p>Read all about us</p></div><div class="body"><p>unique {i} text {i * 7} and more words so it is the larger part of it</p></div>', "c") for i in range(12)]
    rows += [(90, "http://other.com/1", rows[0][2], "c"), (91, None, "<p>x</p>", "c"), (92, "no url", None, "c"), (93, "http://h.com/x", "", "c"), (93, "http://h.com/x", "", "c")]
    got = html.extract_html(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].text.startswith("unique") for i in range(12))
    assert by[90].text.startswith("Read all") and by[91].text == "x" and by[92].text == by[93].text == "" and by[90].n_chars == len(by[90].text)
    assert html.extract_html(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def plain_importance(pages):
    """The importance of every path of one host's pages, by recursion from the leaves, in plain Python."""
    seen, g = {}, html.ATTENUATION
    for page in {html.page_nodes(p)[0]: p for p in pages}.values():
        nodes = [n for n in html.parse(page)[1] if n.chars]
        for path in {n.path for n in nodes}:
            same = [n for n in nodes if n.path == path]
            kids = [c.path for n in same for c in n.children if c.chars and c.path != path]
            seen.setdefault(path, []).append((tuple(kids), kids, [t for n in same for t in n.texts]))
    entropy = lambda counts, m: -sum(c / m * math.log(c / m, m) for c in counts) if m > 1 else 1.0

    def value(path):
        rows, m = seen[path], len(seen[path])
        holders = {}
        for _, _, texts in rows:
            for t in set(texts):
                holders[t] = holders.get(t, 0) + 1
        content = 1.0 if m == 1 else 1 - (sum(math.log(c, m) for c in holders.values()) / len(holders) if holders else 0)
        if not any(kids for _, kids, _ in rows):
            return content
        styles = [[r[0] for r in rows].count(x) for x in {r[0] for r in rows}]
        inner = sum((sum(value(k) for k in kids) + len(texts) * content) / (len(kids) + len(texts)) for _, kids, texts in rows) / m
        return (1 - g ** len(styles)) * entropy(styles, m) + g ** len(styles) * inner

    return {html._node_id(path): value(path) for path in seen}


def site(i, k, body):
    """A page without any markup that states roles: a host's templates around a body."""
    extra = "<div class='b7'><p>Most read</p><p>Older news of this site</p></div>" if i % 2 else ""
    return f"""<html><body><div class="x1"><div class="a"><p>Home</p><p>News of site {k}</p></div><div class="b"><p>Weather</p></div></div>
    <div class="x2"><div class="y">{body}</div></div>{extra}<div class="x3"><p>Site {k} is made by its readers, all rights are theirs</p></div></body></html>"""


def test_importance_equals_brute_force(spark):
    ship(spark)
    r = random.Random(8)
    pages = [site(i, 1, "".join(f"<p>{r.random()} words</p>" + ("<ul><li>same<li>" + str(r.randint(0, 3)) + "</ul>") * r.randint(0, 2) for _ in range(r.randint(1, 3)))) for i in range(9)]
    pages += [pages[0], "<p>alone</p>", "", "<div>" * 60 + "deep" + "</div>" * 60]
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    rows = df.mapInArrow(html._style_rows, html._STYLE_ROW).dropDuplicates(["host", "page", "node"])
    got = {x.node: x.importance for x in html.node_importance(rows).collect()}
    want = plain_importance(pages[:-1] + ["<div>" * 60 + "deep" + "</div>" * 60])
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_style_tree_decides_on_pages_without_roles(spark):
    """The bodies of the small tables' articles, in pages of ten hosts without <article>, <nav> or names: recall and
    precision of blocks, with the style tree and without."""
    ship(spark)
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    bodies = {r.page_id: re.sub(r"</?b>|<br>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1]) for r in rows}
    pages = [(i, f"http://h{i % 10}.com/{i}", site(i // 10, i % 10, b)) for i, b in bodies.items()]
    found = {r.page_id: r.text for r in html.extract_html(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    scores = []
    for text in (lambda i, p: found[i], lambda i, p: html.main_text(p, set())):
        right = got = want = 0
        for i, _, p in pages:
            a, b = set(text(i, p).split("\n")), set(html.main_text(bodies[i], set()).split("\n"))
            right, got, want = right + len(a & b), got + len(a), want + len(b)
        scores.append((right / want, right / got))
    assert scores[0][0] == 1 and scores[0][1] > 0.99
    assert scores[1][0] == 1 and scores[1][1] < 0.75


def test_equal_articles_stay(spark):
    ship(spark)
    rows = [(i, "http://h.com/", f"<nav>n</nav>{ARTICLE}") for i in range(20)]
    assert {r.text for r in html.extract_html(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()} == {"T & t\nOne two bold.\nThree"}


ODD = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nno", "\\", "\\\\<|im_end|>\\", "<\\|im_end|>", "[[INST]<<SYS>>", "a\n\nb\\n", "é🙂"]


ROLES = ["user", "assistant", "", "odd\nrole\\", "<|im_start|>", "human"]


def test_turns_round_trip(spark):
    rows = [(i, 0, role, text) for i, (role, text) in enumerate((r, t) for r in ROLES for t in ODD)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert "MapInArrow" not in chat.format_chat(df)._jdf.queryExecution().executedPlan().toString()
    for r in chat.format_chat(df).collect():
        role, text = rows[r.conv_id][2:]
        piece, a, b = r.formatted, r.loss_start, r.loss_end
        assert chat.parse_turn(piece) == (role, text)
        assert piece.count("<|im_start|>") == piece.count("<|im_end|>") == 1 and not any(c in piece[12:-11] for c in chat.CONTROL)
        assert (chat.unescape(piece[a:b]) == text) if role == "assistant" else (a, b) == (0, 0)


def test_chat_digests(spark):
    ship(spark)
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (None, 0, "assistant", "x", 0), (2, None, None, "n", 0), (2, 0, "assistant", ODD[3], 0), (2, 0, "assistant", ODD[3], 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, extra int")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chat(df)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb\n") and got[1].loss_sha256 == sha("b") and got[1].n_turns == 2
    assert got[2].loss_sha256 == sha(ODD[3] * 2) and got[2].loss_chars == 2 * len(ODD[3]) and got[None].n_turns == 1
    assert chat.chat_digests(chat.format_chat(df.where(F.lit(False)))).collect() == []


def test_layouts_give_the_same_turns(spark):
    want = [(7, 0, "user", "q"), (7, 1, "assistant", "a")]
    layouts = [
        ("conv_id bigint, messages array<struct<role: string, content: string>>, junk string", [(7, [("user", "q"), ("assistant", "a")], "j")]),
        ("conv_id bigint, conversations array<struct<from: string, value: string>>", [(7, [("human", "q"), ("gpt", "a")])]),
        ("conv_id bigint, instruction string, input string, output string", [(7, "q", "", "a")]),
        ("conv_id bigint, prompt string, response string", [(7, "q", "a")]),
        ("conv_id bigint, turn int, role string, content string", [(7, 0, "user", "q"), (7, 1, "assistant", "a")]),
    ]
    for schema, rows in layouts:
        assert sorted(tuple(r) for r in chat.canonical_turns(spark.createDataFrame(rows, schema)).collect()) == want
        for more in ("value", "content", "system", "input", "text", "answer"):
            if more not in schema:
                df = spark.createDataFrame(rows, schema).withColumn(more, F.lit(1))
                if more == "text" and "turn" in schema:
                    continue  # of the two, text decides
                if more not in ("system", "input") or "put" not in schema and "prompt" not in schema:  # there, it makes another layout
                    assert sorted(tuple(r) for r in chat.canonical_turns(df).collect()) == want, (schema, more)
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id bigint, words string"))


def test_records_of_mixed_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "junk": 1},
        {"conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}]},
        {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "response": "a", "meta": {"x": [1]}},
        {"completion": "a", "prompt": "q"},
        {"question": "q", "answer": "a"},
    ]
    odd = [None, "no json", "[1]", "{}", '{"words": 1}', '{"messages": []}', '{"prompt": "only"}']
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(100 + i, r) for i, r in enumerate(odd)]
    df = spark.createDataFrame(rows, "conv_id bigint, record string")
    got = sorted(tuple(r) for r in chat.turns_of_records(df, "record").collect())
    assert got == [t for i in range(len(records)) for t in ((i, 0, "user", "q"), (i, 1, "assistant", "a"))]
    assert sum(r.n for r in chat.unknown_layouts(df, "record").collect()) == len(odd)
    assert chat.formatted(chat.turns_of_records(df, "record")).count() == len(got)


def test_license_texts(spark):
    mit, bsd = licenses.KNOWN_TEXTS["MIT"], licenses.KNOWN_TEXTS["BSD-3-Clause"]
    texts = [None, "", "x", f"MIT LICENCE\n\n# Copyright (c) 2020 Foo\n\n{mit.upper().replace('SUBLICENSE', 'sub-licence')}", mit + " more", "© 2001 A. Author. All rights reserved.\n" + bsd.replace(". ", ".\n   "), "Text.\nreleased under the MIT licence\nLicensed under the Apache License, Version 2.0.", mit]
    rows = [(i, t, "old") for i, t in enumerate(texts)] + [(7, mit, "old")]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string, license_id string")).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == [None, None, None, "MIT", None, "BSD-3-Clause", None, "MIT", "MIT"]
    assert [r.notice_ids for r in got] == [[]] * 6 + [["Apache-2.0", "MIT"], [], []]
    assert licenses.license_scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    twice = spark.createDataFrame([("d", "A", "text"), ("d", "B", "text")], "digest string, license_id string, kind string")
    with pytest.raises(ValueError, match="one digest"):
        licenses.license_scan(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), known=twice)


def test_url_lists_in_time(spark):
    entries = spark.createDataFrame(
        [("domain", "bad.com", "add", "2024-01-10"), ("domain", "bad.com", "add", "2024-01-12"), ("domain", "bad.com", "remove", "2024-02-01"), ("domain", "Bad.com", "add", "2024-03-01"), ("prefix", "ok.org/spam", "add", "2024-01-01"), ("domain", None, "add", "2024-01-01"), ("domain", "x.com", "remove", "2024-01-01"), ("domain", "t.com", "add", "2024-01-05"), ("domain", "t.com", "remove", "2024-01-05")],
        "kind string, key string, action string, day string",
    ).withColumn("day", F.to_timestamp("day"))
    cases = [
        ("http://bad.com/", "2024-01-09", None), ("http://bad.com/", "2024-01-10", "bad.com"), ("https://a.b.BAD.com:80/x?y", "2024-01-31", "bad.com"), ("http://bad.com", "2024-02-01", None), ("http://bad.com", "2024-03-05", "bad.com"),
        ("http://notbad.com/", "2024-01-15", None), ("http://ok.org/spam/1#f", "2024-01-15", "ok.org/spam"), ("http://ok.org/spammer", "2024-01-15", None), ("http://ok.org/", "2024-01-15", None), ("http://t.com/", "2024-01-06", None),
        (None, "2024-01-15", None), ("nonsense", "2024-01-15", None), ("http://bad.com/", None, None), ("http://u:p@bad.com./", "2024-01-15", "bad.com"), ("http://bad.com/", "2024-01-10", "bad.com"),
    ]
    df = spark.createDataFrame([(i, u, t, "old") for i, (u, t, _) in enumerate(cases)], "page_id bigint, url string, fetched_at string, blocked string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    got = url_filter.url_filter(df, entries).orderBy("page_id").collect()
    assert [r.list_key for r in got] == [k for _, _, k in cases] and [r.blocked for r in got] == [k is not None for _, _, k in cases]
    assert got[2].listed_since.day == 10
    assert url_filter.url_filter(df.where(F.lit(False)), entries).collect() == []


def plain_canonical(text):
    """The canonical form, word by word in plain Python."""
    lines = [x for x in text.lower().split("\n") if not re.match(r"[^\w\n]*(copyright[ \t:,-]*(\(c\)|©|\d{4}\b|[\[<{](yyyy|year))|(\(c\)|©)[ \t:,-]*(copyright[ \t:,-]*)?(\d{4}\b|[\[<{](yyyy|year)))", x)]
    text = re.sub(r"\ball\s+rights\s+reserved\b\.?", " ", "\n".join(lines))
    text = re.sub(r"(?:\A\s*|(?<=[.;:])[*#/>-]*\s[\s*#/>-]*)\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)](?=\s)", " ", text)
    words = " ".join(re.findall(r"[^\W_]+", text)).replace("sub licen", "sublicen").split(" ")
    return " ".join(licenses.SPELLINGS.get(w, w) for w in words)


def test_license_scan_against_brute_force(spark):
    """All documents of the small tables, with licences planted, against the canonical forms as sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {k: (Path(licenses.__file__).parent / "texts" / f"{k}.txt").read_text() for k in licenses.FULL_TEXTS} | licenses.KNOWN_TEXTS
    planted = [(-1 - i, "Copyright 2001 X\n" + t.replace("\n", "\n> ")) for i, t in enumerate(texts.values())] + [(-50, "licence licence permission"), (-51, "Licence license licences")]
    rows = docs.union(spark.createDataFrame(planted, docs.schema)).collect()
    known, notices = {plain_canonical(t): k for k, t in texts.items()}, {plain_canonical(n): k for k, all_ in licenses.KNOWN_NOTICES.items() for n in all_}
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, docs.schema)).collect()}
    found = 0
    for doc_id, text in rows:
        assert got[doc_id].license_id == known.get(plain_canonical(text or "")), doc_id
        assert got[doc_id].notice_ids == sorted({notices[c] for line in (text or "").split("\n") if (c := plain_canonical(line)) in notices}), doc_id
        found += got[doc_id].license_id is not None
    assert found == len(texts) and got[-50].text_digest == hashlib.sha256(b"license license permission").hexdigest()


def test_license_scan_without_broadcast(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate([None, licenses.KNOWN_TEXTS["MIT"], licenses.KNOWN_TEXTS["MIT"], "x"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    small = [r.license_id for r in licenses.license_scan(df).orderBy("doc_id").collect()]
    monkeypatch.setattr(licenses, "MOST_BROADCAST", 0)
    plan = licenses.license_scan(df)
    assert [r.license_id for r in plan.orderBy("doc_id").collect()] == small == [None, "MIT", "MIT", None]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article style="overflow: hidden"><p>x</p></article>', "x"),
        ('<p title="a hidden gem">x</p><p data-a=\'b hidden c\' hidden-x>y</p>', "x\ny"),
        ('<p title="class=ad id=menu">x</p>', "x"),
        ('<p class="a"hidden>no</p><p HIDDEN>no</p><p hidden="until-found">no</p><div title=a/b class=ad>no</div><p>x</p>', "x"),
    ],
)
def test_values_are_no_names(page, text):
    assert html.main_text(page, set()) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<html class="cookie"><body class="has-sidebar comments-open"><p>x</p></body></html>', "x"),
        ('<body><article class="post comments-open"><p>x</p></article><p>no</p></body>', "x"),
        ('<div class="share-price"><p class="lead social-policy">x</p></div><div class="ad-slot site-footer">no</div><div class="comment-list">no</div>', "x"),
        ('<main id="social"><h2 id="social-policy">x</h2><section id="menu-planning"><p>y</p></section></main>', "x\ny"),
        ('<article><h2 id="menu">x</h2><p class="notice">y <span class="alert">z</span></p><div class="box ad">no</div></article>', "x\ny z"),
        ('<div class="cookie-notice"><p>no</p></div><div id="comments"><article class="post"><p>no</p></article></div><p>x</p>', "x"),
    ],
)
def test_names_rule_out_clutter_only(page, text):
    assert html.main_text(page, set()) == text


def test_copies_make_no_template(spark):
    ship(spark)
    page = lambda i: f'<div class="head"><h1>Headline {i}</h1></div><div class="body"><p>text {i} with many more words, so that it is the larger part of the page</p></div>'
    rows = [(i, "http://a.com/", page(0)) for i in range(9)] + [(9, "http://a.com/", page(1))] + [(10 + i, "http://b.com/", page(2)) for i in range(6)]
    got = html.extract_html(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 16 and all(r.text.startswith("Headline ") and "larger part" in r.text for r in got)


def test_license_texts_wrapped_at_any_width(spark):
    statements = ["Copyright (c) 2020 Foo", "  * Copyright 2001-2003, A. Author", "(C) Copyright 1999 B", "(c) 2001 B", "© 2001 B", "Copyright © Foo", "Copyright [yyyy] [name of copyright owner]"]
    cases = [(k, f"{statements[(i + width) % len(statements)]}\n\n" + "\n".join(textwrap.fill(p, width) for p in t.split("\n"))) for i, (k, t) in enumerate(licenses.KNOWN_TEXTS.items()) for width in (20, 30, 40, 50, 60, 65, 70, 72, 75, 78, 79, 80, 100)]
    got = licenses.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == [k for k, _ in cases]


def test_license_texts_full_bulleted_and_own(spark):
    full = {k: (Path(licenses.__file__).parent / "texts" / f"{k}.txt").read_text() for k in licenses.FULL_TEXTS}
    bsd = licenses.KNOWN_TEXTS["BSD-3-Clause"]
    wrapped = lambda t: "\n\n".join(p if "Copyright (C) " in p else textwrap.fill(p, 61, break_on_hyphens=False, break_long_words=False) for p in re.split(r"\n\s*\n", t))
    cases = [(k, t) for k, t in full.items()] + [(k, t.upper()) for k, t in full.items()] + [(k, wrapped(t.partition(licenses.TERMS_END)[0])) for k, t in full.items() if licenses.TERMS_END in t] + [("BSD-3-Clause", re.sub(r"(?m)^\d\.", mark, bsd)) for mark in ("*", " -", "(a)", "* 7)")]
    cases += [("MIT", licenses.KNOWN_TEXTS["MIT"].replace("sublicense", "sub-licence")), (None, bsd + " 2. x")]
    got = licenses.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == [k for k, _ in cases]
    own = spark.createDataFrame([("L", "text", "Erlaubnis für alle."), ("N", "notice", "Frei für alle.")], "license_id string, kind string, text string")
    own = own.select(licenses.digest(F.col("text")).alias("digest"), "license_id", "kind")
    got = licenses.license_scan(spark.createDataFrame([(0, "ERLAUBNIS für alle"), (1, "x\nfrei für alle\n"), (2, ""), (3, None)], "doc_id bigint, text string"), known=own).orderBy("doc_id").collect()
    assert [(r.license_id, r.notice_ids) for r in got] == [("L", []), (None, ["N"]), (None, []), (None, [])]
