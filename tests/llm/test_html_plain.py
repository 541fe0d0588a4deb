"""Extraction by markup against a plain DOM version, and the cases that names decide."""

import html.parser
import random
import time

import pytest

from derivata.llm import html as extract

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head script style title noscript template nav footer aside form button select input textarea iframe object svg canvas audio video dialog menu search label fieldset".split())
BLOCK = extract.BLOCKS


class Dom(html.parser.HTMLParser):
    """A tree of (tag, attributes, children); children are texts or trees. Only for pages with sound nesting, but for open
    paragraphs and list items."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.top = ("", {}, [])
        self.stack = [self.top]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in extract.CLOSES_P and "p" in [x[0] for x in self.stack]:
            while self.stack[-1][0] != "p":
                self.stack.pop()
            self.stack.pop()
        if tag == "li" and "li" in [x[0] for x in self.stack[self.scope() :]]:
            while self.stack.pop()[0] != "li":
                pass
        node = (tag, {k: v or "" for k, v in attrs}, [])
        self.stack[-1][2].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def scope(self):
        return max([i for i, x in enumerate(self.stack) if x[0] in ("ul", "ol")], default=0)

    def handle_endtag(self, tag):
        if tag in [x[0] for x in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def named(attributes, tag, inside):
    classes = attributes.get("class", "").lower().split()
    names = ("ad",) if inside and tag not in ("div", "section", "ul") else ("ad", "comments")
    return any(c in names for c in classes) or "hidden" in attributes or "none" in attributes.get("style", "") or (not inside and tag == "header")


def plain_text(page):
    root = Dom(page).top

    def mains(node):
        return [node] if node[0] in ("article", "main") else [m for c in node[2] if not isinstance(c, str) for m in mains(c)]

    found, blocks, now = mains(root), [], []

    def end():
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            blocks.append(text)

    def walk(node, inside):
        for child in node[2]:
            if isinstance(child, str):
                now.append(child)
                continue
            tag, attributes, _ = child
            if tag == "br":
                now.append(" ")
            if tag in DROPPED or named(attributes, tag, inside):
                if tag in BLOCK:
                    end()
                continue
            if tag in BLOCK:
                end()
            walk(child, inside or tag in ("article", "main"))
            if tag in BLOCK:
                end()

    for top in found or [root]:
        walk(top, bool(found))
        end()
    return "\n".join(blocks)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_whole_texts_equal_a_plain_dom(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").select("html").collect()]
    differ = [i for i, p in enumerate(pages) if extract.main_text(p or "", set()) != plain_text(p or "")]
    assert differ == [] and len(pages) >= 25


def test_made_up_pages_equal_a_plain_dom():
    r = random.Random(3)

    def body(depth):
        out = ""
        for _ in range(r.randint(1, 4)):
            tag = r.choice(["div", "section", "p", "ul", "span", "b", "h2", "footer", "header", "text", "text", "br"])
            name = r.choice(["", "", "", ' class="ad"', ' class="comments x"', ' class="story"', " hidden", ' style="display:none"', ' style="overflow: hidden"'])
            if tag == "text":
                out += r.choice(["words &amp; more ", "x\n y ", "&lt;b&gt; "])
            elif tag == "br":
                out += "<br>"
            elif tag == "ul":
                out += f"<ul{name}><li>{body(0)}<li>two</ul>" if depth else ""
            elif tag == "p" or depth == 0:
                out += f"<p{name}>some text</p>"
            else:
                out += f"<{tag}{name}>{body(depth - 1)}</{tag}>" if tag not in ("span", "b") else f"<{tag}{name}>in <{tag}>line</{tag}> text</{tag}>"
        return out

    for _ in range(400):
        page = f"<html><body>{body(2)}<article>{body(3)}</article>{body(1)}</body></html>" if r.random() < 0.6 else f"<body>{body(3)}</body>"
        assert extract.main_text(page, set()) == plain_text(page), page


CLUTTER = [
    '<div class="ad-slot">{}</div>', '<p class="ad">{}</p>', '<span class="ad">{}</span>', '<div class="share-buttons">{}</div>', '<div class="article-comments">{}</div>', '<article class="comment">{}</article>',
    '<div class="newsletter-signup">{}</div>', '<div class="related-posts">{}</div>', '<div class="cookie-notice">{}</div>', '<div class="sidebar-left">{}</div>', '<div style="color:red; display:none">{}</div>',
    '<section id="comments">{}</section>', '<div id="site-footer">{}</div>', '<div role="note" class="promo">{}</div>', '<ul class="breadcrumbs">{}</ul>', '<div class="social-share-links">{}</div>',
]


@pytest.mark.parametrize("clutter", CLUTTER)
def test_clutter_goes_at_all_depths(clutter):
    no = clutter.format("no")
    assert extract.main_text(f"<article><p>a</p>{no}<p>b</p></article>", set()) == "a\nb"
    assert extract.main_text(f"<article><div><section><p>a</p>{no}</section></div><p>b</p></article>", set()) == "a\nb"
    assert extract.main_text(f"<div><p>a</p>{no}<p>b</p></div>", set()) == "a\nb"
    assert extract.main_text(f'<span class="ad">no <span>no</span> no</span>a{no}', set()) == "a"


@pytest.mark.parametrize(
    "page",
    [
        '<article><h2 id="share">x</h2></article>', '<h2 id="share">x</h2>', '<h2 id="social-policy">x</h2>', '<section id="menu-planning"><p>x</p></section>', '<section id="planning-the-menu"><p>x</p></section>', '<body class="has-sidebar comments-open">x</body>',
        '<div class="layout has-sidebar"><p>x</p></div>', '<div class="layout__main--sidebar">x</div>', '<article class="post comments-open">x</article>', '<div class="content-with-ads">x</div>', '<p title="a hidden gem" style="overflow: hidden">x</p>', '<div class="menu-planning">x</div>', '<div class="main">x</div>',
    ],
)
def test_what_only_sounds_like_clutter_stays(page):
    assert extract.main_text(page, set()) == "x"


def test_the_word_main_switches_no_rule_off():
    inner = "<header>no</header><div class='promo'>no</div><div class='sidebar'>no</div><article><p>x</p></article>"
    for name in ("main-container", "container", "main"):
        assert extract.main_text(f'<div class="{name}">{inner}</div>', set()) == "x"
    assert extract.main_text('<div class="main"><div class="top-banner">no</div><p>x</p><div class="site-footer">no</div></div>', set()) == "x"
    assert extract.main_text('<div>no</div><div role="main"><p>x</p></div>', set()) == "x"


def seconds(page):
    began = time.process_time()
    extract.page_nodes(page)
    extract.main_text(page, {1})
    return time.process_time() - began


@pytest.mark.parametrize("page", ["<div>x" * 20_000, "<b " * 60_000, "<div>" + "<i>y</i><p>z" * 20_000, "<div>" * 20_000 + "<li>x" * 5_000, "<ul><li>" + "<div>" * 10_000 + "<p>x</p></b></section>" * 5_000, '<div class="a">' * 20_000 + "deep"])
def test_time_is_in_proportion_to_the_page(page):
    assert seconds(page) < 3
