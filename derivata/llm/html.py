"""Main text of web pages, with a site style tree.

Pages of one host share templates. Their DOMs are merged into one style tree: a node for each path of block elements
(tags with class and id), with the presentations it has on the m pages that have it (sequences of child elements) and
the blocks of text it holds itself. With p a presentation's share of the pages, and c the pages that have a block:

    presentation importance  = - sum of p log p / log m                     (1 on one page)
    content importance       = 1 - mean over its blocks of log c / log m    (1 on one page)
    importance of a leaf     = its content importance
    importance of a branch   = (1 - g^l) presentation importance + g^l mean importance of its children,

where l is its number of presentations, g = ``ATTENUATION``, and its own text counts as children as well. A branch is
noise if it and all beneath are below ``LEAST_IMPORTANCE``, on at least ``LEAST_PAGES`` pages with at most ``MOST_SHARE``
of their text; it is removed from each page. Pages of one host with the same main blocks are one page here, so that
copies make no template of what only they share.

What markup states outright needs no statistics: scripts, styles, forms, navigation, footers, asides, hidden elements and
those named for adverts, notices, comments and the like are no article; nor is what lies outside of <article>, <main> or
role=main, if a page has one. Names count alike at all depths. A class names an element if its last word does, but for
words that only say what holds it (ad-slot, related-posts); words such as in has-sidebar speak of others. An id, which is
often a heading's slug, names containers only, and if all of its words are such names. The page and its body are never
named, its article only by a class of one such name, and an article's paragraphs and inline elements only by names for
adverts. Of the tree's branches in an article only containers with a class
or id go.

The importance of a branch is linear in those beneath, so it is a sum over all nodes beneath of what each adds, times
the weights on the way up: two aggregations by node, however deep the pages are. Counts are aggregated by (host, page,
node) and (host, node, value) before any host's rows meet, so a host with a third of all pages is no hot group. Elements
more than ``DEPTH`` deep count as part of the one above.

A page without html is empty; one without a url has no host, so markup alone decides. Markup errors follow the usual
rules: open paragraphs end where a block begins, unknown end tags are dropped.
"""

from __future__ import annotations

import collections
import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, drop
from .words import released

#: A branch goes if its importance is below this, on at least so many pages, with at most this share of their text.
LEAST_IMPORTANCE, LEAST_PAGES, MOST_SHARE = 0.2, 5, 0.3
#: How much less each further presentation lets the children count, and the deepest node of the tree.
ATTENUATION, DEPTH = 0.9, 32

#: Fixed values of HTML: elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body head html li dd dt tr td th tbody thead tfoot caption option legend".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: Elements that can be a template inside an article, if they have a class or id; its plain blocks always stay.
CONTAINERS = frozenset("div section ul ol dl table figure".split())

#: Elements that are no article, and words in class or id that say so.
NO_ARTICLE = frozenset("head script style noscript template nav footer aside form button select input textarea iframe object svg canvas audio video dialog menu search label fieldset".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo banner sidebar cookie cookies consent notice notices comment comments replies respond "
    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead related share sharing social newsletter login popup modal pagination".split()
)
#: Those that also rule out an article's paragraphs, headings and inline elements; of other names these have their own use.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsored promo".split())
#: Words that may follow in a name: the last one before them tells what it is.
HOLDERS = frozenset("area bar block box button buttons container content form group icons inner item items left links list main panel post posts right row section signup slot thread unit widget widgets wrap wrapper".split())
#: Words that may come before in an id, and words of classes that speak of another element.
BEFORE, OTHERS = frozenset("article blog page post reader readers site story the user".split()), frozenset("has hide is no show with without".split())
#: Elements that hold the page or its article.
WHOLE = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that say so outside of an article only.
OUTER_NOISE = frozenset(["header", "topbar", "top"])

_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|/?[a-zA-Z][^>]*>|[!?/][^>]*>)""", re.S)
#: A name and its whole value, so that what a value says is no name.
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORD = re.compile(r"[A-Za-z0-9]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)


class _Node:
    __slots__ = ("tag", "path", "up", "out", "main", "branch", "children", "texts", "chars", "again", "gone")

    def __init__(self, tag: str, path: str, out: bool, main: bool, branch: bool = False, up: _Node | None = None):
        self.tag, self.path, self.up, self.out, self.main, self.branch = tag, path, up, out, main, branch
        self.children: list[_Node] = []
        self.texts: list[int] = []
        self.chars = self.again = 0
        self.gone: bool | None = None


def _called(classes: list[str], names: frozenset[str]) -> bool:
    """Whether a class ends in one of the names: site-footer and ad-slot do, menu-planning and has-sidebar do not."""
    for token in classes:
        words = _WORD.findall(token.partition("--")[0])
        if OTHERS.intersection(words):
            continue
        while len(words) > 1 and words[-1] in HOLDERS:
            words.pop()
        if words and words[-1] in names:
            return True
    return False


def _identified(ids: list[str]) -> bool:
    """Whether an id is such a name in all of its words: comments and site-footer are, menu-planning is not."""
    for token in ids:
        words = _WORD.findall(token)
        if words and any(w in NOISE for w in words) and all(w in NOISE or w in HOLDERS or w in BEFORE for w in words):
            return True
    return False


def _noise(tag: str, inside: bool, classes: list[str], ids: list[str]) -> bool:
    if tag in ("html", "body"):
        return False
    if tag in WHOLE:
        return bool(NOISE.intersection(classes))
    if inside and tag not in CONTAINERS:
        return _called(classes, ADVERTS)
    return _called(classes, NOISE) or (tag in CONTAINERS and _identified(ids)) or (not inside and (tag == "header" or _called(classes, OUTER_NOISE) or (tag in CONTAINERS and bool(OUTER_NOISE.intersection(ids)))))


def _attributes(raw: str) -> tuple[str, list[str], list[str], str, bool]:
    """Label, classes, ids and role, and whether the element is hidden."""
    if not raw or ("=" not in raw and "hidden" not in raw.lower()):
        return "", [], [], "", False
    label, found, hidden = "", {"class": [], "id": [], "role": []}, False
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        value, name = a or b or c, name.lower()
        if name == "hidden" or (name == "style" and _HIDDEN.search(value)):
            hidden = True
        if name not in found:
            continue
        if name != "role":
            label += (".", "#")[name == "id"] + value.strip()
        found[name] += value.lower().split()
    return label, found["class"], found["id"], " ".join(found["role"]), hidden


def parse(page: str) -> tuple[list[tuple[str, _Node]], list[_Node], bool]:
    """Blocks (text, the node that has it) outside of what markup rules out, the nodes, and whether the page has a main
    element. Time is in proportion to the page, however deep it is."""
    root = _Node("", "", False, False)
    stack, nodes, blocks, buffer = [root], [], [], []
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
    has_main, at, n, gt = False, 0, len(page), -1

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def flush():
        if buffer:
            text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            # What came before an inline element that is ruled out belongs to the element around it.
            x = stack[-1] if stack[-1].tag in BLOCKS or stack[-1] is root else stack[-1].up
            if text and not x.out:
                blocks.append((text, x))
                x.texts.append(_node_id(text))
                x.chars += len(text)

    def close(k: int):
        flush()
        for x in stack[k:]:
            places[x.tag].pop()
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not stack[-1].out:
            buffer.append(page[at:lt])
        if lt == n:
            break
        if gt < lt:
            gt = page.find(">", lt)
        if gt < 0 and not page.startswith("<!--", lt):  # no tag ends any more
            nxt = page.find("<!--", lt)
            if not stack[-1].out:
                buffer.append(page[lt : nxt if nxt >= 0 else n])
            at = nxt if nxt >= 0 else n
            continue
        m = _TAG.match(page, lt)
        if not m:
            if not stack[-1].out:
                buffer.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                k = nearest((tag,))
                close(k) if k else flush()
            elif stack[-1].tag == tag:  # an inline element that rules itself out
                if stack[-1].again:
                    stack[-1].again -= 1
                else:
                    places[stack.pop().tag].pop()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1].out:
                buffer.append(" ")
            continue
        if tag not in BLOCKS and stack[-1].tag == tag and not m[3].endswith("/"):
            stack[-1].again += 1
            continue
        if tag not in BLOCKS and tag not in NO_ARTICLE and not m[3]:
            continue
        if tag in CLOSES_P:
            k = nearest(("p", "table", "td", "th", "article"))
            if k and stack[k].tag == "p":
                close(k)
        if tag in ENDS:
            k = nearest([*ENDS[tag], *SCOPES[tag]])
            if k and stack[k].tag in ENDS[tag]:
                close(k)
        label, classes, ids, role, hidden = _attributes(m[3])
        up = stack[-1]
        holds = tag in ("article", "main") or role == "main"
        out = up.out or hidden or tag in NO_ARTICLE or _noise(tag, up.main, classes, ids)
        main = up.main or (holds and not out)
        if tag not in BLOCKS and not (out and not up.out):
            continue  # plain inline markup
        if tag in BLOCKS:
            flush()
        has_main |= main and holds
        node = _Node(tag, f"{up.path}/{tag}{label}" if len(stack) <= DEPTH else up.path, out, main, bool(label) and tag in CONTAINERS, up)
        up.children.append(node)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        if not out:
            nodes.append(node)
        if m[3].endswith("/") and tag not in BLOCKS:
            places[stack.pop().tag].pop()
    flush()
    for x in reversed(nodes):  # those beneath come after
        x.up.chars += x.chars
    return blocks, nodes, has_main


def _node_id(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - (1 << 63)


_ROW = pa.schema(
    [("host", pa.string()), ("page", pa.int64()), ("node", pa.int64()), ("chain", pa.list_(pa.int64())), ("style", pa.int64()), ("kids", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("own", pa.float64()), ("texts", pa.list_(pa.int64())), ("share", pa.float64())]
)


def page_nodes(page: str) -> tuple[int, list[tuple]]:
    """The hash of a page's main blocks, and (node, chain, style, kids, weights, own, texts, share) of each node with text.

    chain: the nodes from the top to this one. weights: the share of each kid among children and own blocks; own: that of
    the latter together."""
    blocks, nodes, has_main = parse(page)
    total = sum(len(b[0]) for b in blocks) or 1
    mark = _node_id("\n".join(text for text, x in blocks if x.main or not has_main))
    merged: dict[str, list[_Node]] = {}
    for x in nodes:
        if x.chars:
            merged.setdefault(x.path, []).append(x)
    chains: dict[str, list[int]] = {"": []}
    rows = []
    for path, same in merged.items():  # parents come first
        up = same[0].up.path
        chains[path] = [*chains[up], _node_id(path)] if up != path else chains[path]
        kids = [c.path for x in same for c in x.children if c.chars and c.path != path]
        texts = [t for x in same for t in x.texts]
        n = len(kids) + len(texts) or 1
        each = {k: c / n for k, c in collections.Counter(kids).items()}
        rows.append((chains[path][-1], chains[path], _node_id("|".join(k.rpartition("/")[2] for k in kids)), [_node_id(k) for k in each], list(each.values()), len(texts) / n, sorted(set(texts)), sum(x.chars for x in same if x.up.path != path) / total))
    return mark, rows


def _style_rows(batches):
    with released():
        for batch in batches:
            out: list[tuple] = []
            for host, page in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("host", "html")), strict=True):
                mark, rows = page_nodes(page or "")
                out += [(host, mark, *row) for row in rows]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROW, strict=True)], schema=_ROW)
                    out = []
            columns = zip(*out, strict=True) if out else [[]] * len(_ROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


_STYLE_ROW = "host string, page bigint, node bigint, chain array<bigint>, style bigint, kids array<bigint>, weights array<double>, own double, texts array<bigint>, share double"


def node_importance(once: DataFrame) -> DataFrame:
    """(host, node, chain, pages, share, importance) of every node, from rows of page nodes, each page once."""
    key, log = ["host", "node"], lambda c: F.log(F.col(c).cast("double"))
    styles = once.groupBy(*key, "style").agg(F.count("*").alias("c"), F.min("chain").alias("chain"), F.sum("share").alias("share"), F.sum("own").alias("own"))
    nodes = styles.groupBy(*key).agg(F.sum("c").alias("m"), F.count("*").alias("l"), F.sum(F.col("c") * log("c")).alias("s"), F.min("chain").alias("chain"), F.sum("share").alias("share"), F.sum("own").alias("own"))
    nodes = nodes.withColumn("shown", F.when(F.col("m") > 1, (log("m") - F.col("s") / F.col("m")) / log("m")).otherwise(1.0))
    blocks = once.select(*key, F.explode("texts").alias("t")).groupBy(*key, "t").agg(F.count("*").alias("c")).groupBy(*key).agg(F.avg(log("c")).alias("common"))
    kids = once.select("host", F.explode(F.arrays_zip("kids", "weights")).alias("k")).groupBy("host", F.col("k.kids").alias("node")).agg(F.sum("k.weights").alias("weight"))
    parents = nodes.select("host", F.col("node").alias("parent"), F.col("m").alias("pm"), F.pow(F.lit(ATTENUATION), F.col("l")).alias("pg"))
    all_ = nodes.join(blocks, key, "left").join(kids, key, "left").withColumn("parent", F.try_element_at("chain", F.lit(-2)))
    all_ = all_.join(parents, ["host", "parent"], "left")
    content = F.when(F.col("m") > 1, 1 - F.coalesce("common", F.lit(0.0)) / log("m")).otherwise(1.0)
    leaf, g = F.col("own") >= F.col("m") - 1e-9, F.pow(F.lit(ATTENUATION), F.col("l"))
    adds = F.when(leaf, content).otherwise((1 - g) * F.col("shown") + g * F.col("own") / F.col("m") * content)
    tree = all_.select(*key, "chain", F.col("m").alias("pages"), (F.col("share") / F.col("m")).alias("share"), adds.alias("adds"), F.coalesce(F.col("pg") * F.col("weight") / F.col("pm"), F.lit(0.0)).alias("up"))
    # What a node adds to each one above, through the weights on the way: chains have DEPTH nodes at most.
    steps = tree.select("host", F.col("node").alias("from"), "adds", F.posexplode("chain").alias("at", "node")).join(tree.select(*key, "up"), key)
    ways = steps.groupBy("host", "from").agg(F.min("adds").alias("adds"), F.array_sort(F.collect_list(F.struct("at", "node", "up"))).alias("way"))
    through = lambda x: F.aggregate(F.filter("way", lambda y: y["at"] > x["at"]), F.lit(1.0), lambda p, y: p * y["up"])
    parts = ways.select("host", F.explode(F.transform("way", lambda x: F.struct(x["node"].alias("node"), (F.col("adds") * through(x)).alias("v")))).alias("e"))
    sums = parts.groupBy("host", F.col("e.node").alias("node")).agg(F.sum("e.v").alias("importance"))
    return tree.select(*key, "chain", "pages", "share").join(sums, key)


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, node, importance, pages) of the branches to remove, from (host, html). Copies of a page count once."""
    spark = pages.sparkSession
    rows = pages.where("host <> ''").select("host", "html").mapInArrow(_style_rows, _STYLE_ROW)
    rest = ("chain", "style", "kids", "weights", "own", "texts", "share")
    once, path = cut(rows.groupBy("host", "page", "node").agg(F.min(F.struct(*rest)).alias("x")).select("host", "page", "node", "x.*"), "style-rows")
    tree, tree_path = cut(node_importance(once), "style-importance")
    drop(spark, path)
    beneath = tree.select("host", F.explode("chain").alias("node"), "importance").groupBy("host", "node").agg(F.max("importance").alias("most"))
    low = tree.join(beneath, ["host", "node"]).where((F.col("most") < LEAST_IMPORTANCE) & (F.col("pages") >= LEAST_PAGES) & (F.col("share") <= MOST_SHARE))
    out, _ = cut(low.select("host", "node", "importance", "pages"), "style-tree")
    drop(spark, tree_path)
    return out


def main_text(page: str, low: set[int]) -> str:
    blocks, nodes, has_main = parse(page)
    known: dict[str, bool] = {}
    if low:
        for x in nodes:  # those above come first
            if x.path not in known:
                known[x.path] = _node_id(x.path) in low
            x.gone = bool(x.up.gone) or ((x.branch or not x.main) and known[x.path])
    return "\n".join(text for text, x in blocks if (x.main or not has_main) and not x.gone)


def _texts(batches):
    with released():
        for batch in batches:
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("html", "low", "host")]
            hosts, low, pages = (batch.column(batch.schema.get_field_index(n)) for n in ("host", "low", "html"))
            known: dict[str | None, set[int]] = {}
            texts = []
            for i, host in enumerate(hosts.to_pylist()):
                if host not in known:
                    known[host] = set(low[i].as_py() or ())
                texts.append(main_text(pages[i].as_py() or "", known[host]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(batch.schema.names[i] for i in keep), "text", "n_chars"])


def extract_html(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with text and n_chars. Input columns with these names are replaced."""
    names = {c: f"c{i}" for i, c in enumerate(pages.columns) if c not in (html_col, "text", "n_chars")}
    host = F.regexp_extract(F.lower(F.col(f"`{url_col}`")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)", 1)
    inner = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], host.alias("host"), F.col(f"`{html_col}`").alias("html"))
    # From a table, so that its size is known: Spark broadcasts it below its threshold and joins by host beyond.
    low = low_branches(inner).groupBy("host").agg(F.collect_list("node").alias("low"))
    joined = inner.join(low, "host", "left").select(*names.values(), "host", "html", "low")
    kinds = ", ".join(f"{n} {t}" for n, t in joined.dtypes if n not in ("host", "html", "low"))
    out = joined.mapInArrow(_texts, f"{kinds}, text string, n_chars bigint")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "text", "n_chars")
