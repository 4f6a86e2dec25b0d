"""Main text of web pages by a site style tree.

Pages are parsed into element trees (implied end tags, raw-text elements, unclosed tags). The trees of one host are
merged: elements with the same path of tags and classes are one node of the host's style tree. A node has entropies over the m
pages that hold it: of its presentation (sequences of child tags; l of them) and of its contents (the blocks of text
directly in it, in which numbers and the host's own name stand as one sign each, so dated and named notices repeat):
  presentation  N = sum over styles of -p log_m p,
  content       C = mean over block occurrences of 1 - log_m (pages that hold the same block),
  importance    I = max(C, (1 - decay^l) N + decay^l C): a branch is low only if its presentation and its content are.
The same tree is made over all hosts, so what many hosts share (or one page of a small host repeats) is seen, too. A node's value is I
over the mean C of all text of its tree, the lesser of its host's and the one over all hosts; trees speak where a node stands on
`min_pages` pages or more. A block is kept if its node's value reaches the limit of its place: `inside` an article or main element,
`plain` on pages that mark none, `outside` on pages that mark one elsewhere. Nodes of which no tree speaks count as `unseen`.

Elements that say by tag, role, class or id what they are (menus, headers, footers, sidebars, notices, adverts, forms, comments) go on
every page. A class or id says so by its last part (post-comments, ad-container), not by any word in it.

The tree is counted as rows (host, node, feature) with a partial sum in each task, so a host with a third of
all pages is summed where its pages lie. The values of a host's nodes are one short list, which goes to each of `SALTS` parts
of the host's pages, so no task gets a whole host.

A mark holds for the runs of text inside the element, also where it stands in the middle of a paragraph (a button, a share link): the run goes, the
paragraph stays. Inside an article, a class on an element of running text (a paragraph, heading, quotation, list item or cell) has to be one of ADS,
as such elements also tell of promotions, notices and comments.

Defined cases: null and empty html give an empty text. Pages without a host share the host ''. A page that holds only marked blocks gives an empty text. Where all unmarked
blocks of a page are low they stay, as pages that stand several times look like that. Pages of any length are parsed whole, in one pass.
Repeated rows are pages of their own. An empty table gives no row. Extra columns are kept by extract().
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, task_batches

# Element classes of HTML, and words by which pages mark what isn't their article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg annotation select".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav header footer aside button dialog menu head label fieldset".split()) | RAW
CLOSES_P = BLOCKS - frozenset(("body", "html"))
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar sidebar aside widget widgets related recommended share sharing social follow "
    "comment comments commentlist respond reply replies disqus footer header masthead topbar copyright disclaimer skip".split()
)
#: Elements of running text, and the marks that hold for them inside an article.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
ADS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social skip".split())
#: Parts of a class that say nothing about what is inside.
FRAMES = frozenset("container wrapper wrap box section block list area bar inner outer item items link links thread form top bottom left right main".split())
SALTS = 32
NONE, SOFT, HARD = 0, 1, 2  # marks of blocks: none; by class, id or a form element; by a tag or role
LIMITS = (0.4, 0.8, 0.95)  # least values inside an article, on pages without one, and outside one

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAMES = re.compile(r"[a-z]+|[0-9]+")


def marked(name: str, article: bool, running: bool = False) -> bool:
    """Whether one class or id says that an element is no article text: by its last part that isn't a mere frame. running: an element of running text."""
    parts = _NAMES.findall(name)
    while len(parts) > 1 and (parts[-1] in FRAMES or parts[-1].isdigit()):
        parts.pop()
    own = article or len(parts) > 1 and parts[-2] in ("article", "post", "entry", "content")
    return bool(parts) and parts[-1] in (ADS if article and running else MARKS) and not (own and parts[-1] == "header")


class Page:
    """Blocks of a page's text: (text, node, mark, whether inside article or main)."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, int, int, bool]] = []
        self.styles: dict[int, list[str]] = {}
        self._stack: list[tuple[str, int, int, bool]] = []  # tag, node, mark, inside the article
        self._text: list[tuple[str, int]] = []  # runs and their marks
        self._children: list[list[str]] = [[]]
        if html:
            self._parse(html)

    def _add(self, text: str):
        self._text.append((text, self._stack[-1][2] if self._stack else NONE))

    def _flush(self):
        """Ends a block: the runs of each mark are a block of their own."""
        if self._text:
            runs, self._text = self._text, []
            _, node, _, inside = self._stack[-1] if self._stack else ("", 0, NONE, False)
            for mark in sorted({m for _, m in runs}):
                # A run of another mark in between parts words.
                words = _html.unescape("".join(t if m == mark else " " for t, m in runs)).split()
                if words:
                    self.blocks.append((" ".join(words), node, mark, inside))

    def _pop(self):
        _, node, mark, _ = self._stack.pop()
        kids = self._children.pop()
        if not mark:
            self.styles.setdefault(node, []).append(" ".join(k for i, k in enumerate(kids) if not i or k != kids[i - 1]))

    def _close(self, tags, scope=()):
        """Closes the nearest open element of these tags, unless a scope element stands before it."""
        for i in range(len(self._stack) - 1, -1, -1):
            t = self._stack[i][0]
            if t in tags:
                while len(self._stack) > i:
                    self._pop()
                return
            if t in scope:
                return

    def _open(self, tag: str, attrs: str):
        parent = self._stack[-1] if self._stack else ("", 0, NONE, False)
        mark, inside = parent[2], parent[3] or tag in ("article", "main")
        names = ""
        if attrs and "=" in attrs:
            got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
            # has-sidebar, no-header and the like speak of the page around, not of the element.
            classes = [x for x in got.get("class", "").lower().split() if not x.startswith(("has-", "no-", "with-", "without-", "is-"))]
            role = got.get("role", "").lower()
            inside = inside or role == "main" or got.get("itemprop", "").lower() == "articlebody"
            if tag not in ("html", "body", "article", "main"):
                if role in ROLES:
                    mark = HARD
                elif not mark and (any(marked(x, parent[3], tag in RUNNING) for x in (*classes, got.get("id", "").lower())) or got.get("hidden") == "hidden"):
                    mark = SOFT
            names = " ".join("#" if x.isdigit() else x for x in _NAMES.findall(" ".join(classes)))
        if tag in DROPPED and not (tag == "header" and parent[3]):
            mark = HARD
        elif tag == "form" and not mark:
            mark = SOFT
        self._children[-1].append(tag)
        self._stack.append((tag, _node(parent[1], tag, names), mark, inside))
        self._children.append([])

    def _parse(self, html: str):
        at, find = 0, _TAG.search
        while True:
            m = find(html, at)
            if m is None:
                self._add(html[at:])
                break
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCKS or tag == "p":
                    self._flush()
                if any(s[0] == tag for s in self._stack):
                    self._close((tag,))
                continue
            if tag == "br":
                self._add(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    self._flush()
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                continue
            if tag in BLOCKS:
                self._flush()
                if tag in CLOSES_P:
                    self._close(("p",), ("td", "th", "div", "article", "section", "main", "li", "body", "button"))
            if tag in SIBLINGS:
                self._close(SIBLINGS[tag], SCOPES[tag])
                if tag == "tr":
                    self._close(("tr",), ("table",))
            if tag in ("html", "body") and any(s[0] == tag for s in self._stack):
                continue
            self._open(tag, m[3])
        self._flush()
        while self._stack:
            self._pop()

    def text(self, values: dict[int, float] | None = None, limits: tuple[float, float, float] = LIMITS, unseen: float = 0.9) -> str:
        """The kept blocks, one on a line. values: of the nodes that a tree speaks of."""
        free = [b for b in self.blocks if not b[2]]
        inside, plain, outside = limits
        if not any(b[3] for b in free):
            outside = plain
        get = (values or {}).get
        kept = [b for b in free if get(b[1], unseen) >= (inside if b[3] else outside)]
        return "\n".join(b[0] for b in kept or free)


_NODES: dict[tuple[int, str, str], int] = {}


def _node(parent: int, tag: str, names: str) -> int:
    key = (parent, tag, names)
    n = _NODES.get(key)
    if n is None:
        import xxhash

        if len(_NODES) > 500_000:
            _NODES.clear()
        n = _NODES[key] = xxhash.xxh3_64_intdigest(f"{parent} {tag} {names}") - (1 << 63)
    return n


def host_column(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_DIGITS = re.compile(r"[0-9]+")


def feature(block: str, host: str) -> str:
    """What is compared of a block: the host's name and, where letters outnumber digits, each number are one sign, so a dated or named notice repeats."""
    if host and host in block:
        block = block.replace(host, "@")
    masked, n = _DIGITS.subn("#", block)
    return masked if n and 2 * (len(block) - len(masked) + n) < len(block) - block.count(" ") else block


def node_features(pages: DataFrame, *, url="url", html="html") -> DataFrame:
    """host, node, kind (0: a style, 1: a block, 2: the node itself), feature, n (pages that hold it), times, chars."""
    rows = pages.select(host_column(F.col(url)).alias("host"), F.col(html).alias("html"))
    schema = T.StructType([T.StructField("host", T.StringType()), *(T.StructField(n, T.IntegerType() if n == "kind" else T.LongType()) for n in ("node", "kind", "feature", "n", "times", "chars"))])

    def count(batches):
        from collections import Counter

        import pyarrow as pa
        import xxhash

        digest = lambda s: xxhash.xxh3_64_intdigest(s) - (1 << 63)
        for table in task_batches(batches, None, 4096, 24 << 20):
            pages_with: Counter = Counter()
            times: Counter = Counter()
            chars: Counter = Counter()
            for host, text in zip(table["host"].to_pylist(), table["html"].to_pylist()):
                page, own = Page(text), Counter()
                for block, node, mark, _ in page.blocks:
                    if not mark:
                        key = (host, node, 1, digest(feature(block, host)))
                        own[key] += 1
                        chars[key] += len(block)
                for node, styles in page.styles.items():
                    own[host, node, 0, digest("\n".join(styles))] = 1
                    own[host, node, 2, 0] = 1
                pages_with.update(own.keys())
                times.update(own)
            keys = list(pages_with)
            cols = [*zip(*keys)] if keys else [[], [], [], []]
            cols += [[c[k] for k in keys] for c in (pages_with, times, chars)]
            yield from pa.table([pa.array(c, pa.string() if i == 0 else pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols)], names=schema.names).to_batches()

    return rows.mapInArrow(count, schema).groupBy("host", "node", "kind", "feature").agg(*(F.sum(c).alias(c) for c in ("n", "times", "chars")))


def node_importance(summed: DataFrame, level: list[str], min_pages: int, decay: float) -> DataFrame:
    """level, node, m, content, importance, value of each node that holds text on min_pages pages or more; summed: features of one level."""
    is_kind = lambda k: F.col("kind") == k
    # With m only known once all features are summed, entropies are kept as sums of n log n.
    per = summed.groupBy(*level, "node").agg(
        F.sum(F.when(is_kind(2), F.col("n"))).alias("m"), F.count(F.when(is_kind(0), 1)).alias("l"),
        F.sum(F.when(is_kind(0), F.col("n") * F.log("n"))).alias("style"),
        F.sum(F.when(is_kind(1), F.col("times"))).alias("blocks"), F.sum(F.when(is_kind(1), F.col("times") * F.log("n"))).alias("same"), F.sum("chars").alias("chars"),
    )
    per = per.filter((F.col("m") >= min_pages) & (F.col("blocks") > 0))
    log_m, old = F.log("m"), F.pow(F.lit(decay), F.col("l"))
    per = per.withColumn("content", 1 - F.col("same") / F.col("blocks") / log_m)
    style = 1 - F.coalesce("style", F.lit(0.0)) / F.col("m") / log_m
    per = per.withColumn("importance", F.greatest(F.col("content"), (1 - old) * style + old * F.col("content")))
    mean = per.groupBy(*level).agg((F.sum(F.col("chars") * F.col("content")) / F.sum("chars")).alias("mean"))
    joined = per.join(mean, level) if level else per.crossJoin(F.broadcast(mean))  # one row
    # Where all text repeats (mean 0), nothing is less important than the rest.
    return joined.select(*level, "node", "m", "content", "importance", F.when(F.col("mean") > 1e-9, F.col("importance") / F.col("mean")).otherwise(1.0).alias("value"))


def node_values(pages: DataFrame, *, url="url", html="html", min_pages=4, decay=0.9) -> DataFrame:
    """host, values (array of node and value); hosts none of whose nodes a tree speaks of have no row."""
    summed = materialize(node_features(pages, url=url, html=html), "styles")
    own = node_importance(summed, ["host"], min_pages, decay).select("host", "node", F.col("value").alias("own"))
    whole = summed.groupBy("node", "kind", "feature").agg(*(F.sum(c).alias(c) for c in ("n", "times", "chars")))
    every = node_importance(whole, [], min_pages, decay).select("node", F.col("value").alias("every"))
    # A node may stand on all hosts: its hosts are dealt over parts, too.
    salt = F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int")
    nodes = summed.filter("kind = 1").select("host", "node").distinct().withColumn("salt", salt)
    met = nodes.join(_salted(every), ["node", "salt"], "left").join(own, ["host", "node"], "left")
    out = met.withColumn("value", F.least("own", "every")).filter("value IS NOT NULL")
    values = materialize(out.groupBy("host").agg(F.collect_list(F.struct("node", "value")).alias("values")), "values")
    discard(summed)
    return values


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def extract(pages: DataFrame, *, url="url", html="html", out="text", limits=LIMITS, unseen=0.9, **options) -> DataFrame:
    """pages with the main text of each."""
    values = node_values(pages, url=url, html=html, **options).select(F.col("host").alias("__lexmill_host"), F.col("values").alias("__lexmill_values"))
    keep = pages.drop(out)
    salt = F.pmod(F.xxhash64(url, F.octet_length(html)), F.lit(SALTS)).cast("int")
    hosts = _salted(values).withColumnRenamed("salt", "__lexmill_salt")
    joined = keep.withColumns({"__lexmill_host": host_column(F.col(url)), "__lexmill_salt": salt}).join(hosts, ["__lexmill_host", "__lexmill_salt"], "left")
    schema = T.StructType([*keep.schema.fields, T.StructField(out, T.StringType())])
    names = keep.columns

    def run(batches):
        import pyarrow as pa

        for table in task_batches(batches, None, 4096, 24 << 20):
            known: dict[str, dict] = {}
            texts = []
            for h, host, rows in zip(table[html].to_pylist(), table["__lexmill_host"].to_pylist(), table["__lexmill_values"]):
                if host not in known:
                    known[host] = {r["node"]: r["value"] for r in rows.as_py() or ()}
                texts.append(Page(h).text(known[host], limits, unseen))
            yield from table.select(names).append_column(out, pa.array(texts, pa.string())).to_batches()

    return joined.select(*names, "__lexmill_host", "__lexmill_values").mapInArrow(run, schema)
