"""HTML extraction by wrapper induction.

A page is parsed into its blocks and a skeleton: the tree of its block elements by tag and class,
with runs of like siblings as one node.  Skeletons of one host are aligned by simple tree
matching (equal roots, then the best order-keeping match of the children) and folded into the
host's template: how many pages have a node, which of its blocks all of them share, and whether
any two of them differ (copies of one page show nothing constant).
Tasks fold the pages they read, partial templates are folded again by host in two salted
rounds, so one host with a third of all pages costs no task more than one template a task.

To extract, a page's skeleton is aligned with its host's template.  Elements that name their
part (nav, footer, forms, a class such as "sidebar") are left out.  Blocks that all pages with
their node share are template and left out as well, if pages that differ have the node and at
least half of those with its parent do.  If the page marks its main part (article, main), that is
the slot; it stays whole where over half of it would be template, as near copies of one page look
like that.  Else the slot is the page.  All other blocks of the slot are the text.

Wrappers of all hosts are sent to executors only if they take at most ``bound`` bytes together;
beyond, they are joined to the pages by host and salt.

Results in special cases: null or empty html, or html without text, gives the empty text.  A
null url, or one without a host, belongs to the host ''.  A host's only page, or copies of one
page, have no constant nodes to tell, so all that isn't left out by name is looked at.  Repeated
pages each get a row.  An empty table gives an empty result.  Only named columns are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, groups

#: Element names of HTML by their role in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
OUT_TAGS = frozenset("aside audio button canvas datalist dialog footer form head iframe input map menu nav noscript object option script search select style svg template textarea title video".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUT_WORDS = frozenset("ad ads adsense banner bottombar byline consent gdpr header login masthead menu modal nav navbar newsletter notice pager pagination popup promo promotion related replies reply respond search share sharing signup social subscribe subscription teaser toolbar topbar widget widgets".split())
OUT_STEMS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "footer", "navigation", "sidebar", "sponsor")
OWN_WORDS = frozenset("article body content entry main page post story text".split())
#: An open element of these ends where one of the others begins, up to the container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"})}

TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/><"']*+)((?:[^<>"']|"[^"]*+"|'[^']*+')*+)>|[!?/][^<>]*+>|(/?)([a-zA-Z][^\s/><"']*+)([^<>]*+)>)""", re.S)
#: Elements nested deeper than this share the skeleton node above; their text stays.
DEEPEST = 150
ATTR = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HOST = re.compile(r"://([^/?#]*)")


@lru_cache(maxsize=50_000)
def describe(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """(key, left out, marks the main part) of an element."""
    own = {}
    for m in ATTR.finditer(attrs):
        own.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    role = own.get("role", "").lower()
    words = [w.lower() for k in ("class", "id") for w in NAME.findall(own.get(k, ""))]
    key = f"{tag}.{own.get('class', '')}#{re.sub(r'[0-9]+', '0', own.get('id', ''))}"
    if tag in ("html", "body"):
        return key, False, False
    named = any(w in OUT_WORDS or w.startswith(OUT_STEMS) for w in words)
    if named and all(not w.startswith(OUT_STEMS) for w in words) and OWN_WORDS & set(words) and {w for w in words if w in OUT_WORDS} <= {"header"}:
        named = False
    if tag in ("article", "main") and not any(w.startswith("comment") or w in ("ad", "ads", "teaser", "related", "reply") for w in words):
        named = False
    out = tag in OUT_TAGS or role in OUT_ROLES or named or "hidden" in own or own.get("aria-hidden") == "true"
    return key, out, not out and (tag in ("article", "main") or role in ("main", "article"))


def digest(text: str) -> str:
    return blake2b(text.encode(errors="replace"), digest_size=8).hexdigest()


class Page:
    """Skeleton (keys, parents, children of nodes; 0 is the root) and blocks (node, text)."""

    def __init__(self, html: str):
        self.keys, self.parent, self.children = ["#root"], [-1], [[]]
        self.out, self.main, self.depth = [False], [False], [0]
        self.blocks: list[tuple[int, str]] = []
        self.parse(html)

    def child(self, at: int, cursor: int, tag: str, attrs: str) -> tuple[int, int]:
        key, out, main = describe(tag, attrs)
        if tag == "header" and not self.inside_main(at):
            out = True
        own = self.children[at]
        for k in range(max(cursor, 0), len(own)):
            if self.keys[own[k]] == key:
                return own[k], k
        if self.depth[at] >= DEEPEST and (out or self.out[at]) == self.out[at]:
            return at, cursor
        node = len(self.keys)
        self.keys.append(key)
        self.parent.append(at)
        self.children.append([])
        self.depth.append(self.depth[at] + 1)
        self.out.append(out or self.out[at])
        self.main.append(main and not self.out[at])
        own.append(node)
        return node, len(own) - 1

    def inside_main(self, node: int) -> bool:
        while node >= 0:
            if self.main[node]:
                return True
            node = self.parent[node]
        return False

    def parse(self, html: str) -> None:
        stack: list[list] = [["#root", 0, 0]]  # tag, node, place of the last child
        text: list[str] = []

        def flush() -> None:
            if text:
                joined = " ".join(unescape("".join(text)).split())
                if joined:
                    self.blocks.append((stack[-1][1], joined))
                text.clear()

        def pop_to(k: int) -> None:
            flush()
            del stack[k:]

        pos, size = 0, len(html)
        while pos < size:
            m = TAG.search(html, pos)
            if not m:
                rest = html[pos:]
                text.append(rest if "<" not in rest or not re.search(r"<[a-zA-Z!/?]", rest) else re.split(r"<[a-zA-Z!/?]", rest, maxsplit=1)[0])
                break
            if m.start() > pos:
                text.append(html[pos : m.start()])
            pos = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attrs = m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if tag in INLINE:
                    continue
                if tag == "p" and not any(s[0] == "p" for s in stack):
                    flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, pos)
                pos = end.end() if end else size
                continue
            if tag in INLINE:
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    flush()
                continue
            flush()
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] in ("table", "td", "th", "li", "div", "button", "object", "caption"):
                        break
            if tag in ENDS:
                ends, stop = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        pop_to(k)
                        if tag in ("li", "td", "th", "dt", "dd", "option"):
                            break
                    elif stack[k][0] in stop:
                        break
            node, stack[-1][2] = self.child(stack[-1][1], stack[-1][2], tag, attrs)
            stack.append([tag, node, 0])
        flush()

    def signature(self) -> str:
        return "\n".join(f"{p} {k}" for p, k in zip(self.parent, self.keys, strict=True))

    def texts(self) -> tuple[list[set[str]], str]:
        """Digests of the blocks of each node, and one of the page."""
        own: list[set[str]] = [set() for _ in self.keys]
        for node, text in self.blocks:
            own[node].add(digest(text))
        return own, digest("\n".join(t for _, t in self.blocks))


class Template:
    """A host's folded skeletons: nodes with keys, children, pages, the digests of the blocks that all pages with the node share, and the digest of its one page or '*'."""

    def __init__(self) -> None:
        self.keys, self.parent, self.children = ["#root"], [-1], [[]]
        self.pages, self.shared, self.seen = [0], [set()], [""]
        self.known: dict[str, list[int]] = {}

    def match(self, keys: list[str], children: list[list[int]]) -> list[int]:
        """Template node of each node, -1 where none matches, by simple tree matching."""
        seen: dict[tuple[int, int], tuple[int, list]] = {}

        def best(a: int, b: int) -> tuple[int, list]:
            if keys[a] != self.keys[b]:
                return 0, []
            if (a, b) not in seen:
                xs, ys = children[a], self.children[b]
                table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
                for i, x in enumerate(xs):
                    for j, y in enumerate(ys):
                        table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + best(x, y)[0])
                pairs, i, j = [], len(xs), len(ys)
                while i and j:
                    if table[i][j] == table[i - 1][j]:
                        i -= 1
                    elif table[i][j] == table[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        pairs.append((xs[i], ys[j]))
                seen[a, b] = 1 + table[-1][-1], pairs
            return seen[a, b]

        found, todo = [-1] * len(keys), [(0, 0)]
        while todo:
            a, b = todo.pop()
            if best(a, b)[0]:
                found[a] = b
                todo += best(a, b)[1]
        return found

    def places(self, signature: str, keys: list[str], parent: list[int], children: list[list[int]]) -> list[int]:
        """Template node of each node; nodes that don't match are added."""
        if signature not in self.known:
            found = self.match(keys, children)
            for node in range(1, len(keys)):
                if found[node] < 0:
                    at = found[parent[node]]
                    found[node] = len(self.keys)
                    self.keys.append(keys[node])
                    self.parent.append(at)
                    self.children.append([])
                    self.pages.append(0)
                    self.shared.append(set())
                    self.seen.append("")
                    before = [found[s] for s in children[parent[node]][: children[parent[node]].index(node)] if found[s] >= 0]
                    own = self.children[at]
                    own.insert(own.index(before[-1]) + 1 if before and before[-1] in own else 0, found[node])
            if len(self.known) >= 200:
                self.known.clear()
            self.known[signature] = found
        return self.known[signature]

    def fold(self, signature: str, keys: list[str], parent: list[int], children: list[list[int]], pages: list[int], shared: list[set[str]], seen: list[str]) -> None:
        for t, n, x, one in zip(self.places(signature, keys, parent, children), pages, shared, seen, strict=True):
            self.shared[t] = self.shared[t] & x if self.pages[t] else x
            self.seen[t] = one if not self.pages[t] or self.seen[t] == one else "*"
            self.pages[t] += n

    def aligned(self, page: Page) -> list[int]:
        """Template node of each of the page's nodes, -1 where none matches."""
        signature = page.signature()
        if signature not in self.known:
            if len(self.known) >= 200:
                self.known.clear()
            self.known[signature] = self.match(page.keys, page.children)
        return self.known[signature]

    def varying(self, page: Page, blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """Those of the page's blocks that are not template."""
        place = self.aligned(page)
        told = [p >= 0 and self.seen[p] == "*" and 2 * self.pages[p] >= self.pages[max(self.parent[p], 0)] for p in place]
        return [b for b in blocks if not (told[b[0]] and self.shared[place[b[0]]] and digest(b[1]) in self.shared[place[b[0]]])]

    def add(self, page: Page) -> None:
        shared, one = page.texts()
        self.fold(page.signature(), page.keys, page.parent, page.children, [1] * len(page.keys), shared, [one] * len(page.keys))

    def dump(self) -> bytes:
        return json.dumps([self.keys, self.parent, self.children, self.pages, [sorted(x) for x in self.shared], self.seen]).encode()

    @classmethod
    def load(cls, data: bytes) -> Template:
        out = cls()
        out.keys, out.parent, out.children, out.pages, shared, out.seen = json.loads(data)
        out.shared = [set(x) for x in shared]
        return out

    def merge(self, other: Template) -> None:
        self.fold(json.dumps([other.keys, other.parent]), other.keys, other.parent, other.children, other.pages, other.shared, other.seen)


def main_text(html: str, template: Template | None) -> str:
    """The blocks of the page's main part, joined by newlines."""
    page = Page(html)
    left = [b for b in page.blocks if not page.out[b[0]]]
    varying = template.varying(page, left) if template is not None else left
    if any(page.main):
        marked, chosen = ([t for node, t in blocks if page.inside_main(node)] for blocks in (left, varying))
        if marked:
            return "\n".join(chosen if 2 * sum(map(len, chosen)) >= sum(map(len, marked)) else marked)
    return "\n".join(t for _, t in varying or left)


def host_of(url: str | None) -> str:
    m = HOST.search(url or "")
    return m[1].lower() if m else ""


def learn_templates(pages: DataFrame, url_col: str, html_col: str, held: int = 5000) -> DataFrame:
    """(_host, _wrapper): one folded template a host."""

    def rows(found: dict[str, Template], salt: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([salt] * len(found), pa.int32()), pa.array([t.dump() for t in found.values()], pa.binary())], names=["_host", "_salt", "_wrapper"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Template] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                found.setdefault(host_of(batch.column(0)[i].as_py()), Template()).add(Page(batch.column(1)[i].as_py() or ""))
                if len(found) >= held:
                    yield rows(found, i % 32)
                    found = {}
        if found:
            yield rows(found, sum(map(len, found)) % 32)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 2):
            whole = Template()
            for data in sorted(group["_wrapper"].to_pylist()):
                whole.merge(Template.load(data))
            yield rows({group["_host"][0].as_py(): whole}, 0)

    schema = "_host string, _salt int, _wrapper binary"
    own = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(fold, schema)
    once = own.repartition("_host", "_salt").sortWithinPartitions("_host", "_salt").mapInArrow(merge, schema)
    return cut(once.repartition("_host").sortWithinPartitions("_host", "_salt").mapInArrow(merge, schema)).select("_host", "_wrapper")


def extract_text(pages: DataFrame, bound: int = 32_000_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url, text, n_chars."""
    wrappers = learn_templates(pages, url_col, html_col)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    total = wrappers.agg(F.sum(F.length("_wrapper") + F.octet_length("_host"))).first()[0] or 0
    shared = None
    if total <= bound:
        shared = pages.sparkSession.sparkContext.broadcast({r[0]: bytes(r[1]) for r in wrappers.toLocalIterator()})
        source = rows.select("*", F.lit(None).cast("binary").alias("_wrapper"))
    else:
        at = F.lower(F.regexp_extract(F.coalesce("_url", F.lit("")), r"://([^/?#]*)", 1))
        salted = rows.select("*", at.alias("_host"), F.pmod(F.xxhash64("_id", "_url"), F.lit(32)).cast("int").alias("_salt"))
        source = salted.join(wrappers.select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_salt")), ["_host", "_salt"], "left").select("_id", "_url", "_html", "_wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Template | None] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = []
                for i in range(batch.num_rows):
                    host = host_of(batch.column(1)[i].as_py())
                    if host not in loaded:
                        if len(loaded) >= 5000:
                            loaded.clear()
                        data = shared.value.get(host) if shared else batch.column(3)[i].as_py()
                        loaded[host] = Template.load(data) if data else None
                    texts.append(main_text(batch.column(2)[i].as_py() or "", loaded[host]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    kind = dict(rows.dtypes)["_id"]
    return source.mapInArrow(run, f"_id {kind}, _url string, text string, n_chars long").select(F.col("_id").alias(id_col), F.col("_url").alias("url"), "text", "n_chars")
