"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. A node is a block element (tag, class, id) below
its parent's node; elements that look the same below one parent are one node. Its presentation
styles are the sequences of children it shows on pages. With m pages that show a node:

* a content node (the text directly in an element) holds the texts it shows. Its importance is
  1 - mean over pages of log_m(pages with that text): 1 if every page has its own text, 0 if all
  pages have the same.
* an element node has the entropy of its styles, to base m, and the mean importance of its
  children, mixed by GAMMA to the power of its number of styles.
* a node that few pages show is near 1: nothing is known against it. `PRIOR` pages count as evidence
  of its own text each.

A branch below LOW goes from each page, if no content in it reaches twice that. Names in the
markup weigh more than any entropy: what is called a menu, footer, advert and so on has importance
0, an article or main part 1, and what has no name of its own inside it too, so a text that a
whole site copies is still its main text. Where a page is one of few of its host, names are all
there is; and adverts that rotate among many texts are too varied for their entropy to tell.

Numbers move, not pages: pages are parsed in tasks, counts per node are aggregated (a hot host is
many keys, pre-aggregated), importance goes up the tree by joins, one level at a time, and what
a page loses comes back to it by its own key.

Defined results: a null page is empty, a null address is a host of its own; repeated rows are each
returned, and count as pages; pages of any length are whole; unclosed, crossed and cut elements end
with their parents, a cut comment or tag ends the page; elements nested deeper than DEEP count as
their ancestor at that depth; white space is any Unicode white space; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

GAMMA, LOW, PRIOR, DEEP = 0.9, 0.3, 20, 40

#: block elements of HTML: fixed values
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: elements whose content is no text of the page, to the page's end if they stay open: fixed values
RAW = set("script style noscript iframe title textarea".split())
#: the same, but nothing is left out if they stay open: fixed values
SILENT = set("template object svg math canvas audio video select button".split())
VOID = {"hr"}
#: a start tag ends open elements of these names, up to the nearest of the second set: HTML's optional end tags
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
#: names of parts that are not main text: fixed values
NOISE_TAGS = set("nav footer aside form dialog menu".split())
NOISE_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets ad ads "
    "advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice notices alert "
    "popup modal newsletter subscribe signup login search form comment comments disqus replies share sharing social "
    "related recommended toolbar pagination pager skip legal copyright".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu".split())
#: a name with one of these says what a page has, not what the part is
MODIFIERS = set("has with without no is".split())
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = set("article content main post entry story body text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s'\">]+))", re.I)


def look(tag: str, attributes: str) -> tuple[str, str]:
    """(how an element looks: its tag, class and id; "noise", "main" or "" by its names)."""
    found = {} if "=" not in attributes else {
        k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(attributes)
    }
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    kind = "noise" if tag in NOISE_TAGS or found.get("role") in NOISE_ROLES else "main" if tag in MAIN_TAGS else ""
    if found.get("role") == "main" or found.get("itemprop") == "articlebody":
        kind = kind or "main"
    if kind != "noise":
        for name in names:
            parts = [x for x in re.split(r"[-_\d]+", name) if x]
            other = MAIN_WORDS.union(MODIFIERS).intersection(parts)
            if parts and not other and NOISE_WORDS.intersection((parts[0], parts[-1])):
                kind = "noise"
    return " ".join([tag, *sorted(names)]), kind


class Node:
    """An open element: the keys from the root to its node, its state ("" nothing known, main,
    noise), whether its own name gave it that state, and its children's looks."""

    __slots__ = ("tag", "path", "state", "named", "style")

    def __init__(self, tag: str, path: tuple[int, ...], state: str, named: bool = False):
        self.tag, self.path, self.state, self.named = tag, path, state, named
        self.style: list[str] = []


def hashed(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def parsed(page: str) -> Iterator[tuple]:
    """("text", node, block's text) and ("node", node) at the end of each, in page order."""
    open_nodes = [Node("", (), "")]
    opened: Counter[str] = Counter()
    looks: dict[tuple[str, str], tuple[str, str]] = {}
    block: list[str] = []
    at, end = 0, len(page)

    def text_so_far():
        text = " ".join(entities.unescape("".join(block)).split())
        block.clear()
        if text:
            yield "text", open_nodes[-1], text

    def closed():
        node = open_nodes.pop()
        opened[node.tag] -= 1
        return "node", node

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            block.append(page[at:])
            break
        block.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if m[2] is None and not page.endswith(">", 0, at):
            break  # a tag that the page's end cuts
        if tag in RAW or tag in SILENT:
            if not closing:
                over = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if over is not None:
                    at = over.end()
                elif tag in RAW:
                    at = end
            block.append(" ")
            continue
        if tag == "br":
            block.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        yield from text_so_far()
        if closing:
            if opened[tag] > 0:
                while open_nodes[-1].tag != tag:
                    yield closed()
                yield closed()
            continue
        if open_nodes[-1].tag == "p":
            yield closed()
        closes, until = ENDS.get(tag, ((), ()))
        if any(opened[x] > 0 for x in closes):
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag in closes:
                    while len(open_nodes) > k:
                        yield closed()
                if k >= len(open_nodes) or open_nodes[k].tag in until:
                    break
        if (tag, attributes) not in looks:
            looks[tag, attributes] = look(tag, attributes)
        appearance, kind = looks[tag, attributes]
        above = open_nodes[-1]
        if tag in ("header", "footer") and above.state != "main":
            kind = "noise"
        if above.state == "noise":
            kind = "noise"
        above.style.append(appearance)
        path, named = above.path, False
        if len(path) < DEEP:
            path = *path, hashed(f"{path[-1] if path else 0} {appearance}")
            named = bool(kind) and not above.state
        open_nodes.append(Node(tag, path, kind or above.state, named))
        opened[tag] += 1
        if tag in VOID:
            yield closed()
    yield from text_so_far()
    while len(open_nodes) > 1:
        yield closed()


def host_of(url: str) -> Column:
    """Lower-case host of an address without user and port, empty if there is none."""
    place = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(place)


def with_mark(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        "page_id", "url", html.alias("html"), F.xxhash64(host_of("url")).alias("host"),
        F.xxhash64("page_id", "url", html).alias("mark"),
    )


FACTS = "host long, mark long, node long, parent long, depth int, kind string, value long, shows int"


def content(key: int) -> int:
    """The content node of an element's node."""
    return hashed(f"{key} #text")


def page_facts(pages: DataFrame) -> DataFrame:
    """What each page adds to its host's tree.

    kind "style": a node and its children; "text": a content node and one of its texts; "noise" and
    "main": the top node of a branch with that name, whose importance is known and goes up the tree
    like any other. `shows` is 1 once per page and node. Below such a node nothing is gathered.
    """

    def of_page(page: str) -> Iterator[tuple]:
        styles: dict[tuple, list[str]] = {}
        texts: dict[tuple, dict[int, None]] = {}
        named: dict[tuple[tuple, str], None] = {}
        for kind, node, *text in parsed(page):
            if node.named and kind == "node":
                named[node.path, node.state] = None
            if node.state or not node.path:
                continue
            if kind == "text":
                texts.setdefault(node.path, {})[hashed(text[0])] = None
            else:
                styles.setdefault(node.path, []).extend(node.style)
        for path, style in styles.items():
            yield path[-1], path[-2] if len(path) > 1 else 0, len(path), "style", hashed("\n".join(style)), 1
        for path, state in named:
            yield path[-1], path[-2] if len(path) > 1 else 0, len(path), state, 0, 1
        for path, found in texts.items():
            for k, value in enumerate(found):
                yield content(path[-1]), path[-1], len(path) + 1, "text", value, int(k == 0)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for host, mark, page in zip(*(batch.column(k).to_pylist() for k in range(3))):
                out += [(host, mark, *fact) for fact in of_page(page)]
                if len(out) > 20_000:
                    yield _facts(out)
                    out = []
            if out:
                yield _facts(out)

    return pages.select("host", "mark", "html").mapInArrow(run, FACTS)


def _facts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 4, pa.int32(), pa.string(), pa.int64(), pa.int32()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in FACTS.split(", ")])


def own_importance(facts: DataFrame) -> DataFrame:
    """host, node, parent, depth, kind, m (pages), kinds (styles or texts), own importance.

    A named branch has the importance of its name.
    """
    by = ["host", "node", "parent", "depth", "kind"]
    values = facts.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"), F.sum("shows").alias("shows"))
    nodes = values.groupBy(*by).agg(
        F.sum("shows").alias("m"), F.count(F.lit(1)).alias("kinds"),
        (F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("mean_log_n"),
    )
    same = F.when(F.col("m") > 1, F.col("mean_log_n") / F.log("m")).otherwise(0.0)
    own = 1 - same * F.col("m") / (F.col("m") + PRIOR)
    by_name = F.when(F.col("kind") == "noise", 0.0).when(F.col("kind") == "main", 1.0)
    return nodes.select(*by, "m", "kinds", F.coalesce(by_name, own).alias("own"))


def low_nodes(own: DataFrame, gamma: float, low: float) -> DataFrame:
    """host and node of all branches whose importance is below `low`, from the leaves up."""
    deepest = own.agg(F.max("depth")).first()[0] or 0
    below = own.where("false").select("host", "node", "parent", "m", F.col("own").alias("importance"), F.col("own").alias("best"))
    found = below.select("host", "node")
    for depth in range(deepest, 0, -1):
        level = own.where(F.col("depth") == depth)
        children = below.groupBy("host", F.col("parent").alias("node")).agg(
            (F.sum(F.col("m") * F.col("importance")) / F.sum("m")).alias("children"), F.max("best").alias("best")
        )
        weight = F.pow(F.lit(gamma), F.col("kinds"))
        mixed = (1 - weight) * F.col("own") + weight * F.col("children")
        element = F.col("kind") == "style"
        importance = F.when(element & F.col("children").isNotNull(), mixed).otherwise(F.col("own"))
        # the best content below; an element without any has none
        best = F.when(element, F.coalesce("best", F.lit(0.0))).otherwise(F.col("own"))
        joined = level.join(children, ["host", "node"], "left")
        below = cut_lineage(joined.select("host", "node", "parent", "kind", "m", importance.alias("importance"), best.alias("best")))
        # an element that only looks like a named one (its name is a role) is judged by its own pages
        gone = (F.col("importance") < low) & (F.col("best") < 2 * low) & F.col("kind").isin("style", "text")
        found = found.unionByName(below.where(gone).select("host", "node"))
    return found


def extract(pages: DataFrame, gamma: float = GAMMA, low: float = LOW) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    marked = with_mark(pages)
    facts = cut_lineage(page_facts(marked))
    gone = low_nodes(cut_lineage(own_importance(facts)), gamma, low)
    lost = facts.select("host", "mark", "node").join(gone, ["host", "node"])
    lost = cut_lineage(lost.groupBy("mark").agg(F.collect_set("node").alias("nodes")))
    joined = marked.join(lost, "mark", "left").select("page_id", "url", "html", "nodes")
    identity = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {identity}, url string, text string, n_chars long"

    def main_text(page: str, lost: set[int]) -> str:
        blocks = []
        for kind, node, *text in parsed(page):
            if kind != "text" or node.state == "noise":
                continue
            if node.state == "main" or not node.path or lost.isdisjoint((*node.path, content(node.path[-1]))):
                blocks.append(text[0])
        return "\n".join(blocks)

    def run(batches):
        for batch in batches:
            texts = [
                main_text(page, set(nodes or ()))
                for page, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.record_batch(columns, ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, schema)
