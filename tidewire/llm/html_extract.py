"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of block elements with their classes, and it holds how many
pages have it and which texts stand below it. A text that stands on many of the host's pages is template, so the importance of
a node's content is the mean, over its different texts, of 1 - log(pages with the text) / log(pages with the node): the entropy
of a text that is spread evenly over pages. The importance of a node's presentation is the entropy of its pages over the
numbers of texts that it holds; both are put together with a weight that falls with the node's number of texts. How far
that counts grows with the pages that were seen: with n pages the importance is drawn to 1 by 1 / (1 + ln n), so one rule holds
for hosts of any size. Names are priors: inside an article a branch needs less importance to stay; navigation, forms and the like
are never content, nor is what a class names as an advert, a notice or comments. Branches of low importance are cut from each page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>|<[!?][^>]*>|[^<]+|<""", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"[\s ]+")

# Element names of the HTML standard by what they hold.
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address header footer nav aside form fieldset details summary hgroup center dialog menu hr".split())
RAW = frozenset("script style noscript template iframe textarea title select head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("nav footer aside form fieldset menu dialog button header".split())
CONTENT = frozenset("article main".split())
COMMENT_WORDS = frozenset("comment comments disqus replies reply".split())
NOISE_WORDS = COMMENT_WORDS | frozenset("ad ads advert adverts advertisement advertising banner banners cookie cookies consent notice notices sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social promo promotion sponsor sponsored newsletter subscribe popup modal related recommended toolbar widget pagination pager adsbygoogle".split())
#: Words of layout: a class of these and of words for noise is noise, like site-footer; one with any other word isn't, like lunch-menu.
LAYOUT = frozenset("site page main top bottom left right center side inner outer primary secondary global mobile desktop box bar list lists item items link links wrap wrapper container row col column area section block panel slot unit zone group button buttons icon icons overlay inline sticky fixed js".split())
#: Roles of landmarks and boxes that aren't content.
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tooltip".split())
#: Elements that a class never turns into noise, unless it speaks of comments.
KEPT = frozenset("html body main article".split())
#: Elements without a meaning of their own.
BOXES = frozenset("div ul ol table td".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Importance below which a branch goes, inside an article and elsewhere.
LEAST_INSIDE, LEAST, GAMMA = 0.21, 0.4, 0.9


def says_noise(token: str) -> bool:
    """Whether a class names noise: all its words are of noise or layout, one at least of noise."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    return any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in LAYOUT for w in words)


class Block:
    __slots__ = ("path", "noise", "main", "text")

    def __init__(self, path: tuple[int, ...], noise: bool, main: bool, text: str):
        self.path, self.noise, self.main, self.text = path, noise, main, text


def blocks(page: str) -> list[Block]:
    """The texts of a page in order, each with the hashes of its branches from the root, and what the names above it say."""
    out: list[Block] = []
    # name, hash of the path, whether a name says noise, whether one says content
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    parts: list[str] = []
    # The inline element that is noise, how many of its name are open inside it, and how many blocks were open around it.
    inline, deep, around, at = "", 0, 0, 0

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(Block(tuple(s[1] for s in stack[1:]), stack[-1][2], stack[-1][3], text))

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            token = m[0]
            if not token.startswith(("<!", "<?")):
                if not deep:
                    parts.append(token)
            continue
        name, closing = name.lower(), m[1] == "/"
        if name in RAW and not closing and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end is None and name not in ("script", "style", "textarea", "title"):
                continue
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
        given = [(c[1].lower(), (c[2] or c[3] or c[4] or "").lower().split()) for c in NAMES.finditer(m[3])] if "=" in m[3] and not closing else []
        tokens = sorted({w for _, words in given for w in words})
        # An id may be an anchor, so it says noise only on a plain box, and as one word; else it only tells branches apart.
        said = [w for kind, words in given if kind == "id" and name in BOXES for w in words if w in NOISE_WORDS] + [w for kind, words in given if kind == "class" for w in words if says_noise(w)] + [w for kind, words in given if kind == "role" for w in words if w in NOISE_ROLES]
        if name not in BLOCKS:
            if deep and name == inline:
                deep += -1 if closing else 1
            elif not deep and not closing and name not in VOID and not m[3].endswith("/") and (name == "button" or said):
                inline, deep, around = name, 1, len(stack)
            continue
        flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                del stack[depth:]
            deep *= len(stack) >= around
            continue
        if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()
        while stack[-1][0] in CLOSED_BY.get(name, ()):
            stack.pop()
        deep *= len(stack) >= around
        if name in VOID:
            continue
        main = stack[-1][3] or name in CONTENT or "main" in tokens
        named = any(t in COMMENT_WORDS for t in said) if name in KEPT else bool(said)
        noise = stack[-1][2] or named or deep > 0 or (name in NOISE and not (name == "header" and stack[-1][3]))
        # Numbers in classes and ids tell pages apart and not kinds of branches.
        words = sorted({w for t in tokens for w in re.split(r"[^a-z]+", t) if w})
        path = xxhash.xxh64_intdigest(f"{stack[-1][1]}/{name}.{'.'.join(words)}") - (1 << 63)
        stack.append((name, path, noise, main))
    flush()
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and branch: the text hashes below it, each once, and how many there are (as the text's hash null)."""
    for batch in batches:
        host, node, text, n = [], [], [], []
        for own, page in zip(batch.column("host").to_pylist(), batch.column("_html").to_pylist(), strict=True):
            below: dict[int, set[int]] = {}
            for b in blocks(page or ""):
                h = xxhash.xxh64_intdigest(b.text) - (1 << 63)
                if not b.noise:
                    for p in b.path:
                        below.setdefault(p, set()).add(h)
            for p, texts in below.items():
                host += [own] * (len(texts) + 1)
                node += [p] * (len(texts) + 1)
                text += [None, *texts]
                n += [len(texts)] + [0] * len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(host, type=pa.int64()), pa.array(node, type=pa.int64()), pa.array(text, type=pa.int64()), pa.array(n, type=pa.int32())], names=["host", "node", "text", "n"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, importance, pages: the site style tree of each host; the argument has host and _html.

    Nodes that names mark as noise are cut anyway and left out. The texts of a page count once for each node.
    """
    rows = pages.select("host", "_html").mapInArrow(_features, "host long, node long, text long, n int")
    counts = rows.groupBy("host", "node", "text", "n").agg(F.count(F.lit(1)).alias("df"))
    nodes = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("text").isNull(), F.col("df"))).alias("pages"),
        F.sum(F.when(F.col("text").isNull(), F.col("df") * F.log("df"))).alias("styles"),
        F.count("text").alias("texts"), F.sum(F.when(F.col("text").isNotNull(), F.log("df"))).alias("spread"),
    )
    m = F.log(F.col("pages").cast("double"))
    content = F.when(F.col("pages") > 1, 1 - F.col("spread") / F.col("texts") / m).otherwise(1.0)
    presentation = F.when(F.col("pages") > 1, (m - F.col("styles") / F.col("pages")) / m).otherwise(1.0)
    keep = F.pow(F.lit(GAMMA), F.col("texts").cast("double"))
    seen = (1 - keep) * content + keep * F.greatest(content, presentation)
    return nodes.select("host", "node", (1 - m / (1 + m) * (1 - seen)).alias("importance"), "pages")


def main_text(page: str, nodes: dict[int, float]) -> str:
    """The blocks of a page that names and the importance of its branches (1 where not given) leave."""
    found = [b for b in blocks(page) if not b.noise]
    if inside := any(b.main for b in found):
        found = [b for b in found if b.main]
    least = [min((nodes.get(p, 1.0) for p in b.path), default=1.0) for b in found]
    # A branch goes if it is of low importance, and much less so than the page's branches at large: a host of
    # equal pages holds no more than its pages' one content.
    cut = min(LEAST_INSIDE if inside else LEAST, max(least, default=1.0) / 2)
    return "\n\n".join(b.text for b, v in zip(found, least, strict=True) if v >= cut)


def _extract(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, tree in zip(batch.column("_html").to_pylist(), batch.column("tree"), strict=True):
                texts.append(main_text(page or "", {n["node"]: n["importance"] for n in tree.as_py() or ()}))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, type=pa.string())], names=[*names, "text"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = 100_000) -> DataFrame:
    """One row per page: id, url, text (empty if none), n_chars; other columns are ignored.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by two \\n in page order.
    Pages without a host in their url form a host of their own; a null html is empty; repeated rows count as pages and come
    back as often; pages of a host with one page are cut by names alone; an empty table gives no rows. Only nodes whose
    importance can matter go to the pages: those of less than twice the threshold. They are
    broadcast while they are at most `broadcast_rows`, and joined by host beyond.
    """
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][\w+.-]*://(?:www\.)?([^/?#:]+)", 1)), F.lit("")))
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host.alias("host"))
    tree = style_tree(base).where(F.col("importance") < 2 * LEAST)
    trees = cut(tree.groupBy("host").agg(F.collect_list(F.struct("node", "importance")).alias("tree"), F.count(F.lit(1)).alias("n")))
    small = (trees.agg(F.sum("n")).first()[0] or 0) <= broadcast_rows
    joined = base.join(F.broadcast(trees) if small else trees.select(F.col("host").bitwiseXOR(F.lit(0)).alias("host"), "tree"), "host", "left")
    kinds = [base.schema[c].dataType.simpleString() for c in ("_id", "_url")]
    out = joined.select("_id", "_url", "_html", "tree").mapInArrow(_extract(["_id", "_url"]), f"_id {kinds[0]}, _url {kinds[1]}, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
