"""HTML extraction with a site style tree.

Pages become blocks: runs of text between block-level tags, each with the chain of tags and classes
above it. The pages of a host are merged into one tree of these chains. A node's presentation importance is the
entropy, to the base of its page count, of the sequences of children seen there; the content
importance of its own blocks is one minus the mean entropy of their texts over pages (a text on every page has 1, a
text on one page 0). Its composite importance takes in the whole subtree: the presentation importance, and
the importances of own blocks and children by their shares in the sequences, where the weight of the children is
GAMMA to the power of the number of different sequences. Pages of a host with the same blocks (repeated rows, mirrors,
other parameters in the url) are one page of the tree. A branch goes if its composite importance, and that of all
below it, is under LEAST: its text repeats, whatever the page is about. Where only a node's own blocks repeat,
they alone go. Below MIN_PAGES different pages the limit sinks with the logarithm of their number, down to FEWEST. Headings, paragraphs, items and
cells inside an article or main element stay even where they repeat. Besides, elements that HTML itself marks as no
content (scripts, navigation, forms, ...) and those whose class, id or role is as a whole the name of such a thing go, and where
a page has an article or main element only what is inside counts, with the running text that stands beside it.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .families import having, members

MIN_PAGES, LEAST, GAMMA = 8, 0.3, 0.9
#: different pages below which nothing counts as repeated: two may be two versions of one page
FEWEST = 3

#: outside quotes every "<" ends an open tag, so that no text is scanned again and again for the end of unclosed ones
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<[!?/]?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^<>]*>|<[!?][^>]*(?:>|$)", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOT_CONTENT = frozenset("head nav footer aside form button menu dialog header search object audio video canvas map label".split())
_BOILERPLATE = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription share sharing social related recommended comment comments commentlist disqus reply replies respond widget toolbar pagination pager login signup search contentinfo complementary hidden response responses discussion opinion opinions".split())
_HEADERS = frozenset(("header", "masthead"))
#: words that may stand beside one of those in a name without changing what it says
_NEUTRAL = frozenset("a area bar block body bottom box col column container content desktop fixed footer form global group head inner item items left link links list main mobile outer page post posts primary right row secondary section site slot sticky text thread title top unit user users wrap wrapper zone".split())
#: elements of running text; inside an article or main element their blocks always stay
_PROSE = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
_ENDS_P = _BLOCK - {"html", "body"}
#: an element that the start of one of these ends, up to the container
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


#: elements below this depth count as parts of the one there, as in browsers; their text stays
_DEEPEST = 512


def host_of(url: str | None) -> str | None:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m.group(1).lower() if m else None


def _says_no(name: str, inside: bool) -> bool:
    """Whether a class, id or role is the name of something that is no content: all its words, one of them a telling one.
    Inside an article a header is the article's own."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    return any(w in _BOILERPLATE and not (inside and w in _HEADERS) for w in words) and all(w in _BOILERPLATE or w in _NEUTRAL for w in words)


def _names(tag: str, at: int, inside: bool) -> tuple[str, bool, bool]:
    """Of a start tag whose name ends at a place: the part that goes into its chain, whether its names say that it is no content, and whether it has the role main."""
    label, out, main = "", False, False
    for name, value in _ATTRIBUTE.findall(tag, at):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden":
            out = True
        elif name == "aria-hidden":
            out |= value == "true"
        elif name in ("class", "id", "role"):
            if name == "class":
                label = "." + ".".join(sorted(value.split())).replace(">", ")")
            main |= name == "role" and value.lower() == "main"
            out |= any(_says_no(w, inside) for w in value.split())
    return label, out, main


def _without_cdata(page: str) -> str:
    """page without its CDATA sections; one that is not closed stays as it is."""
    out, at = [], 0
    while (start := page.find("<![CDATA[", at)) >= 0 and (end := page.find("]]>", start)) >= 0:
        out.append(page[at:start])
        at = end + 3
    return "".join(out) + page[at:] if at else page


def blocks(page: str):
    """(chain, text, inside article or main, structural boilerplate) for each block with text, in page order.

    Each piece of text has the state of the element it stands in: what no-content elements within a block hold is left
    out of its text, and a block of nothing else is boilerplate itself.
    """
    page = _without_cdata(page)
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
    out, at = [], 0
    kept, lost = [], []  # pieces of the open block's text, and those in elements that are no content
    still: dict[str, int] = {}  # open elements by name

    def flush():
        if kept or lost:
            text = " ".join(html.unescape("".join(kept)).split())
            gone = not text
            if gone and lost:
                text = " ".join(html.unescape("".join(lost)).split())
            if text:
                out.append((stack[-1][1], text, stack[-1][2], gone))
            kept.clear()
            lost.clear()

    def close(depth):
        if any(t[0] in _BLOCK for t in stack[depth:]):
            flush()
        for t in stack[depth:]:
            still[t[0]] -= 1
        del stack[depth:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            (lost if stack[-1][3] else kept).append(page[at : m.start()])
        at = m.end()
        tag = _TAG.match(page, m.start())
        if m.group(1) or not tag:
            continue
        name = tag.group(2).lower()
        if name == "br":
            (lost if stack[-1][3] else kept).append(" ")
            continue
        if tag.group(1):
            if not still.get(name):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "table", "body") and name not in ("html", "body", "article", "main", "section", "div", "table"):
                    break
            continue
        if name in _BLOCK:
            flush()
            if name in _ENDS_P and still.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
        if name in _SIBLINGS:
            ends, holders = _SIBLINGS[name]
            for k in () if not any(still.get(e) for e in ends) else range(len(stack) - 1, 0, -1):
                if stack[k][0] in holders:
                    break
                if stack[k][0] in ends:
                    close(k)
                    break
        if name in _VOID or m.group().endswith("/>") and name not in _BLOCK:
            continue
        _, chain, inside, gone = stack[-1]
        label, no, main = _names(m.group(), tag.end() - m.start(), inside) if "=" in m.group() or "hidden" in m.group() else ("", False, False)
        whole = main or name in ("html", "body", "article", "main")
        in_article_header = name == "header" and inside
        still[name] = still.get(name, 0) + 1
        stack.append((name, f"{chain}>{name}{label}" if name in _BLOCK and len(stack) < _DEEPEST else chain, inside or main or name in ("article", "main"), gone or (not whole and no) or (name in _NOT_CONTENT and not in_article_header)))
    (lost if stack[-1][3] else kept).append(page[at:])
    flush()
    return out


def _prose(chain: str) -> bool:
    return chain.rpartition(">")[2].partition(".")[0] in _PROSE


def _beside(chain: str, holders: set[str]) -> bool:
    """Running text next to an article or main element, whatever it is wrapped in."""
    if not _prose(chain):
        return False
    names = chain.split(">")
    return any(">".join(names[:k]) in holders for k in range(1, len(names)))


def main_text(page: str | None, low: frozenset = frozenset(), own: frozenset = frozenset()) -> str:
    """The main text of a page, given the chains of its host's low branches and of nodes whose own blocks are low."""
    found = [b for b in blocks(page or "") if not b[3]]
    if any(b[2] for b in found):
        first = [b[0].split(">") for b in found if b[2]]
        holders = {">".join(c[:k]) for c in first for k in range(1, len(c)) if c[k].partition(".")[0] in ("article", "main")}
        found = [b for b in found if b[2] or _beside(b[0], holders)]
    if low or own:
        found = [b for b in found if b[2] and _prose(b[0]) or b[0] not in own and not any(b[0] == c or b[0].startswith(c + ">") for c in low)]
    return "\n\n".join(b[1] for b in found)


_SEEN = "host string, chain string, kind int, feature long, pages long, share long"
#: a whole sequence of children, in units of share
_WHOLE = 1 << 20


def _sequences(chains: list[str]) -> dict[str, list[str]]:
    """The children of each node in page order, own text as an empty name; equal neighbours are one."""
    out: dict[str, list[str]] = {}
    for chain in chains:
        up = ""
        for name in [*chain.split(">")[1:], ""]:
            names = out.setdefault(up, [])
            if not names or names[-1] != name:
                names.append(name)
            up = f"{up}>{name}"
    return out


def content_key(found) -> int:
    """64 bits of the chains and texts of a page's blocks, without structural boilerplate where there is anything else."""
    kept = [b for b in found if not b[3]] or found
    raw = "\n".join(f"{b[0]} {b[1]}" for b in kept).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def page_key(url: str | None, page: str | None) -> int | None:
    """64 bits of a page's host and content; null without a host or blocks."""
    host = host_of(url)
    found = blocks(page) if host is not None and page else []
    if not found:
        return None
    raw = content_key(found).to_bytes(8, "big", signed=True) + host.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def _keyed(batches):
    for b in batches:
        keys = pa.array([page_key(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.int64())
        some = keys.is_valid()
        yield pa.RecordBatch.from_arrays([keys.filter(some), *(b.column(k).filter(some) for k in range(b.num_columns))], names=["key", *b.schema.names])


def different_pages(pages: DataFrame) -> list[DataFrame]:
    """Pages (url, html) without the copies within a host, in two parts: those surely without, and one of each of the others.

    Only keys are shuffled for the first part; copies, and what the filters take for copies, meet by their keys.
    """
    rows = pages.withColumn("raw", F.xxhash64("url", "html"))
    keys = shared.written(rows.mapInArrow(lambda batches: (b.select(["key", "raw"]) for b in _keyed(batches)), "key long, raw long"))
    again = members(keys.groupBy("key").count().where("count > 1"), "key")
    raws = members(having(keys, "key", again), "raw")
    copies = having(rows, "raw", raws).mapInArrow(_keyed, "key long, url string, html string, raw long")
    one = copies.groupBy("key").agg(F.min(F.struct("url", "html")).alias("page")).select("page.url", "page.html")
    return [having(rows, "raw", raws, others=True).select("url", "html"), one]


def _tree(batches):
    """Pages of a host by chain (kind 0, with its share in its parent's sequences), by chain and block text (1), by chain and sequence of children (2), by chain with own text (3, with its share in the own sequences)."""
    import zlib

    def code(text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        return zlib.crc32(raw) << 31 | zlib.crc32(raw[::-1]) >> 1

    seen: Counter = Counter()
    shares: Counter = Counter()

    def batch():
        columns = zip(*((*k, n, shares[k]) for k, n in seen.items()))
        types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "chain", "kind", "feature", "pages", "share"])

    for b in batches:
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            host = host_of(url)
            if host is None or not page:
                continue
            found = blocks(page)
            own = {(host, chain, 1, code(text)) for chain, text, _, _ in found}
            if found:
                own.add((host, "", 0, 0))
            for up, names in _sequences([x[0] for x in found]).items():
                own.add((host, up, 2, code(">".join(names))))
                for name, times in Counter(names).items():
                    key = (host, f"{up}>{name}", 0, 0) if name else (host, up, 3, 0)
                    own.add(key)
                    shares[key] += max(1, times * _WHOLE // len(names))
            seen.update(own)
        if len(seen) > 200_000:
            yield batch()
            seen.clear()
            shares.clear()
    if seen:
        yield batch()


def _composites(batches):
    """The composite importance of each node and the highest one in its subtree; nodes come host by host, each after all below it."""
    host, held = None, []
    for b in batches:
        hosts, paths = b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        out, tops = [], []
        for k, (share, own_share, styles, inner, presentation, content) in enumerate(zip(*(b.column(c).to_pylist() for c in ("share", "own_share", "styles", "inner", "presentation", "content")))):
            if hosts[k] != host:
                host, held = hosts[k], []
            depth = len(paths[k])
            while len(held) <= depth:
                held.append((0, 0.0, 0.0))
            weight, total, top = held[depth]
            held[depth] = (0, 0.0, 0.0)
            if own_share:
                weight, total, top = weight + own_share, total + own_share * content, max(top, content)
            value = total / weight
            if inner:
                rest = GAMMA**styles
                value = (1 - rest) * presentation + rest * value
            top = max(top, value)
            up = held[depth - 1]
            held[depth - 1] = (up[0] + share, up[1] + share * value, max(up[2], top))
            out.append(value)
            tops.append(top)
        columns = [b.column(c) for c in ("host", "chain", "pages", "presentation", "content")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.float64()), pa.array(tops, pa.float64())], names=["host", "chain", "pages", "presentation", "content", "composite", "highest"])


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, chain, pages, presentation, content, composite, highest: the merged tree of the different pages of each host; content is that of a node's own blocks (null without), highest the greatest composite or content importance in its subtree."""
    alone, one = different_pages(pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")))
    counts = alone.mapInArrow(_tree, _SEEN).union(one.mapInArrow(_tree, _SEEN)).groupBy("host", "chain", "kind", "feature").agg(F.sum("pages").alias("pages"), F.sum("share").alias("share"))
    m = F.max(F.when(F.col("kind") == 0, F.col("pages")))
    texts, styles = F.col("kind") == 1, F.col("kind") == 2
    n_log_n = F.col("pages") * F.log(F.col("pages").cast("double"))
    node = counts.groupBy("host", "chain").agg(
        m.alias("pages"),
        F.sum(F.when(texts, F.col("pages"))).alias("n_texts"),
        F.sum(F.when(texts, n_log_n)).alias("texts_log"),
        F.sum(F.when(styles, F.col("pages"))).alias("n_styles"),
        F.sum(F.when(styles, n_log_n)).alias("styles_log"),
        F.count(F.when(styles, 1)).alias("styles"),
        F.sum(F.when(F.col("kind") == 0, F.col("share"))).alias("share"),
        F.coalesce(F.sum(F.when(F.col("kind") == 3, F.col("share"))), F.lit(0)).alias("own_share"),
    )
    base = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    content = F.when(F.col("own_share") > 0, F.when(F.col("pages") > 1, 1 - F.col("texts_log") / F.col("n_texts") / base).otherwise(1.0))
    presentation = F.when(F.col("n_styles") > 1, (F.log(F.col("n_styles").cast("double")) - F.col("styles_log") / F.col("n_styles")) / F.log(F.col("n_styles").cast("double"))).otherwise(1.0)
    # own text alone is at most a whole sequence a page; a node with less has children somewhere
    inner = F.col("own_share") < F.col("n_styles") * _WHOLE
    path = F.split("chain", ">")
    nodes = node.select("host", "chain", "pages", "share", "own_share", "styles", inner.alias("inner"), presentation.alias("presentation"), content.alias("content"), path.alias("path"))
    return nodes.repartition("host").sortWithinPartitions("host", F.col("path").desc()).mapInArrow(_composites, "host string, chain string, pages long, presentation double, content double, composite double, highest double")


def low_branches(tree: DataFrame, min_pages: int = MIN_PAGES, least: float = LEAST) -> DataFrame:
    """host, low, own: the chains of each host whose whole branch repeats from page to page, and those of which only the own blocks do."""
    limit = least * F.least(F.lit(1.0), F.log(F.col("pages").cast("double")) / math.log(max(2, min_pages)))
    low = F.col("highest") < limit
    own = ~low & (F.col("content") < limit)
    return tree.where((F.col("pages") >= FEWEST) & (low | own)).groupBy("host").agg(F.array_sort(F.collect_set(F.when(low, F.col("chain")))).alias("low"), F.array_sort(F.collect_set(F.when(own, F.col("chain")))).alias("own"))


#: characters of low branches that are broadcast at most; more are joined by a shuffle that Spark can split
BROADCAST_CHARS = 8 << 20


@shared.call
def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages.

    Null or empty html and pages without main text give an empty text. Pages whose url is null or has
    no host have no site tree; repeated pages and ids stay as they are, and count once in the tree. White space is what str.split
    takes. Other columns are ignored; an empty table gives an empty result.
    """
    low = shared.lasting(low_branches(style_tree(pages, url_col, html_col)).withColumnRenamed("host", "low_host"))
    chars = low.agg(F.sum(F.length("low_host") + F.length(F.array_join("low", ">")) + F.length(F.array_join("own", ">")))).first()[0] or 0
    if chars <= BROADCAST_CHARS:
        low = F.broadcast(low)
    host = F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    joined = rows.join(low, F.col("host") == F.col("low_host"), "left").select("page_id", "url", "html", "low", "own")

    def run(batches):
        for b in batches:
            texts = [main_text(page, frozenset(low or ()), frozenset(own or ())) for page, low, own in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
