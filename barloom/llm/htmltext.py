"""HTML main text by equivalence-class template deduction.

Tokens (block tags with their enclosing containers, and whole text nodes) of the
pages of one host are grouped by their occurrence vectors: tokens that occur
equally often on every page are one equivalence class, told by random sums that
combine before the shuffle. The largest class of tokens that occur once on each
page that holds them is the host's skeleton. Its containers are the template's
slots; other classes nest in them, and containers whose texts are all constant belong
to the template. The slot with most varying text holds the article; slots in an
article or main element come before the others. All of the slot's text is main
text but for such constant containers: single words and lines that come back on many
pages stay. Class words decide alone on a host without a template.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, read

#: Template rows (host, token) up to which they are broadcast, some 20 MB; beyond,
#: pages meet them by host and salt.
BROADCAST_ROWS = 200_000
SALTS = 16
#: A token belongs to a template if this share of the host's pages, and two at least, hold it.
SUPPORT = 0.5
#: A container in the article's slot whose texts are all constant is the template's on
#: this share of the pages, and this many at least; copies of one article are no template.
CONSTANT_SHARE, CONSTANT_PAGES = 0.8, 5
#: Share of the article's text from which a slot inside it counts where no element name tells.
SHARE = 0.1

# Element names of HTML and words of class, id and role that mark what is no article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "option", "button"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "em", "font", "i", "ins", "del", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CONTAINER = {"html", "head", "body", "nav", "header", "footer", "aside", "main", "article", "section", "div", "form", "ul", "ol", "dl", "table", "figure", "details", "dialog", "fieldset", "blockquote", "menu", "search"}
OUTSIDE = {"nav", "footer", "aside", "form", "head", "dialog", "menu", "search"}
HEADING = {"h1", "h2", "h3"}
MARKS = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-?bar|cookies?|consent|gdpr|notice|notices|alert|popup|pop-?up|modal|overlay|comments?|respond|replies|disqus"
    r"|menu|navbar|navigation|nav|breadcrumbs?|pagination|pager|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|sign-?up|login|search|masthead|topbar"
    r"|site-?header|page-?header|site-?footer|page-?footer|footer|header|widget|toolbar|skip-?link|contentinfo|complementary)(?:$|[-_\s])",
    re.I,
)

#: A quoted value may hold < and >; a tag without an end ends before the next <. Nothing
#: is tried twice: a quote is taken as a plain character only if no other follows.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|(?=<)|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")
#: Flags of a token.
BLOCK, TEXT, AWAY, ARTICLE, OPENS, MAIN = 1, 2, 4, 8, 16, 32


class Node(NamedTuple):
    """An open container: a hash of its path, the token that opened it, whether it (or
    what encloses it) is marked as no article, and whether it lies in an article
    element (2), in a main element only (1) or in neither (0)."""

    name: str
    path: str
    token: int
    away: bool
    article: int
    plain: dict  # children without attributes so far, by name


def token_of(text: bool, path: str, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{text}|{path}|{name}".encode("utf-8", "replace")) - (1 << 63)


def events(page: str):
    """(kind, name, token, node, opened, text) of each token in page order: kind
    'tag', 'block' (a block ends here) or 'text'; node is the container around it,
    opened the one that it opens. The path holds containers only, so unclosed
    paragraphs and inline tags do not change it; digits in class and id are left
    out of it, and containers without attributes are told by their number."""
    node = Node("", "", 0, False, 0, {})
    stack, open_names = [node], Counter()
    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else size
        if stop > at:
            text = page[at:stop]
            plain = " ".join(text.split())
            yield "text", plain, token_of(True, node.path, plain) if plain else 0, node, None, text
        if not found:
            break
        at = found.end()
        name = (found.group(2) or "").lower()
        if not name:
            continue
        if found.group(1):
            if name in CONTAINER and open_names[name]:
                closed = ""
                while closed != name:
                    closed = stack.pop().name
                    open_names[closed] -= 1
                node = stack[-1]
            inline = name in INLINE
            yield ("tag" if inline else "block"), "/" + name, 0 if inline else token_of(False, node.path, "/" + name), node, None, ""
            continue
        if name in RAW and not found.group(3).endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            yield ("tag" if name in ("svg", "math", "button", "select") else "block"), name, token_of(False, node.path, name), node, None, ""
            continue
        if name in INLINE:
            yield "tag", name, 0, node, None, ""
            continue
        if name not in CONTAINER:
            yield "block", name, token_of(False, node.path, name), node, None, ""
            continue
        marks = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(found.group(3))} if found.group(3) else {}
        label = name + "".join(f".{_DIGITS.sub('', marks[k])}" for k in ("id", "class", "role") if k in marks)
        if label == name:
            node.plain[name] = node.plain.get(name, 0) + 1
            label += f"~{node.plain[name]}" if node.plain[name] > 1 else ""
        said = " ".join(marks.get(k, "") for k in ("id", "class", "role"))
        level = 2 if name == "article" or marks.get("itemprop") == "articleBody" else 1 if name == "main" or marks.get("role") == "main" else 0
        inner = max(node.article, level)
        away = name in OUTSIDE or (name == "header" and not node.article) or (name not in ("html", "body", "article", "main") and bool(said and MARKS.search(said)))
        token = token_of(False, node.path, label)
        path = xxhash.xxh64_hexdigest(f"{node.path}/{label}".encode("utf-8", "replace"))
        opened = Node(name, path, token, node.away or away, inner, {})
        yield "block", label, token, node, opened, ""
        stack.append(opened)
        open_names[name] += 1
        node = opened


def tokens(page: str) -> dict[int, list[int]]:
    """Of each distinct token: times on the page, rank of the first, token of the
    container around it, flags, and characters (of a text, or of all text under
    the container that the token opens)."""
    told: dict[int, list[int]] = {}
    inside: dict[int, int] = {}
    for rank, (kind, _, token, node, opened, text) in enumerate(events(page)):
        if not token or kind == "tag":
            continue
        row = told.get(token)
        if row is None:
            near = opened or node
            flags = BLOCK | AWAY * near.away | ARTICLE * (near.article == 2) | MAIN * (near.article > 0) | OPENS * bool(opened)
            row = told[token] = [0, rank, node.token, TEXT if kind == "text" else flags, 0]
        row[0] += 1
        if kind == "text":
            row[4] += len(text)
            inside[node.token] = inside.get(node.token, 0) + len(text)
    for token in reversed(told):  # what is inside comes after the container
        if told[token][3] & OPENS:
            size = inside.get(token, 0)
            told[token][4] += size
            inside[told[token][2]] = inside.get(told[token][2], 0) + size
    return told


def host(url: Column) -> Column:
    """Lower-cased host of a URL without user and port; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


SUMS = ("pages", "times", "v1", "v2", "rank", "chars")


def vectors(pages: DataFrame) -> DataFrame:
    """(host, token, pages, times, v1, v2, rank, chars, parent, flags, low, high): of
    each token of a host the pages that hold it, its occurrences, two sums that
    stand for its occurrence vector (occurrences times a random number of the
    page), sums of its ranks and characters, the container around it, and the
    least and the greatest hash of the pages. Combined in each task and again by
    the shuffle."""

    def run(batches):
        for batch in batches:
            total: dict[tuple[str, int], list[int]] = {}
            for site, key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                content = xxhash.xxh64_intdigest((page or "").encode("utf-8", "replace")) - (1 << 63)
                r1, r2 = key & 0x3FFFFFFF, key >> 32 & 0x3FFFFFFF
                known = {0: [1, 0, 0, 0, 0]} | tokens(page or "")  # token 0 counts the pages
                for token, (times, rank, parent, flags, chars) in known.items():
                    row = total.get((site, token))
                    if row is None:
                        total[site, token] = [1, times, r1 * times, r2 * times, rank, chars, parent, flags, content, content]
                    else:
                        row[0] += 1
                        row[1] += times
                        row[2] += r1 * times
                        row[3] += r2 * times
                        row[4] += rank
                        row[5] += chars
                        if content < row[8]:
                            row[8] = content
                        if content > row[9]:
                            row[9] = content
            names = ["host", "token", *SUMS, "parent", "flags", "low", "high"]
            columns = [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), *(pa.array([v[k] for v in total.values()], pa.int64()) for k in range(10))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    key = F.xxhash64(F.col("page_id"), F.col("url"))
    given = pages.select(host(F.col("url")).alias("host"), key.alias("key"), F.col("html").cast("string").alias("html"))
    each = given.mapInArrow(run, "host string, token long, " + ", ".join(f"{c} long" for c in (*SUMS, "parent", "flags", "low", "high")))
    return each.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("parent").alias("parent"), F.max("flags").alias("flags"), F.min("low").alias("low"), F.max("high").alias("high"))


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, token, parent, flags, chars, place, skeleton, often): the tokens of each
    host's template. skeleton: the token is of the host's largest class of tokens
    that occur once on each page that holds them; place orders them. The rest are
    of classes nested in the skeleton's slots. often: a container on enough pages to be
    the template's where its texts are constant. Hosts with one page have no template."""
    seen = checkpoint(vectors(pages).where("token = 0 or pages >= 2"))  # pages are parsed once for all that follows
    whole = seen.where("token = 0").select(F.col("host").alias("site"), F.col("pages").alias("all"))
    often = seen.where("token != 0").join(whole, F.col("host") == F.col("site")).where(F.col("pages") >= support * F.col("all"))
    often = often.where((F.col("low") != F.col("high")) | (F.col("flags").bitwiseAND(TEXT) == 0))  # a text of one page and its copies is no constant
    kind = F.struct("pages", "times", "v1", "v2")
    constant = (F.col("flags").bitwiseAND(OPENS) != 0) & (F.col("pages") >= CONSTANT_PAGES) & (F.col("pages") >= CONSTANT_SHARE * F.col("all"))
    often = often.select("host", "token", "parent", "flags", "chars", kind.alias("kind"), (F.col("rank") / F.col("pages")).alias("place"), constant.alias("often"))
    classes = often.where("kind.pages = kind.times").groupBy("host", "kind").agg(F.count("*").alias("size"))
    top = classes.groupBy(F.col("host").alias("site")).agg(F.max(F.struct("size", "kind")).alias("top")).select("site", F.col("top.kind").alias("top"))
    return often.join(top, F.col("host") == F.col("site"), "left").select("host", "token", "parent", "flags", "chars", "place", F.coalesce(F.col("kind") == F.col("top"), F.lit(False)).alias("skeleton"), "often")


class Template:
    """What a host's template says: slots (tokens of the skeleton's containers), those
    that are kept, those whose headings are kept, boxes (containers of constant texts
    only) and constant texts."""

    def __init__(self, rows: list[dict]):
        by = {r["token"]: r for r in rows}
        self.constant = {r["token"] for r in rows if r["flags"] & TEXT}
        self.slots = {t for t, r in by.items() if r["skeleton"] and r["flags"] & OPENS}
        self.kept: set[int] = set()
        self.headings: set[int] = set()
        order = self._parents_first(by)
        fixed = dict.fromkeys(by, 0)  # characters of constants inside, which count for no slot
        for token in reversed(order):
            row = by[token]
            fixed[token] += row["chars"] * bool(row["flags"] & TEXT)
            if row["parent"] in fixed:
                fixed[row["parent"]] += fixed[token]
        varying = {t: by[t]["chars"] - fixed[t] for t in by}
        self.boxes = {t for t in by if by[t]["often"] and by[t]["chars"] and not varying[t]}
        own, near = {t: varying[t] for t in self.slots}, {}
        for token in order:
            above = near.get(by[token]["parent"])
            if token in self.slots and above is not None:
                own[above] -= varying[token]
            near[token] = token if token in self.slots else above
        main = None
        for named in (ARTICLE, MAIN, 0):  # slots in an article come first, then those in a main element
            rivals = [t for t in self.slots if by[t]["flags"] & named == named and not by[t]["flags"] & AWAY and own[t] > 0]
            main = max(rivals, key=lambda t: (own[t], -by[t]["place"]), default=None)
            if main is not None:
                break
        if main is None:
            self.slots = set()
            return
        top = at = main
        while named and at in by:
            top = at if by[at]["flags"] & named else top
            at = by[at]["parent"]
        below: set[int] = set()
        for token in order:
            if token == top or by[token]["parent"] in below:
                below.add(token)
                if token in self.slots and (token == main or (not by[token]["flags"] & AWAY and (named or own[token] >= SHARE * own[main]))):
                    self.kept.add(token)
        if not named and by[main]["parent"] in self.slots:
            self.headings.add(by[main]["parent"])

    @staticmethod
    def _parents_first(by: dict) -> list[int]:
        inner: dict[int, list[int]] = {}
        for token, row in by.items():
            inner.setdefault(row["parent"] if row["parent"] in by else 0, []).append(token)
        order, todo = [], list(inner.get(0, []))
        while todo:
            token = todo.pop()
            order.append(token)
            todo += inner.get(token, [])
        return order


def main_text(page: str, template: Template) -> str:
    """The main text of one page, given the template of its host.

    Texts of the kept slots count, but for the template's boxes. A page that holds
    nothing there has the text of its article elements, else of its main elements;
    without those, what no name marks and no template holds."""
    found: tuple[list[str], ...] = ([], [], [], [], [])  # kept slots, with boxes, articles, main elements, the rest
    block: list[tuple[str, int]] = []  # texts of the open block, and what they belong to: bits for the lists above
    slot, heading, at_node = 0, False, None
    held: dict[int, int] = {0: 0}
    boxed: dict[int, bool] = {0: False}

    def close():
        for bit, told in enumerate(found):
            text = " ".join(html.unescape("".join(t for t, b in block if b >> bit & 1)).split())
            if text:
                told.append(text)
        block.clear()

    for kind, name, token, node, opened, text in events(page):
        if kind == "block":
            close()
            if opened:
                held[token] = token if token in template.slots else held.get(node.token, 0)
                boxed[token] = token in template.boxes or boxed.get(node.token, False)
            if name.lstrip("/") in HEADING:
                heading = name[0] != "/"
        elif kind == "text":
            if node is not at_node:
                close()
                at_node, slot = node, held.get(node.token, 0)
            if not name:
                if block:
                    block.append((" ", 31))
                continue
            bits = 0
            if not node.away:
                if slot in template.kept or (heading and slot in template.headings):
                    bits = 2 | (not boxed.get(node.token, False))
                bits |= 4 * (node.article == 2) | 8 * (node.article > 0) | 16 * (token not in template.constant)
            block.append((text, bits))
    close()
    return " ".join(next((x for x in found if x), []))


def extract(pages: DataFrame, support: float = SUPPORT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    Null or empty html, or a page without main text: text ''. A null url is of
    the host ''. Repeated rows give repeated results and count as pages of
    their host; an empty table gives no rows. Other columns are ignored.
    """
    row = F.struct("token", "parent", "flags", "chars", "place", "skeleton", "often")
    by = checkpoint(templates(pages, support).groupBy(F.col("host").alias("site")).agg(F.collect_list(row).alias("template")))
    rows = by.agg(F.sum(F.size("template"))).first()[0] or 0
    given = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    if rows <= broadcast_rows:
        joined = given.join(F.broadcast(by), F.col("host") == F.col("site"), "left")
    else:  # a host's pages go to SALTS tasks
        by = by.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        given = given.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = given.join(by, (F.col("host") == F.col("site")) & (F.col("salt") == F.col("s")), "left")
    joined = joined.select("page_id", "url", "html", "host", "template")

    def run(batches):
        kept: dict[str, Template] = {}
        for batch in batches:
            texts = []
            given_templates = batch.column(4)
            for i, (site, page) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if site not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    kept[site] = Template(given_templates[i].as_py() or [])
                texts.append(main_text(page or "", kept[site]))
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(size)], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op10(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
