"""HTML extraction: a wrapper per template of a host, a union-free regular expression inferred by alignment.

A page is read as a stream of block tags and text slots. Pages of a host are one template if all mark an
article, or a main element and no article, or if the same containers hold their text. The wrapper of a
template starts as its first page and is aligned with the next ones, level by level. What one side lacks becomes optional; a label
that returns among its siblings turns the span between into a repeated group; texts that differ
become slots, texts that never differ stay constants. Every level of a wrapper thus holds a label
once, and a template's wrapper stays small however many pages it has.

Tasks align the pages they read; the partial wrappers of a template are aligned in two rounds, so the
pages of one host never meet. A wrapper's slots know their text, link and page counts over all pages;
from these and the labels it is decided once per template which slots are the article.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import checkpointed
from .url_rules import url_host
from .words import slices

SLOT = "#"
_HOSTS_HELD = 2000
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
_NAMED = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW = frozenset("script style textarea title iframe".split())
#: elements that show no text of the page; an article inside an unclosed one of the second kind counts
_HIDDEN = frozenset("noscript template select datalist optgroup option svg".split())
_EMBEDDED = frozenset("object video audio canvas".split())
#: a block that starts inside one of these, without its end tag, ends it
_NO_BLOCKS = frozenset("select datalist optgroup option svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img "
                    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover "
                    "mmultiscripts mtable mtr mtd mspace semantics".split())
_SOURCE = re.compile(r"[^<]*</annotation\s*>", re.IGNORECASE)  # of a formula, which is not shown
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul menu details".split())
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select", "datalist", "optgroup"), "optgroup": ("select",)}

#: what an element's tag, or a word in its class, id or role, says of it
APART_TAGS = frozenset("head nav header footer aside form menu dialog button".split())
APART_WORDS = frozenset((
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar sidebars complementary menu nav navbar navigation breadcrumb "
    "breadcrumbs footer contentinfo masthead notice notices cookie cookies consent gdpr popup modal overlay dialog newsletter subscribe signup login search "
    "comment comments reply replies discussion disqus respond related recommended recommendations share sharing social widget widgets toolbar pagination pager hidden").split())
MAIN_WORDS = frozenset("article main".split())
_BODY = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre blockquote figcaption summary".split())
#: where the text of a container begins; the elements above make the template
_CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd pre blockquote figure address hr details summary hgroup".split())


#: what an element of a part is called beside the part itself, and what only says that a page has one
_PLACES = frozenset("area bar block body bottom box col column container content embed fixed footer form group header holder icons inline inner item items left link links list main new outer panel "
                    "primary region right row secondary section slot sticky top unit widget wrap wrapper zone".split())
_HAVING = frozenset("has with without no not is hide show show-no js supports enable enabled disable disabled".split())
#: elements that hold a page or an article whole, whatever else their classes say
_WHOLE = frozenset("html body article main".split())


def _telling(token: str) -> set[str]:
    """The word by which a class token or id names a part apart: itself, its last word, or its first before words of place."""
    words = [w.lower() for w in _WORDS.findall(token)]
    if len(words) == 1:
        return set(words) & (APART_WORDS | MAIN_WORDS)
    if not words or words[0] in _HAVING:
        return set()
    if words[-1] in APART_WORDS:
        return {words[-1]}
    if words[0] in APART_WORDS and all(w in _PLACES or w in APART_WORDS for w in words[1:]):
        return {words[0]}
    return set(words) & MAIN_WORDS


def _label(tag: str, attributes: str) -> str:
    """The tag and the telling words of its class, id and role."""
    if tag in _WHOLE or not attributes or attributes.isspace():
        return tag
    words = set()
    for name, *values in _NAMED.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                words.add("hidden")
        else:
            for token in value.split():
                words |= _telling(token)
    return ".".join((tag, *sorted(words)))


def segments(page: str | None) -> Iterator[tuple[tuple[str, ...], str, int, tuple[int, ...]]]:
    """(labels from the root, text, letters inside links, element numbers) of each block of text, in page order.

    Tolerant: an end tag closes the nearest open element of its name, or nothing; paragraphs and list
    items close as a browser closes them. Markup inside a block leaves no space. Only scripts, styles,
    titles, text areas and frames run to the end of the page when their end tag lacks.
    """
    page = page or ""
    stack: list[tuple[str, str, int]] = []
    names: Counter[str] = Counter()  # of the open elements, so that most searches of the stack are not made
    parts: list[str] = []
    linked = links = number = 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        n, linked = linked, 0
        return [(tuple(x[1] for x in stack), text, min(n, len(text)), tuple(x[2] for x in stack))] if text else []

    def shut(k: int) -> None:
        """Closes the open elements from the k-th on."""
        for x in stack[k:]:
            names[x[0]] -= 1
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at:m.start() if m else end]
        if piece:
            parts.append(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if tag in _INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        if tag.startswith("annotation"):
            source = None if closing else _SOURCE.match(page, at)
            at = source.end() if source else at
            continue
        yield from flush()
        links = 0
        if closing:
            if names[tag]:
                shut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else end
            continue
        if tag == "svg" and attributes.rstrip().endswith("/"):
            continue
        if tag in _CLOSES_P and any(names[x] for x in _NO_BLOCKS):
            k = next(i for i, x in enumerate(stack) if x[0] in _NO_BLOCKS)
            if not any(x[0] == "foreignobject" for x in stack[k:]):
                shut(k)
        if tag in _CLOSES_P and names["p"]:
            k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p")
            if not any(x[0] in ("table", "td", "button") for x in stack[k:]):
                shut(k)
        if tag in _SAME:
            alike = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if any(names[x] for x in alike):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _SAME[tag]:
                        break
                    if stack[k][0] in alike:
                        shut(k)
                        break
        number += 1
        names[tag] += 1
        stack.append((tag, _label(tag, attributes), number))
    yield from flush()


def mark(text: str) -> str:
    """A text in short, as 64 bits."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


class Wrapper:
    """A level of a union-free expression: labels in order, each once.

    ``kids`` maps a label to its level; ``optional`` and ``repeated`` are the labels that some pages
    lack and that return. A slot knows pages, letters, letters in links and its constants: the marks of
    the texts, with their lengths, that stand in it on every page. Siblings of one label share a slot, so
    this tells a constant menu or notice from the text beside it.
    """

    __slots__ = ("kids", "optional", "repeated", "slot", "pages")

    def __init__(self):
        self.kids: dict[str, Wrapper] = {}
        self.optional: set[str] = set()
        self.repeated: set[str] = set()
        self.slot: list | None = None
        self.pages = 0

    @staticmethod
    def of(blocks: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]]) -> Wrapper:
        """The expression of one page: what returns among siblings is folded into a repeated group."""
        root = Wrapper()
        root.pages = 1
        seen: dict[int, tuple[int, int]] = {}  # of a level: its parent's element and its own, last time
        for path, text, linked, numbers in blocks:
            node = root
            for depth, label in enumerate((*path, SLOT)):
                here = (numbers[depth - 1] if depth else 0, numbers[depth] if depth < len(path) else -1)
                if label not in node.kids:
                    node.kids[label] = Wrapper()
                    node.kids[label].pages = 1
                else:
                    before = seen[id(node.kids[label])]
                    if before[0] == here[0] and (before[1] != here[1] or label == SLOT):
                        # it comes again in the same parent: everything since its first place belongs to the group
                        names = list(node.kids)
                        node.repeated.update(names[names.index(label):])
                node = node.kids[label]
                seen[id(node)] = here
            if node.slot is None:
                node.slot = [1, 0, 0, {}]
            node.slot[1] += len(text)
            node.slot[2] += linked
            node.slot[3][mark(text)] = len(text)
        return root

    def align(self, other: Wrapper) -> Wrapper:
        """Both expressions in one, level by level. Order that differs makes a repeated group of what is between."""
        pairs = [(self, other)]
        while pairs:
            left, right = pairs.pop()
            pairs += left._align_level(right)
        return self

    def _align_level(self, other: Wrapper) -> list[tuple[Wrapper, Wrapper]]:
        """Aligns one level; returns the pairs of levels below that both have."""
        mine, theirs = list(self.kids), list(other.kids)
        merged: list[str] = []
        placed: set[str] = set()
        rest = iter(mine)
        known = set(mine)
        for label in theirs:
            if label not in known:
                merged.append(label)
                placed.add(label)
                continue
            if label in placed:  # it came earlier on this side
                self.repeated.update(merged[merged.index(label):])
                continue
            for own in rest:
                merged.append(own)
                placed.add(own)
                if own == label:
                    break
        merged.extend(rest)
        kids, below = {}, []
        for label in merged:
            a, b = self.kids.get(label), other.kids.get(label)
            if a is None or b is None:
                self.optional.add(label)
            else:
                below.append((a, b))
            kids[label] = a or b
        self.optional |= other.optional
        self.repeated |= other.repeated
        self.kids = kids
        self.pages += other.pages
        if self.slot is None:
            self.slot = other.slot
        elif other.slot is not None:
            both = {m: n for m, n in self.slot[3].items() if m in other.slot[3]}
            self.slot = [*(x + y for x, y in zip(self.slot[:3], other.slot[:3], strict=True)), both]
        return below

    def levels(self) -> Iterator[tuple[int, str, int, Wrapper]]:
        """(parent's number, label, depth, level) of every level in page order; the root is number 0 and its own parent."""
        todo, number = [(0, "", 0, self)], 0
        while todo:
            parent, label, depth, node = todo.pop()
            yield parent, label, depth, node
            todo += [(number, k, depth + 1, v) for k, v in reversed(node.kids.items())]
            number += 1

    def pack(self) -> list:
        """Flat: pages, slot, optional and repeated labels of each level, behind its parent's number and its label."""
        return [[parent, label, node.pages, node.slot, sorted(node.optional), sorted(node.repeated)] for parent, label, _, node in self.levels()]

    @staticmethod
    def unpack(data: list) -> Wrapper:
        nodes: list[Wrapper] = []
        for parent, label, pages, slot, optional, repeated in data:
            node = Wrapper()
            node.pages, node.slot, node.optional, node.repeated = pages, slot, set(optional), set(repeated)
            if nodes:
                nodes[parent].kids[label] = node
            nodes.append(node)
        return nodes[0]

    def expression(self) -> str:
        """The wrapper as text: ``( )+`` repeats, ``( )?`` may lack, ``#`` is a slot."""
        written: dict[int, str] = {}
        for _, _, _, node in reversed(list(self.levels())):
            out, group = [], []
            for label, kid in node.kids.items():
                item = SLOT if label == SLOT else f"<{label}>{written.pop(id(kid))}</{label}>"
                if label in node.optional:
                    item = f"({item})?"
                if label in node.repeated:
                    group.append(item)
                    continue
                if group:
                    out.append(f"({''.join(group)})+")
                    group = []
                out.append(item)
            if group:
                out.append(f"({''.join(group)})+")
            written[id(node)] = "".join(out)
        return written[id(self)]


def _apart(path: tuple[str, ...]) -> bool:
    """Is the slot inside something that is not the article? Headings in an article's own header stay."""
    inside = False
    for k, label in enumerate(path):
        tag, *words = label.split(".")
        inside = inside or tag in ("article", "main")
        if any(w in APART_WORDS for w in words):
            return True
        if tag == "header" and inside and any(re.fullmatch(r"h[1-6]", x.split(".")[0]) for x in path[k + 1:]):
            continue
        if tag in APART_TAGS or tag in _HIDDEN:
            return True
        if tag in _EMBEDDED and not any(x.split(".")[0] in ("article", "main") for x in path[k + 1:]):
            return True
    return False


def _marks(path: tuple[str, ...], name: str) -> bool:
    """Is a slot inside an element whose tag or telling word is ``name``?"""
    return any(name in label.split(".") for label in path)


def template(blocks: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]]) -> str:
    """The page's template: ``article`` or ``main`` if it marks one, else a hash of the containers that hold its text."""
    paths = {b[0] for b in blocks}
    rest = [p for p in paths if not _apart(p)]
    for name in ("article", "main"):
        if any(_marks(p, name) for p in rest):
            return name
    held = {p[:next((k for k, label in enumerate(p) if label.split(".")[0] in _CONTENT), len(p))] for p in rest}
    return hashlib.md5("\n\n".join(sorted("\n".join(p) for p in held)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def article_paths(wrapper: Wrapper) -> dict[str, list[str]]:
    """The slots of a template's wrapper that make up the article, as joined paths, each with the marks of its notices.

    What stands apart by its labels goes. If the template marks articles, slots outside go; else the
    main element; else the element that holds most of the text that is not links. In it, a text
    that stands outside headings and body blocks on every page of several is a notice, unless such texts are half of all.
    A text in a paragraph, list item or cell stays, the same on all pages or not.
    """
    found: list[tuple[tuple[str, ...], list, int]] = []
    above, labels, path = [], [], []
    for parent, label, depth, node in wrapper.levels():
        del path[max(0, depth - 1):]
        if depth:
            path.append(label)
        if label == SLOT and depth:
            found.append((tuple(path[:-1]), node.slot, parent))
        above.append(parent)
        labels.append(label)
    rest = [x for x in found if not _apart(x[0])]
    for name in ("article", "main"):
        marked = [x for x in rest if _marks(x[0], name)]
        if marked:
            rest = marked
            break
    else:
        # text that is not links, of every element on the way to a slot
        weight: dict[int, int] = {}
        below: dict[int, set[int]] = {}
        for _, slot, at in rest:
            while True:
                weight[at] = weight.get(at, 0) + slot[1] - 2 * slot[2]
                if not at:
                    break
                below.setdefault(above[at], set()).add(at)
                at = above[at]
        root = 0
        while True:  # down to the smallest element with nearly all of the text
            best = max(sorted(below.get(root, ()), key=lambda k: labels[k]), key=weight.__getitem__, default=None)
            if best is None or weight[best] < 0.7 * weight[root] or labels[best].split(".")[0] in ("p", "li", "pre", "td", "h1"):
                break
            root = best

        def inside(at: int) -> bool:
            while at > root:  # a level's number is larger than its parent's
                at = above[at]
            return at == root

        rest = [x for x in rest if 2 * x[1][2] <= x[1][1] and inside(x[2])]
    rest = [(p, s) for p, s, _ in rest]
    out: dict[str, list[str]] = {"\n".join(p): [] for p, _ in rest}
    # what differs in a slot; one that some pages lack is no constant
    fixed = {p: s[3] if s[0] == wrapper.pages else {} for p, s in rest}
    total = sum(s[1] for _, s in rest)
    notices = [(p, s) for p, s in rest if fixed[p] and not any(x.split(".")[0] in _BODY for x in p)]
    # copies of one page say nothing: something in the article must differ between pages
    differs = any(s[1] > s[0] * sum(s[3].values()) for p, s in rest)
    if differs and sum(s[0] * sum(fixed[p].values()) for p, s in notices) < 0.5 * total:
        out |= {"\n".join(p): sorted(fixed[p]) for p, _ in notices}
    return out


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, wrapper) for each template of each host of ``pages`` (host, html): the wrapper packed as JSON."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Wrapper] = {}

        def out() -> pa.RecordBatch:
            rows = [[h for h, _ in held], [t for _, t in held], [json.dumps(w.pack()) for w in held.values()]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in rows], ["host", "template", "wrapper"])

        for batch in slices(batches, "html"):
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = list(segments(page))
                at, own = (host, template(blocks)), Wrapper.of(blocks)
                held[at] = held[at].align(own) if at in held else own
                if len(held) > _HOSTS_HELD:
                    yield out()
        if held:
            yield out()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out = None
        for text in sorted(rows["wrapper"]):
            one = Wrapper.unpack(json.loads(text))
            out = one if out is None else out.align(one)
        return pd.DataFrame({"host": rows["host"].iloc[:1], "template": rows["template"].iloc[:1], "wrapper": [json.dumps(out.pack())]})

    kind = "host string, template string, wrapper string"
    parts = pages.select("host", "html").mapInArrow(read, kind)
    parts = parts.groupBy("host", "template", F.pmod(F.xxhash64("wrapper"), F.lit(64)).alias("_part")).applyInPandas(merge, kind)
    return parts.groupBy("host", "template").applyInPandas(merge, kind)


def extract_articles(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the main text by the wrapper of its host and template.

    Character references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined by one space in page order. A null or empty page, and one without an article,
    gives an empty text. A page of which the template's wrapper keeps nothing, though it marks no article,
    is judged alone; so are pages whose url is null or names no host, which share no site.
    Repeated rows come back each; a null key stays null. An empty table gives no rows. Other columns
    are not read.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    rows = rows.withColumn("host", F.nullif(url_host(F.col("url")), F.lit("")))
    wrappers = checkpointed(infer_wrappers(rows.filter("host IS NOT NULL")).select("host", "template", _chosen("wrapper").alias("paths")))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            named = [None if h is None else template(list(segments(t))) for h, t in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string())], [*batch.schema.names, "template"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[str, dict[str, frozenset[str]]] = {}

        def kept(blocks, keep) -> str:
            where = ((keep.get("\n".join(p)), t) for p, t, *_ in blocks)
            return " ".join(t for notices, t in where if notices is not None and not (notices and mark(t) in notices))

        for batch in slices(batches, "html"):
            texts = []
            for page, name, paths in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                blocks = list(segments(page))
                if paths is not None and paths not in chosen:
                    if len(chosen) > _HOSTS_HELD:
                        chosen.clear()
                    chosen[paths] = {p: frozenset(notices) for p, notices in json.loads(paths).items()}
                text = kept(blocks, chosen[paths]) if paths is not None else ""
                if not text and blocks and name not in MAIN_WORDS:
                    text = kept(blocks, article_paths(Wrapper.of(blocks)))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    # a table of one row per template: Spark sends it to all tasks while its files are small, else joins by
    # shuffle, and adaptive execution splits a template with many pages
    rows = rows.mapInArrow(assign, "page_id long, url string, html string, host string, template string")
    return rows.join(wrappers, ["host", "template"], "left").select("page_id", "url", "html", "template", "paths").mapInArrow(read, "page_id long, url string, text string, n_chars long")


@F.pandas_udf(StringType())
def _chosen(wrapper: pd.Series) -> pd.Series:
    return wrapper.map(lambda w: json.dumps(article_paths(Wrapper.unpack(json.loads(w)))))
