"""HTML extraction by site template removal.

Every element subtree of every page is hashed. Counted by host in Spark, subtrees that recur on many pages of
their host are template: they are deleted before the text is taken. Hashes forgive what changes in a template from
page to page: attributes, scripts, and the form of the link to the page itself; outside of articles a second, loose
hash forgives numbers and dates too, unless the page would have no text left. Outside of
articles a block is template from a fixed number of different pages on, with a low share for very large hosts, so
that what belongs to one section, language or rotation goes too; parts of a text (headings, items, cells,
formatting) need a high share, since short ones recur by chance, and a page that would lose all its text keeps
these blocks, as it is a copy. Where a page marks its article (article, main, or their roles), the text is what is
inside, and there only subtrees on more than half of a host's pages count as template, so that copies of an article
aren't taken for it.

Besides, elements whose meaning the standard gives (scripts, styles, menus, headers, footers, asides, forms,
and their roles) are no text. Class names and ids are hints only: one counts if all of its words are on a list, never
for an article or its headings; ids count outside of articles alone. Readers' comments may stand in an article or call themselves articles,
under names of any other words: there a container goes by a single word in its class or id, unless the name tells whether an
article is open to comments. Notices of cookies go by their names anywhere. A page that would have no text left keeps the
largest of the forms and named elements that hold paragraphs or headings.

Counts are combined in each batch and before the shuffle, so a host with a third of all pages is no hot spot.
A host's template is bounded: subtrees on at least a share s of its pages number at most 1 / s times those of
an average page, and blocks on MIN_PAGES pages at most a fifth of all blocks. If all templates together are too
large to go out to every task, pages meet them by host, and hosts of more than a HOT_SHARE of all pages in as many
parts as that takes.

Null and empty pages have an empty text; cut and unbalanced markup is closed as browsers do for paragraphs,
list items, cells and formatting. Very long and hostile pages take time and space in proportion to their length. Null
urls have an empty host, which counts as one. A page row counts as often as it stands for shares, and rows of the same
content once for numbers. An empty table gives an empty result. Other columns pass through, whatever their names;
an earlier column of the output's name is replaced.
"""

from __future__ import annotations

import functools
import html
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.runtime import BROADCAST_BYTES, broadcast_if_small, map_rows, release, written

#: A subtree is template from so many pages of its host on, and from such a share of them.
MIN_PAGES, MIN_SHARE, MIN_SHARE_IN_ARTICLE = 5, 0.4, 0.5
#: Blocks outside of articles are from MIN_PAGES different pages on, and from such a share of the host's.
LOW_SHARE = 0.001
#: Hosts of so large a share of all pages are dealt in parts where pages meet templates by host.
HOT_SHARE = 0.001

TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", regex.S)
ATTRIBUTE = regex.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")

#: Elements by their part in a page.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
NOT_TEXT = frozenset("head nav aside footer button select option input dialog menu object canvas audio video map search".split())
ARTICLE = frozenset("article main".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ARTICLE_ROLES = frozenset("main article".split())
#: Words of class and id attributes, whole words between hyphens, underscores, capitals and spaces.
NOT_TEXT_NAMES = frozenset(
    "header nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager masthead topbar toolbar footer sidebar sidenav aside widget widgets rail "
    "notice notices notification alert cookie cookies consent gdpr privacy disclaimer paywall "
    "ad ads advert adverts advertisement advertising adsense adbox adunit banner sponsor sponsored promo promotion promoted "
    "form login signin signup subscribe subscription newsletter search searchbox "
    "comment comments commentlist respond reply replies disqus discussion "
    "share sharing social related recommended recommendations popup modal overlay skip".split()
)
#: Blocks that are parts of a text; they recur by chance.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th tr thead tbody tfoot caption figcaption summary legend".split())
#: Words that a name may have besides; with any other word it is no hint.
FRAME_NAMES = frozenset("area article bar block body box button buttons col column container content desktop entry fixed global group inner item items js link links list main mobile outer page panel post primary row secondary section site slot sticky text top bottom left right unit user wrap wrapper".split())
#: Readers' comments: a name with such a word marks a container of them, whatever its other words, but for those that tell an article's state.
COMMENT_NAMES, COMMENT_IDS = frozenset("comment comments commentlist commenter commenters disqus respond replies".split()), frozenset("comment comments commentlist disqus respond".split())
STATE_NAMES = frozenset("allowed closed count disabled enabled feed has hidden no number off on open opened without".split())
#: Words that notices of cookies and consent have besides.
CONSENT_NAMES, CONSENT_WORDS = frozenset("cookie cookies gdpr consent ccpa".split()), frozenset("accept bar compliance eu info law manager message policy preferences prompt settings statement warning".split())
#: Elements that hold other blocks.
CONTAINERS = frozenset("div section article ol ul li dl table center details".split())
#: Numbers with what may stand between them in dates and times, and the names of months between numbers, in the corpus's languages.
NUMBER = regex.compile(r"\d[\d.,:/-]*")
MONTHS = r"(?:jan|f[e\u00e9]v|feb|m[a\u00e4]r|a[pvb]r|ma[iy]|ju[nli]|a[ug][go]|ao[u\u00fb]|sep|o[kc]t|nov|d[e\u00e9i][zc]|ene)\p{L}*\.?"
NUMBER_MARK = "\x01"
DATE = regex.compile(rf"\x01\.? (?:de )?{MONTHS}(?: (?:de )?\x01)?|{MONTHS} \x01,? \x01", regex.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAME_PART = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: What an opening tag closes first, up to a limit element.
P_CLOSERS = BLOCK - {"body", "html"}
#: Blocks that a paragraph's end and an end tag of formatting don't reach through.
FRAME = BLOCK - {"p"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


#: Where a subtree stands.
PART, WHOLE, INSIDE = 0, 1, 2
#: Whether an element is text: yes, no, or only for want of other text.
TEXT, NEVER, SPARE = 0, 1, 2


class Node:
    """An element: its children are nodes, strings, and None for a line break."""

    __slots__ = ("children", "digest", "dropped", "in_article", "loose", "marked", "name", "weight")

    def __init__(self, name: str, dropped: int = TEXT, marked: bool = False, in_article: bool = False):
        self.name, self.dropped, self.marked, self.in_article = name, dropped, marked, in_article
        self.children: list[Node | str | None] = []
        self.digest, self.loose, self.weight = 0, 0, 0


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


@functools.lru_cache(4096)
def words_of(names: str) -> tuple[frozenset[str], ...]:
    """The words of each name, without numbers."""
    return tuple(frozenset(part.lower() for part in NAME_PART.findall(one) if not part.isdigit()) for one in names.split())


def for_readers(classes: str, ids: str) -> bool:
    """Whether a container's names say that it holds readers' comments, or a notice of cookies."""
    comments = any(w & kinds and not w & STATE_NAMES for kinds, names in ((COMMENT_NAMES, classes), (COMMENT_IDS, ids)) for w in words_of(names))
    return comments or any(w & CONSENT_NAMES and len(w) > 1 and w <= CONSENT_NAMES | CONSENT_WORDS | NOT_TEXT_NAMES | FRAME_NAMES for w in words_of(f"{classes} {ids}"))


@functools.lru_cache(4096)
def named(names: str) -> bool:
    """Whether one of the names says by all of its words that an element is no text."""
    return any(w & NOT_TEXT_NAMES and w <= NOT_TEXT_NAMES | FRAME_NAMES for w in words_of(names))


def role_of(name: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """Whether an element is no text, and whether it marks an article."""
    given = attributes(attrs) if attrs and not attrs.isspace() else {}
    role = given.get("role", "").lower()
    marks = name in ARTICLE or role in ARTICLE_ROLES or given.get("itemprop") == "articleBody"
    if name in NOT_TEXT or "hidden" in given or given.get("aria-hidden") == "true" or name == "header" and not in_article:
        return NEVER, False
    hinted = name not in HEADINGS and (named(given.get("class", "")) or not in_article and named(given.get("id", "")))
    if name in CONTAINERS and for_readers(given.get("class", ""), given.get("id", "")):
        return SPARE, False
    if name == "form" or role in NOT_TEXT_ROLES or hinted and name not in ("html", "body") and not (marks and not in_article):
        return SPARE, False
    return TEXT, marks


def parse(page: str) -> Node:
    """The tree of a page, with each subtree's hash. Time grows with the page's length, however its tags are nested."""
    root = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name
    blocks: list[int] = []  # of the open blocks but paragraphs
    end = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            name = stack.pop().name
            places[name].pop()
            if name in FRAME:
                blocks.pop()

    def last(names) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    search, at = TOKEN.search, 0
    while match := search(page, at):
        if match.start() > end:
            stack[-1].children.append(page[end : match.start()])
        at = end = match.end()
        name = match.group(2)
        if not name:
            continue
        name = name.lower()
        if match.group(1):
            found = places[name][-1] if places[name] else 0
            if found and (name in BLOCK or found > max(last(("p",)), blocks[-1] if blocks else 0)):
                close(found)
            continue
        if name == "br":
            stack[-1].children.append(None)
            continue
        if name in RAW:
            tail = regex.compile(rf"</{regex.escape(name)}\b[^>]*(?:>|\Z)", regex.I).search(page, at) if not match.group().endswith("/>") else None
            stack[-1].children.append(Node(name, dropped=NEVER))
            if not match.group().endswith("/>"):
                at = end = tail.end() if tail else len(page)
            continue
        if name in P_CLOSERS and (found := last(("p",))) and found > (blocks[-1] if blocks else 0):
            close(found)
        if name in CLOSES and (found := last(CLOSES[name][0])) > last(CLOSES[name][1]):
            close(found)
        parent = stack[-1]
        dropped, marked = role_of(name, match.group(3), parent.in_article)
        node = Node(name, dropped, marked, parent.in_article or marked)
        parent.children.append(node)
        if name not in VOID and not match.group().endswith("/>"):
            places[name].append(len(stack))
            if name in FRAME:
                blocks.append(len(stack))
            stack.append(node)
    if end < len(page):
        stack[-1].children.append(page[end:])
    digest_tree(root)
    return root


def fixed(text: str) -> str:
    """A text without what changes from page to page of a site: numbers and dates."""
    return DATE.sub(NUMBER_MARK, NUMBER.sub(NUMBER_MARK, text)) if NUMBER.search(text) else text


def digest_tree(root: Node) -> None:
    """Hashes and text lengths of all subtrees, from their names, texts and children; no recursion, for deep pages.

    Formatting and links hash alike, as a menu's link to the page itself is often none. The loose hash leaves out numbers and dates.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    digest = xxhash.xxh64_intdigest
    for node in reversed(order):
        parts = ["~" if node.name in INLINE else node.name]
        loose = None  # made when it begins to differ
        for c in node.children:
            if isinstance(c, Node):
                part, freed = f"{c.digest:x}", f"{c.loose:x}"
                node.weight += c.weight
            elif c is None:
                part = freed = "\n"
            else:
                part = " ".join(c.split())
                freed = fixed(part)
                node.weight += len(part)
            if loose is None and part != freed:
                loose = parts.copy()
            parts.append(part)
            if loose is not None:
                loose.append(freed)
        node.digest = digest("\x00".join(parts).encode("utf-8", "replace")) >> 1
        node.loose = node.digest if loose is None else digest("\x00".join(loose).encode("utf-8", "replace")) >> 1


def subtrees(root: Node) -> dict[int, int]:
    """The hashes of a page's subtrees below its frame, and where each stands: INSIDE an article, else PART or WHOLE."""
    found: dict[int, int] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, Node):
                if child.name not in ("html", "body") and not child.marked:
                    place = INSIDE if child.in_article else WHOLE if child.name in BLOCK and child.name not in PARTS else PART
                    found[child.digest] = min(found.get(child.digest, INSIDE), place)
                    if place != INSIDE:
                        found[child.loose] = min(found.get(child.loose, INSIDE), place)
                todo.append(child)
    return found


def text_of(root: Node, template: frozenset[int] | set[int] = frozenset(), template_in_article: frozenset[int] | set[int] = frozenset(), loosely: bool = True) -> str:
    """The blocks of a page without template, joined by an empty line; loosely with loose hashes outside of articles too."""
    starts, todo = [], [root]
    while todo:  # the outermost marked elements, in page order
        node = todo.pop()
        if node.marked:
            starts.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    whole = not starts
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    for start in starts or [root]:
        walk: list[Node | str | None | bool] = [start]
        while walk:
            item = walk.pop()
            if item is False:
                flush()
            elif item is None:
                line.append(" ")
            elif isinstance(item, str):
                line.append(html.unescape(item))
            elif not item.dropped and item.digest not in template_in_article and not (whole and (item.digest in template or loosely and item.loose in template)):
                block = item.name in BLOCK or item.name == "hr"
                if block:
                    flush()
                    walk.append(False)
                walk += reversed(item.children)
        flush()
    return "\n\n".join(blocks)


def spare(root: Node) -> bool:
    """Takes the largest of the outermost forms and named elements that hold paragraphs or headings for text; whether there is one."""
    best, todo = None, [root]
    while todo:
        node = todo.pop()
        if node.dropped == SPARE:
            if (best is None or node.weight > best.weight) and holds_text(node):
                best = node
        elif not node.dropped:
            todo += [c for c in node.children if isinstance(c, Node)]
    if best is not None:
        best.dropped = TEXT
    return best is not None


def holds_text(root: Node) -> bool:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.name == "p" or node.name in HEADINGS or node.marked:
            return True
        todo += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    return False


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def template_hashes(df: DataFrame, url: str = "url", page: str = "html", min_pages: int = MIN_PAGES, share: float = MIN_SHARE, share_in_article: float = MIN_SHARE_IN_ARTICLE, low_share: float = LOW_SHARE) -> tuple[DataFrame, DataFrame]:
    """(host, outside, recurring, inside), the hashes of each host's template, outside of articles by share and by number of pages, and inside; and (of, pages), the hosts' pages."""
    rows = df.select(host_of(F.col(url)).alias("host"), F.col(page).alias("page")).withColumn("content", F.xxhash64("page"))
    copies = written(rows.groupBy("host", "content").agg(F.count("*").alias("copies")).where("copies > 1").select(F.col("host").alias("__host"), F.col("content").alias("__content"), "copies"))
    rows = rows.join(broadcast_if_small(copies, 128), (F.col("host") == F.col("__host")) & (F.col("content") == F.col("__content")), "left")

    def count(batches):
        release()
        for batch in batches:
            seen: dict[tuple[str, int], Counter] = defaultdict(Counter)
            for host, content, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[host, copies].update((0, PART) if h is None else h for h in [None, *subtrees(parse(content or "")).items()])
            made = [(host, *key, n, n / copies) for (host, copies), counts in seen.items() for key, n in counts.items()]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], kind) for i, kind in enumerate(kinds)], ["host", "h", "place", "n", "different"])

    counted = rows.select("host", "page", F.coalesce("copies", F.lit(1)).alias("copies")).mapInArrow(count, "host string, h long, place int, n long, different double")
    counted = written(counted.groupBy("host", "h", "place").agg(F.sum("n").alias("n"), F.round(F.sum("different"), 3).alias("different")))
    pages = counted.where("h = 0").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    often = counted.where((F.col("h") != 0) & (F.col("n") >= min_pages)).join(pages, F.col("host") == F.col("of"))
    common = F.col("n") > F.col("pages") * F.when(F.col("place") == INSIDE, share_in_article).otherwise(share)
    recurs = (F.col("place") == WHOLE) & (F.col("different") >= F.greatest(F.lit(min_pages), F.col("pages") * low_share))
    often = often.withColumn("common", common).where(F.col("common") | recurs)
    hashes = lambda when: F.collect_set(F.when(when, F.col("h")))
    outside = F.col("place") != INSIDE
    return often.groupBy("host").agg(hashes(outside & F.col("common")).alias("outside"), hashes(outside & ~F.col("common")).alias("recurring"), hashes(~outside).alias("inside")), pages


def main_text(page: str, outside: np.ndarray, recurring: np.ndarray, within: np.ndarray) -> str:
    """The text of a page without its host's template (sorted hashes)."""
    root = parse(page)
    own = np.fromiter(subtrees(root), np.int64)

    def met(hashes: np.ndarray) -> set[int]:
        if not len(hashes):
            return set()
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        return set(own[hashes[at] == own].tolist())

    always, more, inner = met(outside), met(recurring), met(within)
    # a page that would have no text left is like others of its host but for a number, or a copy, or is marked wrongly
    return text_of(root, always | more, inner) or text_of(root, always | more, inner, False) or (more and text_of(root, always, inner, False)) or (text_of(root, always | more, inner) if spare(root) else "")


def host_parts(pages: DataFrame) -> DataFrame:
    """of, parts: for the hosts of at least a HOT_SHARE of all pages (of, pages) in how many parts they are dealt; at most 1 / HOT_SHARE rows."""
    total = pages.agg(F.sum("pages")).first()[0] or 0
    share = F.col("pages") / F.lit(max(1.0, total * HOT_SHARE))
    return pages.where(share >= 1).select("of", F.ceil(share).cast("int").alias("parts"))


def extract(df: DataFrame, url: str = "url", page: str = "html", text: str = "text", drop_page: bool = False, counted: bool = True) -> DataFrame:
    """df with the main text of each page. Without `counted` no template is looked for, to show what the counts do."""
    kinds = ["outside", "recurring", "inside"]
    found, pages = template_hashes(df if counted else df.limit(0), url, page)
    templates = written(found.select("host", *(F.sort_array(k).alias(k) for k in kinds)))
    size = templates.agg(F.sum(64 + 8 * sum(F.size(k) for k in kinds))).first()[0] or 0
    rows = df.withColumn("__host", host_of(F.col(url)))
    none = np.empty(0, np.int64)
    if size <= BROADCAST_BYTES:  # a host's hashes go out once, not with each of its pages
        held = {r["host"]: tuple(np.array(r[k], np.int64) for k in kinds) for r in templates.collect()}
        held = df.sparkSession.sparkContext.broadcast(held)
        inputs = [page, "__host"]

        def start():
            return lambda pages, hosts: [[main_text(p, *held.value.get(h, (none, none, none))) if p else "" for p, h in zip(pages, hosts, strict=True)]]

    else:
        parts = F.broadcast(written(host_parts(pages)))
        templates = templates.join(parts, F.col("host") == F.col("of"), "left").select(F.col("host").alias("__of"), *(F.col(k).alias(f"__{k}") for k in kinds), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("__no"))
        parts = parts.select(F.col("of").alias("__hot"), F.col("parts").alias("__parts"))
        rows = rows.join(parts, F.col("__host") == F.col("__hot"), "left").withColumn("__part", F.pmod(F.xxhash64(page, url), F.coalesce("__parts", F.lit(1))).cast("int"))
        rows = rows.join(templates, (F.col("__host") == F.col("__of")) & (F.col("__part") == F.col("__no")), "left")
        inputs = [page, *(f"__{k}" for k in kinds)]

        def start():
            return lambda pages, *hashes: [[main_text(p, *(none if h is None else h for h in of)) if p else "" for p, *of in zip(pages, *hashes, strict=True)]]

    gone = ["__host", "__of", "__hot", "__part", "__parts", "__no", *(f"__{k}" for k in kinds), *([page] if drop_page else [])]
    return map_rows(rows, inputs, [T.StructField(text, T.StringType())], start, gone)
