"""Main text of web pages by wrapper induction: simple tree matching of same-host pages."""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, small
from textloom.llm.url_filter import url_host

#: A comment, a tag or a declaration.  Quoted values may hold a >; where quotes don't pair up to a > behind them, the tag ends at its first one.
#: Nothing that was matched is given back, so a tag costs time in proportion to its length.
TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+(?=>)|[^>]*+)>|<[!?][^>]*+>""", re.S)
#: What begins like a tag; without a > behind it the page was cut off inside it.
BEGUN = re.compile(r"<[/!?]?[A-Za-z!?-]")
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas, and what stands in for pictures and objects, are read as part of the line.
INLINE |= frozenset("canvas math mfrac mi mn mo mover mroot mrow ms msqrt mspace mstyle msub msubsup msup mtext munder object semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
RAW = frozenset("script style noscript template iframe svg audio video textarea title noframes noembed".split())
DROPPED = frozenset("head nav header footer aside button select menu dialog fieldset dialog".split())
#: Dropped unless they hold the main content.
FORMS = frozenset(("form",))
#: An opening tag of the first kind closes an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPES = frozenset("ul ol dl table body html article section div main td th".split())
#: Names in class or id of parts that are not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header menu nav navbar navigation newsletter notice notices popup promo promoted promotion related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split())
#: Words that a name may have beside those of MARKS; with any other (no-sidebar, header-fixed, section-header, share-price) it is no mark.
AFFIXES = frozenset("site global primary secondary top bottom left right inner outer wrap wrapper container box bar block area list links items buttons icons posts slot unit zone".split())
#: Classes of articles that are not the page's own.
ASIDES = frozenset("ad ads advert comment comments promo related replies reply sponsored".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CONTENT = frozenset(("article", "main"))
#: Different articles of a host from which on a slot that hardly ever changes is template.
LEAST_PAGES = 5
#: Share of a slot's articles that its commonest text stands beside, from which on the slot is template.
SHARE = 0.9
#: Skeletons of a host that match in this share of their nodes share a wrapper.
SIMILAR = 0.7
#: Skeletons of a host among which wrappers are looked for in a first round; each round doubles them.
FIRST_LOOK = 64


class Node:
    __slots__ = ("label", "tag", "kids", "hard", "soft", "dropped", "core", "main", "slot")

    def __init__(self, label: str, tag: str, hard: bool, soft: bool, core: bool, up: Node | None):
        # hard, soft and core are of the element itself: dropped by its tag, role or hiding; a form or
        # dropped by a name; article or main.  dropped and main count what it lies in, too.
        self.label, self.tag, self.kids, self.hard, self.soft, self.core, self.slot = label, tag, [], hard, soft, core, -1
        self.dropped = hard or soft or up is not None and up.dropped
        self.main = core or up is not None and up.main


@lru_cache(20_000)
def marked(name: str) -> bool:
    """Whether a class or id names a part that is not the article: sidebar, site-header, cookie-notice, ad_2."""
    parts = [x for x in re.split(r"[_-]+", name.lower()) if x and not x.isdigit()]
    return any(x in MARKS for x in parts) and all(x in MARKS or x in AFFIXES for x in parts)


def unwrap(root: Node, runs: list[tuple[Node, str]]) -> None:
    """Takes the mark off forms and marked names that hold the page's main content.

    That is an article or main element with more text than all that is kept of the page; or
    paragraphs, on a page without such elements of which nothing is kept.
    """
    order = [root]
    for n in order:
        order.extend(n.kids)
    sizes: Counter[int] = Counter()
    left = 0
    for n, t in runs:
        size = len(t.strip())
        sizes[id(n)] += size
        left += 0 if n.dropped else size
    bare = not left and not any(n.core for n in order)
    # Text of each element, and the most in one article of it, less what stays dropped inside.
    total, most = {}, {}
    for n in reversed(order):
        kids = [k for k in n.kids if not (k.hard or k.soft)]
        total[id(n)] = sizes[id(n)] + sum(total[id(k)] for k in kids)
        most[id(n)] = total[id(n)] if n.core or bare and n.tag == "p" else max((most[id(k)] for k in kids), default=0)
        if n.soft and most[id(n)] > left:
            n.soft = False
    root.dropped = False
    for n in order:
        for k in n.kids:
            k.dropped = n.dropped or k.hard or k.soft


def parse(html: str) -> tuple[Node, list[tuple[Node, str]], bool]:
    """(root, text runs in page order, whether text of an article or main element is kept); a run of ' ' separates blocks."""
    root = Node("#", "#", False, False, False, None)
    stack, runs, at, lost = [root], [], 0, False
    # Open elements by tag: the stack is searched only for what is in it, so deep pages take no quadratic time.
    opened: Counter[str] = Counter()
    find = TAG.search
    # A page that was cut off inside a tag ends before it.
    if (begun := BEGUN.search(html, html.rfind(">") + 1)) is not None:
        html = html[: begun.start()]

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    while (m := find(html, at)) is not None:
        if m.start() > at:
            runs.append((stack[-1], html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            continue
        runs.append((root, " "))
        if m[1]:
            if tag in VOID or not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in VOID or m[3].endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        # An open paragraph ends where a block begins, as do the items that this tag follows.
        if opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if (closes := CLOSES.get(tag)) and any(opened[x] for x in closes):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        up = stack[-1]
        # An article's own header holds its headline.
        label, hard, soft, core = tag, tag in DROPPED and not (tag == "header" and up.main), tag in FORMS, tag in CONTENT
        if m[3]:
            marks = {}
            for a in ATTR.finditer(m[3]):
                marks[a[1].lower()] = a[2] or a[3] or a[4] or ""
            if names := marks.get("class", "").split():
                label = f"{tag}.{re.sub(r'[^A-Za-z_-]', '', names[0])}"
            if tag not in ("html", "body", "article", "main"):
                hard = hard or marks.get("role", "").lower() in ROLES or "hidden" in marks or marks.get("aria-hidden") == "true"
                soft = soft or any(map(marked, (*names, *marks.get("id", "").split())))
            elif tag == "article":
                hard = hard or bool({x.lower() for x in names} & ASIDES)
            core = core or marks.get("role", "").lower() in CONTENT
        node = Node(label, tag, hard, soft, core, up)
        lost = lost or core and node.dropped
        up.kids.append(node)
        stack.append(node)
        opened[tag] += 1
    if at < len(html):
        runs.append((stack[-1], html[at:]))
    if lost or all(n.dropped or t.isspace() for n, t in runs):
        unwrap(root, runs)
    return root, runs, any(n.main and not n.dropped and not t.isspace() for n, t in runs)


def skeleton(root: Node) -> str:
    """The tree's labels, repeated neighbours as one; numbers each node's slot in preorder.

    Menus, headers and the like are in it: whether they are template is for the alignment to say, whatever they are called.
    """
    out: list[str] = []
    count = 0
    todo: list = [[root]]
    while todo:
        group = todo.pop()
        if group is None:
            out.append(")")
            continue
        for n in group:
            n.slot = count
        count += 1
        out.append(group[0].label)
        merged: list[list[Node]] = []
        for n in group:
            for kid in n.kids:
                if merged and merged[-1][0].label == kid.label:
                    merged[-1].append(kid)
                else:
                    merged.append([kid])
        out.append("(")
        todo.append(None)
        todo.extend(reversed(merged))
    return " ".join(out)


@lru_cache(4096)
def _tree(text: str) -> tuple:
    """(label, slot, kids, shape, size) of a skeleton; equal subtrees have equal shapes."""
    stack: list[tuple] = []
    count, root = 0, None
    for token in text.split(" "):
        if token == "(":
            continue
        if token == ")":
            label, slot, kids = stack.pop()
            done = (label, slot, kids, _digest(f"{label} {[k[3] for k in kids]}"), 1 + sum(k[4] for k in kids))
            if stack:
                stack[-1][2].append(done)
            else:
                root = done
        else:
            stack.append((token, count, []))
            count += 1
    return root


#: Cells of a table of one matching; longer lists of siblings are halved.
MOST_CELLS = 1 << 20


def _scores(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(len(a) + 1, len(b) + 1): weights of the best order-preserving matchings of all beginnings of two lists."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i, x in enumerate(a):
        np.maximum(best[i, 1:], best[i, :-1] + weight[x, b], out=best[i + 1, 1:])
        np.maximum.accumulate(best[i + 1], out=best[i + 1])
    return best


def _last_scores(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The last row of _scores, without the others."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + weight[x, b])
        np.maximum.accumulate(row, out=row)
    return row


def matched(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of an order-preserving matching of two lists with the greatest weight; the lists hold rows and columns of weight.

    Long lists are halved where the two halves' matchings weigh most together, so memory stays in
    proportion to the lists.
    """
    if not len(a) or not len(b):
        return []
    if len(a) > 1 and len(a) * len(b) > MOST_CELLS:
        half = len(a) // 2
        cut_ = int(np.argmax(_last_scores(a[:half], b, weight) + _last_scores(a[half:][::-1], b[::-1], weight)[::-1]))
        return matched(a[:half], b[:cut_], weight) + [(i + half, j + cut_) for i, j in matched(a[half:], b[cut_:], weight)]
    best, pairs, i, j = _scores(a, b, weight), [], len(a), len(b)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _same_ends(x: list[tuple], y: list[tuple]) -> tuple[int, int]:
    """How many equal subtrees two lists of siblings begin and end with.

    To match these with each other is best: no other partner gives such a subtree more, and order allows no second one across it.
    """
    most = min(len(x), len(y))
    first = next((i for i in range(most) if x[i][3] != y[i][3]), most)
    last = next((i for i in range(most - first) if x[-1 - i][3] != y[-1 - i][3]), most - first)
    return first, last


@lru_cache(20_000)
def align(a: str, b: str) -> dict[int, int]:
    """Simple tree matching: the largest order-preserving matching of two skeletons, slot of a -> slot of b.

    Subtrees are matched by shape, so that repeated ones are matched once.
    """
    top = (_tree(a), _tree(b))
    if top[0][0] != top[1][0]:
        return {}
    # Of each pair of shapes: the size of their matching and the matched pairs of kids.
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    # Pairs are matched below before they are matched themselves, on a list: no depth is too much.
    todo = [top]
    while todo:
        x, y = todo[-1]
        if (x[3], y[3]) in memo:
            todo.pop()
            continue
        if x[3] == y[3]:
            memo[x[3], y[3]] = (x[4], [(i, i) for i in range(len(x[2]))])
            todo.pop()
            continue
        first, last = _same_ends(x[2], y[2])
        rows, cols = x[2][first : len(x[2]) - last], y[2][first : len(y[2]) - last]
        kinds, others = {k[3]: k for k in rows}, {k[3]: k for k in cols}
        if below := [(p, q) for p in kinds.values() for q in others.values() if p[0] == q[0] and (p[3], q[3]) not in memo]:
            todo.extend(below)
            continue
        at, to = {s: i for i, s in enumerate(kinds)}, {s: i for i, s in enumerate(others)}
        weight = np.zeros((len(at), len(to)), np.int64)
        for p in kinds.values():
            for q in others.values():
                if p[0] == q[0]:
                    weight[at[p[3]], to[q[3]]] = memo[p[3], q[3]][0]
        pairs = matched(np.array([at[k[3]] for k in rows], np.int64), np.array([to[k[3]] for k in cols], np.int64), weight)
        pairs = [(i, i) for i in range(first)] + [(i + first, j + first) for i, j in pairs] + [(len(x[2]) - last + i, len(y[2]) - last + i) for i in range(last)]
        size = 1 + sum(x[2][i][4] if x[2][i][3] == y[2][j][3] else memo[x[2][i][3], y[2][j][3]][0] for i, j in pairs)
        memo[x[3], y[3]] = (size, pairs)
        todo.pop()
    found, todo = {}, [top]
    while todo:
        x, y = todo.pop()
        found[x[1]] = y[1]
        pairs = ((i, i) for i in range(len(x[2]))) if x[3] == y[3] else memo[x[3], y[3]][1]
        todo.extend((x[2][i], y[2][j]) for i, j in pairs)
    return found


@lru_cache(4096)
def _labels(text: str) -> Counter[str]:
    return Counter(x for x in text.split(" ") if x not in ("(", ")"))


def nearest(shape: str, found: tuple[str, ...]) -> int:
    """The wrapper that matches the skeleton best, the first of equals; -1 if none is SIMILAR."""
    best, at = 0.0, -1
    mine = _labels(shape)
    for i, w in enumerate(found):
        other = _labels(w)
        both = mine.total() + other.total()
        # No matching is larger than what the labels have in common.
        if 2 * (mine & other).total() / both >= max(SIMILAR, best) and (share := 2 * len(align(shape, w)) / both) >= SIMILAR and share > best:
            best, at = share, i
    return at


@lru_cache(20_000)
def places(shape: str, found: tuple[str, ...]) -> tuple[int, ...]:
    """The place in the host of each slot of a skeleton.

    A slot that aligns with one of the nearest wrapper is in its place; another one is in a place
    named by that of its parent and its label, so parts that the wrapper lacks have places as well.
    """
    at = nearest(shape, found)
    same = align(shape, found[at]) if at >= 0 else {}
    out: list[int] = []
    todo = [(_tree(shape), at)]
    while todo:
        (label, slot, kids, _, _), up = todo.pop()
        out.append(_digest(f"{at} {same[slot]}" if slot in same else f"{up}/{label}"))
        todo.extend((kid, out[-1]) for kid in reversed(kids))
    return tuple(out)


def slot_texts(runs: list[tuple[Node, str]]) -> dict[int, str]:
    """The text of each slot that has one; white space collapsed."""
    parts: dict[int, list[str]] = {}
    for node, text in runs:
        if text != " ":
            parts.setdefault(node.slot, []).append(text)
    return {s: t for s, p in parts.items() if (t := " ".join(" ".join(p).split()))}


def chosen(runs: list[tuple[Node, str]], has_main: bool, template: frozenset[int] = frozenset()) -> list[tuple[Node, str]]:
    """The runs outside dropped parts and template slots; of article and main elements alone where these hold most of that text."""
    left = [(n, t) for n, t in runs if t == " " or not n.dropped and n.slot not in template]
    if has_main:
        sizes = [0, 0]
        for n, t in left:
            sizes[n.main] += len(t.strip())
        if sizes[True] and sizes[True] >= sizes[False]:
            return [(n, t) for n, t in left if t == " " or n.main]
    return left


def main_text(root: Node, runs: list[tuple[Node, str]], has_main: bool, template: frozenset[int] = frozenset()) -> str:
    """The chosen runs; those with the template where nothing else is left."""
    found = ""
    for slots in (template, frozenset()) if template else (template,):
        found = " ".join("".join(entities.unescape(t) if "&" in t else t for _, t in chosen(runs, has_main, slots)).split())
        if found:
            break
    return found


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def evidence(runs: list[tuple[Node, str]], has_main: bool) -> list[tuple[int, int, int]]:
    """(slot, digest of its text, article) of the slots.

    The article is the digest of the longest other slot of the chosen ones: copies of one article, whatever
    menus and adverts stand beside them, are one article to each of its slots.
    """
    texts = slot_texts(runs)
    pool = slot_texts(chosen(runs, has_main))
    first, second = [*sorted(pool, key=lambda s: (-len(pool[s]), pool[s])), -1, -1][:2]
    digests = {s: _digest(t) for s, t in texts.items()}
    mine = {s: _digest(t) for s, t in pool.items()}
    return [(s, d, mine.get(second, d) if s == first else mine[first]) for s, d in digests.items()]


def layouts(shapes: DataFrame) -> DataFrame:
    """(host, wrappers): a JSON list of each host's wrappers, from its different skeletons (host, sid, shape, n).

    The commonest skeleton of a host is a wrapper, and so is each next one that is similar to no wrapper before it.
    A round looks at a bounded number of a host's skeletons and then drops, in all tasks, those that are
    similar to a wrapper of the round; rounds go on until no skeleton is left, so a host with
    very many skeletons is not one task's work.
    """
    look = FIRST_LOOK
    rest, rounds = shapes.select("host", "sid", "shape", "n"), []

    def lead(b: pd.DataFrame) -> pd.DataFrame:
        found: list[str] = []
        for shape in b.sort_values("rank")["shape"]:
            if nearest(shape, tuple(found)) < 0:
                found.append(shape)
        return pd.DataFrame({"host": b["host"].iloc[:1], "led": [json.dumps(found)]})

    def unlike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[nearest(x, _listed(w)) < 0 for x, w in zip(b["shape"], b["led"])]][["host", "sid", "shape", "n"]]

    while True:
        rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "sid"))
        led = cut(rest.withColumn("rank", rank).filter(F.col("rank") <= look).select("host", "shape", "rank").groupBy("host").applyInPandas(lead, "host string, led string"))
        rounds.append(led.withColumn("round", F.lit(len(rounds))))
        rest = cut(rest.join(small(led.select("host", "led"), led.count(), MOST_BROADCAST), "host").mapInPandas(unlike, "host string, sid long, shape string, n long"))
        if rest.isEmpty():
            break
        look *= 2
    one = reduce(DataFrame.unionAll, rounds).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("round", "led"))).alias("_all"))
    return one.select("host", F.to_json(F.flatten(F.transform("_all", lambda x: F.from_json(x["led"], "array<string>")))).alias("wrappers"))


@lru_cache(4096)
def _listed(wrappers: str) -> tuple[str, ...]:
    return tuple(json.loads(wrappers))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrappers, constant array<long>): each host's wrappers, one for each group of similar
    skeletons, and the places in them whose text hardly ever changes.

    Each page becomes the skeleton of its tree and a digest of the text in each slot, and is
    aligned with the nearest wrapper of its host by simple tree matching.  A place is constant if its commonest text
    stands beside at least LEAST_PAGES different articles, and beside SHARE of those that the
    place has any text beside; copies of an article count once.  All counts are combined before they are shuffled.
    """
    slim = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter[tuple] = Counter()
            for host, html in zip(b["host"], b["html"]):
                root, runs, has_main = parse(html or "")
                shape = skeleton(root)
                sid = _digest(shape)
                found[host, sid, shape, -1, 0, 0] += 1
                found.update((host, sid, None, *x) for x in evidence(runs, has_main))
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["host", "sid", "shape", "slot", "digest", "article", "n"])

    # Only the rows of slot -1 carry a skeleton; the others refer to its digest.
    keys = ["host", "sid", "shape", "slot", "digest", "article"]
    slots = cut(slim.mapInPandas(digest, "host string, sid long, shape string, slot int, digest long, article long, n long").groupBy(keys).agg(F.sum("n").alias("n")))
    shapes = slots.filter("slot = -1")
    found = cut(layouts(shapes))
    hosts = found.count()

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["places"] = [list(places(shape, _listed(w))) for shape, w in zip(b["shape"], b["wrappers"])]
            yield b[["host", "sid", "places"]]

    at = cut(shapes.join(small(found, hosts, MOST_BROADCAST), "host").select("host", "sid", "shape", "wrappers").mapInPandas(aligned, "host string, sid long, places array<long>"))
    placed = slots.filter("slot >= 0").join(small(at, at.count(), MOST_BROADCAST), ["host", "sid"]).select("host", F.expr("places[slot]").alias("place"), "digest", "article")
    # How many different articles stand beside each text of a place, and beside its commonest.
    counts = placed.distinct().groupBy("host", "place", "digest").count().groupBy("host", "place").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    fixed = (F.col("most") >= F.col("n") * SHARE) & (F.col("most") >= LEAST_PAGES)
    constant = counts.filter(fixed).groupBy("host").agg(F.collect_list("place").alias("constant"))
    return small(found, hosts, MOST_BROADCAST).join(constant, "host").select("host", "wrappers", "constant")


#: Wrappers that are broadcast at most, counted first; beyond, Spark shuffles and splits hot hosts.
MOST_BROADCAST = 20_000


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Slots of the page in constant places of its host's wrappers are template, unless nothing
    else is kept of the page.  The varying ones are content; only among these do tags, roles and names say what is not, that is navigation, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles, comments and hidden parts.  Article and main elements alone count where they hold
    most of the content.  A form or an element with such a name is no such part if it holds the main content.
    Character references are decoded, white space becomes one space, blocks are joined in page order by one space.

    Null or empty html gives empty text.  Pages without a host share the wrapper of the empty
    host.  Repeated rows are extracted one by one.  An empty table gives no rows.  Broken markup is read to its end; a tag
    in which the page was cut off is dropped.
    """
    found = cut(wrappers(pages, url_col, html_col).filter(F.size("constant") > 0))
    # The aliases avoid clashes with columns of the input.
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", url_host(F.col("url")))
    joined = slim.join(small(found, found.count(), MOST_BROADCAST), "host", "left").select("page_id", "url", "html", "wrappers", "constant")
    kind = slim.schema["page_id"].dataType.simpleString()

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for html, found, constant in zip(b["html"], b["wrappers"], b["constant"]):
                root, runs, has_main = parse(html or "")
                template: frozenset[int] = frozenset()
                if found:
                    fixed = set(constant)
                    template = frozenset(s for s, p in enumerate(places(skeleton(root), _listed(found))) if p in fixed)
                out.append(main_text(root, runs, has_main, template))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(x) for x in out]})

    return joined.mapInPandas(texts, f"page_id {kind}, url string, text string, n_chars long")
