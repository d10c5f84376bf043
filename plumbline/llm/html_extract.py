"""Main text of web pages: boosted trees score DOM nodes, and a decoding over the tree picks what stays.

Every element gets features of its subtree (text, links, tags), its attribute tokens, its depth and its
siblings. Boosted trees turn them into the log-odds that the subtree holds main text. The decoding finds
the labelling with the largest sum of scores in which everything below a dropped element is dropped too.
The trees are fitted on pages made up by ``made_up_pages``, whose main text is known.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import boosting
from plumbline.llm.common import bounded_batches
from plumbline.llm.dom import INLINE, Dom

#: Pages that the trees are fitted on.
TRAINING_PAGES = 1500
#: Elements that never hold the text of an article, whatever the scores.
NEVER = frozenset("#comment script style template noscript head title textarea select option button input iframe object svg canvas map audio video datalist".split())

TAG_KINDS = {
    "article": "article main", "menu": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset legend label dialog",
    "paragraph": "p", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd", "box": "div section center", "table": "table tbody thead tfoot tr td th",
    "link": "a", "quote": "blockquote pre code figure figcaption",
}
KIND = {tag: i for i, tags in enumerate(TAG_KINDS.values()) for tag in tags.split()}
#: Tokens of class, id and role attributes by what they speak for.
TOKENS = {
    "main": "article articlebody articletext main maincontent content contents post postbody entry story storybody text body blogpost hentry page prose news newsbody copy",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topnav subnav tabs pagination pager toc links toolbar",
    "head": "header head masthead banner topbar top logo branding site sitename hero",
    "foot": "footer foot bottom copyright legal colophon contentinfo imprint",
    "side": "sidebar side aside widget widgets rail complementary column secondary related recommended recommendations more trending popular teaser teasers archive tags tagcloud",
    "ad": "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner commercial dfp outbrain taboola",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message warning announcement disclaimer paywall subscribe subscription newsletter signup",
    "form": "form search login register input field contact survey poll feedback",
    "comment": "comment comments commentlist reply replies respond discussion disqus discuss reactions guestbook reviews thread responses reader readers",
    "share": "share sharing social follow like tweet facebook twitter author bio byline meta",
}
TOKEN_KINDS = {t: 1 << i for i, words in reversed(list(enumerate(TOKENS.values()))) for t in words.split()}
for _i, _words in enumerate(TOKENS.values()):
    for _t in _words.split():
        TOKEN_KINDS[_t] |= 1 << _i
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
MAIN_BIT, OTHER_BITS = 1, sum(1 << i for i in range(1, len(TOKENS)))


@lru_cache(20_000)
def token_bits(values: str) -> int:
    """Which kinds of tokens attribute values hold."""
    bits = 0
    for word in _WORD.findall(values):
        bits |= TOKEN_KINDS.get(word, 0)
        if word not in TOKEN_KINDS:
            for tail in ("nav", "menu", "footer", "header", "sidebar", "comments", "comment", "content", "article", "banner", "notice", "form", "list", "box"):
                if word.endswith(tail) or word.startswith(tail):
                    bits |= TOKEN_KINDS.get(tail, 0)
    return bits


class Page:
    """The elements that are decided on, with their features. Plain inline elements belong to what holds them."""

    def __init__(self, source: str):
        self.dom = dom = Dom(source)
        n = len(dom.tags)
        self.bits = [token_bits(dom.attribute_values(i)) if dom.attributes[i] else 0 for i in range(n)]
        self.node = list(range(n))
        for i in range(1, n):
            if dom.tags[i] in INLINE and dom.tags[i] != "a" and not self.bits[i] and not dom.hidden(i):
                self.node[i] = self.node[dom.parents[i]]
        self.nodes = [i for i in range(n) if self.node[i] == i]
        self.parent = [-1] + [self.node[dom.parents[i]] for i in range(1, n)]
        self.never = [dom.tags[i] in NEVER or dom.hidden(i) for i in range(n)]
        self._features()

    def _features(self) -> None:
        dom, parent = self.dom, self.parent
        n = len(dom.tags)
        own, stops, before = [0] * n, [0] * n, [-1] * n
        total = 0
        for element, text in dom.texts:
            if text is None:
                continue
            i = self.node[element]
            length = len(text) if text.strip() else 0
            if before[i] < 0:
                before[i] = total
            own[i] += length
            if length and not self.never[i]:
                total += length
                stops[i] += text.count(".") + text.count(",")
        text, links, marks, tags, paragraphs, items, mains, depth, order, kin, alike = (list(own), [0] * n, list(stops), [1] * n, *([0] * n for _ in range(7)))
        inside_main, inside_other, seen_before = [0] * n, [0] * n, [0] * n
        children: dict[int, list[int]] = {}
        running = 0
        first_text = [0] * n
        order_of_text: dict[int, int] = {}
        for element, t in dom.texts:
            i = self.node[element]
            if i not in order_of_text:
                order_of_text[i] = running
            if t is not None and not self.never[i]:
                running += len(t)
        for i in self.nodes:
            p = parent[i]
            if p >= 0:
                siblings = children.setdefault(p, [])
                order[i] = len(siblings)
                siblings.append(i)
                depth[i] = depth[p] + 1
                self.never[i] = self.never[i] or self.never[p]
                main = dom.tags[p] in ("article", "main") or (self.bits[p] & MAIN_BIT and not self.bits[p] & OTHER_BITS)
                other = self.bits[p] & OTHER_BITS or dom.tags[p] in ("nav", "header", "footer", "aside", "form")
                inside_main[i] = 1 if main else inside_main[p] and inside_main[p] + 1
                inside_other[i] = 1 if other else inside_other[p] and inside_other[p] + 1
            seen_before[i] = first_text[i] = order_of_text.get(i, -1)
        for i in reversed(self.nodes):
            tag = dom.tags[i]
            links[i] = text[i] if tag == "a" else links[i]
            if self.never[i]:
                text[i] = links[i] = marks[i] = 0
            p = parent[i]
            if p >= 0:
                text[p] += text[i]
                links[p] += links[i]
                marks[p] += marks[i]
                tags[p] += tags[i]
                paragraphs[p] += paragraphs[i] + (tag == "p" and text[i] > 0)
                items[p] += items[i] + (tag == "li")
                mains[p] += mains[i] + (tag in ("article", "main"))
                if first_text[i] >= 0 and (first_text[p] < 0 or first_text[i] < first_text[p]):
                    first_text[p] = first_text[i]
        for siblings in children.values():
            names = [dom.tags[c] for c in siblings]
            for c in siblings:
                kin[c], alike[c] = len(siblings), names.count(dom.tags[c])
        whole = max(1, total)
        rows = []
        n_kinds, n_tokens = len(TAG_KINDS), len(TOKENS)
        for i in self.nodes:
            kind, p = KIND.get(dom.tags[i], -1), parent[i]
            bits, up = self.bits[i], self.bits[p] if p >= 0 else 0
            t = text[i]
            row = [0.0] * (n_kinds + n_tokens)
            if kind >= 0:
                row[kind] = 1.0
            b = bits
            k = n_kinds
            while b:
                if b & 1:
                    row[k] = 1.0
                b >>= 1
                k += 1
            row += [
                t, t / whole, links[i] / (t + 1), marks[i] / (t + 1), t / tags[i], tags[i], paragraphs[i], t / (paragraphs[i] + 1), items[i], items[i] / tags[i], mains[i], own[i],
                depth[i], order[i], kin[i], alike[i], order[i] / (kin[i] + 1), max(0, first_text[i]) / whole, inside_main[i], inside_other[i],
                float(bool(up & MAIN_BIT)), float(bool(up & OTHER_BITS)), float(bool(bits & OTHER_BITS)), KIND.get(dom.tags[p], -1) if p >= 0 else -1, text[p] / whole if p >= 0 else 1,
            ]
            rows.append(row)
        self.features = rows

    def kept(self, scores: np.ndarray) -> list[bool]:
        """For each element whether it stays: the labelling of the largest total score in which no dropped element has one that stays below it."""
        n = len(self.dom.tags)
        stay, all_dropped = [0.0] * n, [0.0] * n
        for i, s in zip(self.nodes, scores.tolist(), strict=True):
            stay[i], all_dropped[i] = (-1e9, 0.0) if self.never[i] else (s, -s)
        best = list(stay)
        for i in reversed(self.nodes):
            p = self.parent[i]
            if p >= 0:
                best[p] += max(best[i], all_dropped[i])
                all_dropped[p] += all_dropped[i]
        keep = [False] * n
        keep[0] = True
        for i in self.nodes:
            p = self.parent[i]
            if p >= 0:
                keep[i] = keep[p] and not self.never[i] and best[i] >= all_dropped[i]
        return [keep[j] for j in self.node]

    def text(self, keep: list[bool]) -> str:
        """The texts that stay, white space as one blank, blocks joined by one blank."""
        return " ".join("".join(t if t is not None else " " for e, t in self.dom.texts if t is None or keep[e]).split())


# --- made-up pages -------------------------------------------------------------------------------

_MARK = "\ue000"


def made_up_pages(count: int, seed: int = 5) -> list[str]:
    """Pages of many designs; main text is marked by a private character in each of its words."""
    return [_made_up(random.Random(seed * 1_000_003 + i)) for i in range(count)]


def _made_up(r: random.Random) -> str:
    letters = "etaoinsrhldcumfpgwybvk"

    def words(n: int, mark: str = "") -> str:
        out = []
        for i in range(n):
            w = "".join(r.choices(letters, k=r.randint(1, 9)))
            out.append(mark + (w.capitalize() if not i else w) + (r.choice(",.;") if r.random() < 0.12 else ""))
        return " ".join(out) + ("." if n > 4 else "")

    def el(tag: str, inner: str, hint: str = "") -> str:
        inner = re.sub("</?p>", " ", inner) if tag == "p" else inner
        hint = f' {r.choice(["class", "id", "class"])}="{hint}"' if hint else ""
        return f"<{tag}{hint}>{inner}</{tag}>"

    def pick(kind: str) -> str:
        word = r.choice(TOKENS[kind].split())
        return r.choice([word, word, f"{word}-{r.choice(['box', 'wrap', 'inner', 'area', 'x1'])}", f"site-{word}", f"c{r.randint(1, 99)} {word}"])

    def links(n: int) -> str:
        return "".join(el("li", f'<a href="/{i}">{words(r.randint(1, 3))}</a>') for i in range(n))

    def menu(hinted: bool = True) -> str:
        style = r.random()
        inner = f"<ul>{links(r.randint(2, 9))}</ul>" if style < 0.7 else "".join(f'<a href="/{i}">{words(r.randint(1, 2))}</a> ' for i in range(r.randint(2, 8)))
        return el("nav", inner, pick("menu") if r.random() < 0.3 else "") if r.random() < 0.55 or not hinted else el(r.choice(["div", "div", "ul"]), inner, pick("menu"))

    def said(lo: int, hi: int) -> str:
        return words(r.randint(lo, hi))

    def other(kind: str) -> str:
        long = said(3, 40)
        if kind == "ad":
            return el(r.choice(["div", "div", "section", "aside", "p", "span"]), r.choice([long, el("p", long), f'<a href="/x">{long}</a>']), pick("ad"))
        if kind == "side":
            body = el("h3", said(1, 3)) + r.choice([f"<ul>{links(r.randint(2, 6))}</ul>", el("p", long), el("div", long)])
            return el("aside", body, pick("side") if r.random() < 0.5 else "") if r.random() < 0.6 else el(r.choice(["div", "section"]), body, pick("side"))
        if kind == "notice":
            return el(r.choice(["div", "div", "section", "p", "dialog"]), r.choice([long, el("p", long) + "<button>Ok</button>"]), pick("notice"))
        if kind == "form":
            return f"<form{' class=' + pick('form').split()[0] if r.random() < 0.5 else ''}>" + el("label", said(1, 3)) + '<input name="q">' + r.choice(["", el("p", said(3, 20))]) + "<button>Go</button></form>"
        if kind == "comment":
            one = r.choice(["div", "li", "article", "p"])
            body = "".join(el(one, (el("b", said(1, 2)) if r.random() < 0.5 else "") + (el("p", said(3, 60)) if one != "p" else said(3, 60)), pick("comment") if r.random() < 0.6 else "") for _ in range(r.randint(1, 6)))
            body = el("h3", said(1, 3)) * (r.random() < 0.6) + (f"<ol>{body}</ol>" if one == "li" else body)
            return el(r.choice(["section", "div", "div"]), body, pick("comment"))
        if kind == "share":
            return el(r.choice(["div", "ul", "p"]), r.choice([said(1, 6), links(3)]), pick("share"))
        return f"<!-- {words(5)} -->"

    def article() -> str:
        n = r.choice([1, 1, 2, 3, 5, 8, 12, 20])
        size = r.choice([0.3, 1, 1, 4])
        parts = [el("h1", words(r.randint(2, 10), _MARK))] * (r.random() < 0.85)
        for i in range(n):
            x = r.random()
            length = max(1, int(size * r.choice([1, 2, 5, 12, 40, 90, 200, 400]) / (1 + n / 20)))
            said_here = words(length, _MARK)
            if r.random() < 0.2:
                said_here = f"<b>{said_here}</b>" if r.random() < 0.5 else said_here + f' <a href="/l">{words(2, _MARK)}</a> ' + words(4, _MARK)
            if x < 0.74:
                parts.append(f"<p>{said_here}" + ("</p>" if r.random() < 0.9 else "") if r.random() < 0.9 else f"<p><b>{said_here}<br><p>{words(6, _MARK)}</p>")
            elif x < 0.80:
                parts.append(el(r.choice(["h2", "h3"]), words(r.randint(1, 6), _MARK)))
            elif x < 0.86:
                parts.append(el(r.choice(["ul", "ol"]), "".join(el("li", words(r.randint(1, 15), _MARK)) for _ in range(r.randint(1, 6)))))
            elif x < 0.90:
                parts.append(el("blockquote", el("p", said_here)))
            elif x < 0.93:
                parts.append("<table>" + "".join("<tr>" + "".join(el("td", words(r.randint(1, 4), _MARK)) for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.96:
                parts.append(el(r.choice(["pre", "div", "div"]), said_here))
            else:
                parts.append(said_here)
            if r.random() < 0.10:
                parts.append(other(r.choice(["ad", "ad", "notice", "form", "share", "side", "comment"])))
        if r.random() < 0.1:
            parts[0] = el("header", parts[0])
        return "".join(parts)

    body = article()
    style = r.random()
    if style < 0.5:
        main = el("article", body, pick("main") if r.random() < 0.2 else "")
        main = el("main", main) if r.random() < 0.3 else main
    elif style < 0.62:
        main = el("main", body)
    elif style < 0.9:
        main = el(r.choice(["div", "section"]), body, pick("main"))
    else:
        main = el("div", body, r.choice(["", "c7", "x-12"]))
    top = [menu()] * (r.random() < 0.8)
    if r.random() < 0.5:
        head = el("p", said(1, 8)) + (top.pop() if top and r.random() < 0.5 else "")
        top.insert(0, el("header", r.choice([head, el("h1", said(1, 4)) + head]), pick("head") if r.random() < 0.3 else "") if r.random() < 0.7 else el("div", head, pick("head")))
    top += [other(r.choice(["ad", "notice", "form", "side", "share"])) for _ in range(r.choice([0, 1, 1, 2]))]
    end = [other(r.choice(["comment", "comment", "side", "ad", "form", "share", "notice"])) for _ in range(r.choice([0, 1, 1, 2, 3]))]
    if r.random() < 0.85:
        foot = r.choice(["&copy; ", ""]) + said(2, 25)
        foot = r.choice([foot, el("p", foot), foot + f"<ul>{links(3)}</ul>"])
        end.append(el("footer", foot) if r.random() < 0.7 else el("div", foot, pick("foot")))
    inside = main
    if r.random() < 0.25:  # what stands beside the article shares a box with it
        inside = el("div", main + "".join(end[:-1]), r.choice(["", "wrap", "container", "row"]))
        end = end[-1:]
    page = "".join(top) + inside + "".join(end)
    if r.random() < 0.25:
        page = el("div", page, r.choice(["", "wrapper", "page", "container"]))
    return f"<!DOCTYPE html><html><head><title>{said(2, 6)}</title><style>p{{margin:0}}</style></head><body>{page}</body></html>"


@lru_cache(2)
def fitted(count: int = TRAINING_PAGES) -> boosting.BoostedTrees:
    """The trees, fitted on made-up pages: an element is positive if main text lies in it."""
    rows, target = [], []
    for source in made_up_pages(count):
        marked, page = Dom(source), Page(source.replace(_MARK, ""))
        holds = [False] * len(marked.tags)
        for e, t in marked.texts:
            while t and _MARK in t and e >= 0 and not holds[e]:
                holds[e] = True
                e = marked.parents[e]
        for i, row in zip(page.nodes, page.features, strict=True):
            if not page.never[i]:
                rows.append(row)
                target.append(holds[i])
    return boosting.fit(np.array(rows), np.array(target, float), ridge=4.0, least=4.0)


def main_texts(sources: list[str | None], trees: boosting.BoostedTrees) -> list[str]:
    """The main text of each page; empty for null and empty pages and for those without any."""
    pages = [Page(s) if s else None for s in sources]
    rows = [row for p in pages if p for row in p.features]
    scores = trees.scores(np.array(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p in pages:
        if p is None:
            out.append("")
        else:
            out.append(p.text(p.kept(scores[at : at + len(p.nodes)])))
            at += len(p.nodes)
    return out


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` (code points) of every row, from its whole ``html``.

    Null and empty pages, and pages without main text, give an empty text. Rows are judged one by one;
    other columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(fitted())
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            sources = batch.column("html").to_pylist()
            texts = [t for at in range(0, len(sources), 64) for t in main_texts(sources[at : at + 64], shared.value)]
            values = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *values], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, "html").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string, n_chars long"]))
