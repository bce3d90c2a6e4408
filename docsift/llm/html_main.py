"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between the borders of block elements).  A block's
features are its ancestors' tags and the words of their class, id and role attributes, and its
text's length, links, punctuation and place.  The field labels a page's blocks as main text or
not; it is trained by stochastic gradient on the log-likelihood, in one task, on a bounded
sample of labelled pages, and decoded by Viterbi.

Labels: in pages that mark their article (``article``, ``main``, or the like), a block inside it
and outside every element named in BOILER is main text.  Each sampled page is used as it is and
set into layouts that mark the same blocks by other tags and class words (LAYOUTS), and some
ancestor features are left out at random, so that the field also learns the text's features and
doesn't hang on one tag.
"""

from __future__ import annotations

import html
import pickle
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import SPREAD

#: Sampled pages (about), passes over them, learning rate, L2 a step, share of left-out ancestors.
PAGES, EPOCHS, RATE, DECAY, LEFT_OUT = 200, 6, 0.15, 1e-5, 0.25

#: Elements whose borders end a block; those whose content is no text of the page.
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section
summary table tbody td tfoot th thead tr ul""".split())
SILENT = "script|style|title|noscript|template|svg|math|iframe|object|textarea|select|button|canvas|audio|video"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: They hide what is open outside of them from CLOSES.
LISTS = {"ul", "ol", "dl", "table"}
#: For labels: what marks an article, and what never belongs to one.
MAIN = {"article", "main", "articlebody"}
#: Every page that marks its article matches this (Spark's regex); others may.
MARKED = "(?i)article|main"
BOILER = set("""nav header footer aside form menu sidebar comment comments ad ads advert advertisement banner cookie
notice promo related share social breadcrumb breadcrumbs newsletter subscribe navbar navigation topbar masthead
toolbar widget consent popup sponsor sponsored reply replies disqus respond complementary contentinfo copyright
signup login search""".split())
#: Words that often name the part with the main text.
CONTENT = MAIN | set("content post entry story body text page".split())

_COMMENT, _TEXT = r"<!--.*?(?:-->|\Z)", "([^<]+|<)"
_UNSEEN = rf"<({SILENT})\b[^>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>"
_TAG = r"""<(/?)([a-zA-Z][-\w:]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
#: Groups: silent element, slash, tag, attributes, text.  _NO_TAG and _TAIL have the same groups.
_TOKEN = re.compile(f"{_COMMENT}|{_UNSEEN}|{_TAG}|{_TEXT}", re.S | re.I)
_NO_TAG = re.compile(f"{_COMMENT}|{_UNSEEN}|(?!)()()()|{_TEXT}", re.S | re.I)
_TAIL = re.compile(f"{_COMMENT}|(?!)()()()()|{_TEXT}", re.S | re.I)
_OPENS = re.compile("[a-z/!?]", re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Place:
    """What a block's ancestors tell of it; nested elements that add nothing share one."""
    __slots__ = ("seen", "tag", "main", "boiler", "names")

    def __init__(self, seen: frozenset[str], tag: str | None, main: bool, boiler: bool):
        self.seen, self.tag, self.main, self.boiler = seen, tag, main, boiler
        self.names = sorted(seen | {"@^" + tag}) if tag else []

    def inside(self, tag: str, words: tuple[str, ...], known: dict | None) -> Place:
        """The place of this place's child element; of the features only those in ``known``."""
        marks = {tag, *words}
        found = {"@" + tag, *("@." + w for w in words)}
        if marks & BOILER:
            found.add("@boiler")
        elif tag in MAIN or not CONTENT.isdisjoint(words):
            found.add("@content")
        found = {f for f in found if f not in self.seen and (known is None or f in known)}
        main, boiler = self.main or bool(marks & MAIN), self.boiler or bool(marks & BOILER)
        if not found and (tag, main, boiler) == (self.tag, self.main, self.boiler):
            return self
        return Place(self.seen | found if found else self.seen, tag, main, boiler)


class Block:
    __slots__ = ("place", "text", "linked")

    def __init__(self, place: Place, text: str, linked: int):
        self.place, self.text, self.linked = place, text, linked


def _closable(page: str) -> tuple[list[int], list[bool]]:
    """The places of quotes and ``>``, and for each whether a tag whose next one this is ends."""
    at = [m.start() for m in re.finditer("[\"'>]", page)]
    ends = [False] * (len(at) + 1)
    after = {'"': len(at), "'": len(at)}
    for i in range(len(at) - 1, -1, -1):
        c = page[at[i]]
        if c == ">":
            ends[i] = True
        else:
            ends[i] = after[c] < len(at) and ends[after[c] + 1]
            after[c] = i
    return at, ends


def _tokens(page: str) -> Iterator[re.Match]:
    """The page's tokens, in linear time: from the first tag that never ends, each is looked up
    before it is read, so that no second one is read to the end of the page in vain."""
    place = 0
    for m in _TOKEN.finditer(page):
        if m[5] == "<" and _OPENS.match(page, m.end()):
            place = m.start()
            break
        yield m
    else:
        return
    last = page.rfind(">")
    at, ends = _closable(page)
    while place < len(page):
        token = _TAIL if place > last else _TOKEN if ends[bisect_right(at, place)] else _NO_TAG
        m = token.match(page, place)
        yield m
        place = m.end()


def blocks(page: str, known: dict | None = None) -> list[Block]:
    """Leaf blocks in page order: the place, the text with references decoded and white space as
    one space, the characters inside links.  With ``known``, places have only these features,
    which bounds the work of a page of very many nested elements.  Linear in the page."""
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []
    where: dict[str, list[int]] = {}  # open elements by tag, and the block elements among them
    borders: list[int] = []
    top = Place(frozenset(), None, False, False)
    parts: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(stack[-1][1] if stack else top, text, linked))
        parts.clear()
        linked = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            where[stack.pop()[0]].pop()
        while borders and borders[-1] >= depth:
            borders.pop()

    def innermost(tags: set[str]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    for m in _tokens(page):
        text = m[5]
        if text is not None:
            text = html.unescape(text)
            parts.append(text)
            if where.get("a"):
                linked += len(text)
            continue
        if m[3] is None:  # a comment or silent element stands between words
            continue
        tag = m[3].lower()
        if m[2]:
            if where.get(tag):
                depth = where[tag][-1]
                if borders and borders[-1] >= depth:
                    end()
                close(depth)
            elif tag in BLOCK:
                end()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            end()
            if borders and stack[borders[-1]][0] == "p":  # an open paragraph ends at the next block element
                close(borders[-1])
            if tag in CLOSES:
                depth = innermost(CLOSES[tag])
                if depth > innermost(LISTS):
                    close(depth)
        if tag in VOID or m[4].rstrip().endswith("/"):
            continue
        words: tuple[str, ...] = ()
        if "=" in m[4]:
            words = tuple(w for a in _ATTRIBUTE.finditer(m[4]) for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower()))
        above = stack[-1][1] if stack else top
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            borders.append(len(stack))
        stack.append((tag, above.inside(tag, words, known) if tag in BLOCK or words else above))
    end()
    return out


def silver(page: list[Block]) -> list[int] | None:
    """A label for each block, or None for a page that doesn't mark its article."""
    if not any(b.place.main for b in page):
        return None
    return [int(b.place.main and not b.place.boiler) for b in page]


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that each block has; those of ancestors start with @."""
    out, n = [], len(page)
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        f = ["bias", f"len{min(8, words.bit_length())}", f"link{int(4 * min(1.0, b.linked / len(b.text)))}",
             f"stop{min(4, sum(b.text.count(c) for c in '.!?'))}", f"comma{min(3, b.text.count(','))}",
             "ends" if b.text[-1] in ".!?…\"”" else "open", "capital" if b.text[0].isupper() else "lower"]
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        if re.search(r"[©®|»›]|cookie|copyright", b.text, re.I):
            f.append("mark")
        out.append(f + b.place.names)
    return out


#: Other ways to mark the same parts; {} holds main blocks, [] other blocks, ``~`` is the next one.
LAYOUTS = [
    "<body><div id=header class=site-header><p>[~]</p></div><div class=menu><ul><li><a href=#>[~]</a><li><a href=#>[~]</a></ul></div>"
    "<div id=content class='post-content'>{<p>~</p>}</div><div class=sidebar><p>[~]</p></div><div id=footer><p>[~]</p></div>",
    "<body><header><h2>[~]</h2></header><div class='cookie-notice'><p>[~]</p></div><main>{<p>~</p>}"
    "<div class='ad'><p>[~]</p></div></main><section id=comments class=comments><div class=comment><p>[~]</p></div>"
    "<div class=comment><p>[~]</p></div></section><footer>[~]</footer>",
    "<body><nav class=navbar><a href=#>[~]</a> <a href=#>[~]</a></nav><div class=container><div class='article-body entry'>{<p>~</p>}</div>"
    "<form class=newsletter><label>[~]</label></form><aside><h3>[~]</h3><ul><li><a href=#>[~]</a></ul></aside></div>"
    "<div class=footer>[~]</div>",
    "<body><div class=banner><p>[~]</p></div><article>{<p>~</p>}<aside class=related><p>[~]</p></aside>"
    "<div class='share social'><a href=#>[~]</a></div><form><p>[~]</p></form></article>"
    "<section class=comments><article class=comment><p>[~]</p></article></section><footer><p>[~]</p></footer>",
    "<body><header>[~]</header><article>{<p>~</p>}<div class=promo>[~]</div><section class=comments><p>[~]</p><p>[~]</p></section>"
    "<nav><a href=#>[~]</a></nav></article><aside><p>[~]</p></aside><form><p>[~]</p></form><footer>[~]</footer>",
    "<body><table><tr><td class=menu><a href=#>[~]</a><td class=main>{<p>~</p>}<td class=advert>[~]</table><p class=copyright>[~]</p>",
    "<body><div class=breadcrumb><a href=#>[~]</a></div><div role=main><section>{<p>~</p>}</section></div>"
    "<div role=complementary class=promo><p>[~]</p></div><div role=contentinfo class=notice><p>[~]</p></div>",
]


def laid_out(layout: str, main: list[str], other: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A labelled page: the layout with blocks' texts in its places.  Some main blocks become
    short headings or list items, and some of the other blocks long prose, as comments are."""
    head, body, tail = re.split(r"[{}]", layout)
    inner = ""
    for i, text in enumerate(main):
        tag = "p"
        if i == 0 or rng.random() < 0.3:
            tag = rng.choice(["h1", "h2", "li", "blockquote", "p"] if i else ["h1", "h1", "h2", "p"])
            if rng.random() < 0.6:
                text = " ".join(text.split()[:rng.randrange(1, 6)])
        inner += re.sub(r"\bp>", f"{tag}>", body).replace("~", f"\x01{html.escape(text)}")
    place = lambda m: html.escape(rng.choice(main if rng.random() < 0.4 else other))
    found = blocks(re.sub(r"\[~\]", place, head) + inner + re.sub(r"\[~\]", place, tail))
    labels = [int(b.text.startswith("\x01")) for b in found]
    for b in found:
        b.text = b.text.lstrip("\x01")
    return found, labels


def fit(pages: list[str]) -> dict:
    """Weights by feature, transitions and starts for labels 0 and 1."""
    rng = random.Random(11)
    known = [(b, y) for b in map(blocks, pages) if b and (y := silver(b)) is not None]
    other = [b.text for bs, y in known for b, l in zip(bs, y) if not l] or ["Home", "About us"]
    cases = []
    for bs, y in known:
        cases.append((features(bs), y, False))
        cases.append((features(bs), y, True))
        main = [b.text for b, l in zip(bs, y) if l]
        for _ in range(3 if main else 0):
            cases.append((*(lambda r: (features(r[0]), r[1]))(laid_out(rng.choice(LAYOUTS), main, other, rng)), False))
    names = {f: i for i, f in enumerate(sorted({f for fs, _, _ in cases for block in fs for f in block}))}
    w = np.zeros((len(names), 2))
    move, start = np.zeros((2, 2)), np.zeros(2)
    for epoch in range(EPOCHS):
        rng.shuffle(cases)
        rate = RATE / (1 + epoch)
        for fs, y, drop in cases:
            idx = [[names[f] for f in block if not (drop and f[0] == "@" and rng.random() < LEFT_OUT)] for block in fs]
            s = np.array([w[i].sum(axis=0) for i in idx])
            n = len(s)
            a, b = np.empty((n, 2)), np.zeros((n, 2))
            a[0] = start + s[0]
            for t in range(1, n):
                a[t] = s[t] + np.logaddexp(a[t - 1, 0] + move[0], a[t - 1, 1] + move[1])
            for t in range(n - 2, -1, -1):
                v = s[t + 1] + b[t + 1]
                b[t] = np.logaddexp(move[:, 0] + v[0], move[:, 1] + v[1])
            z = np.logaddexp(*a[-1])
            p = np.exp(a + b - z)  # each block's marginals
            g = -p
            g[np.arange(n), y] += 1
            for i, row in zip(idx, g):
                w[i] += rate * row
            start += rate * g[0]
            if n > 1:
                both = np.exp(a[:-1, :, None] + move[None] + (s[1:] + b[1:])[:, None, :] - z)
                want = np.zeros((2, 2))
                np.add.at(want, (np.array(y[:-1]), np.array(y[1:])), 1)
                move += rate * (want - both.sum(axis=0))
            w *= 1 - rate * DECAY
    return {"weights": {f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()},
            "move": move.tolist(), "start": start.tolist()}


def decode(fs: list[list[str]], model: dict) -> list[int]:
    """Viterbi: the most likely labels of a page's blocks; features never seen don't count."""
    weights, (m0, m1), none = model["weights"], model["move"], (0.0, 0.0)
    back, best = [], None
    for f in fs:
        pairs = [weights.get(x, none) for x in f]
        s0, s1 = sum(p[0] for p in pairs), sum(p[1] for p in pairs)
        if best is None:
            best = (model["start"][0] + s0, model["start"][1] + s1)
            continue
        to0, to1 = (best[0] + m0[0], best[1] + m1[0]), (best[0] + m0[1], best[1] + m1[1])
        back.append((to0[1] > to0[0], to1[1] > to1[0]))
        best = (max(to0) + s0, max(to1) + s1)
    if best is None:
        return []
    label = int(best[1] > best[0])
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def main_text(page: str, model: dict) -> str:
    found = blocks(page, model["weights"])
    return "\n\n".join(b.text for b, y in zip(found, decode(features(found), model)) if y)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks(x.as_py()) for x in batch.column(1)]
        yield batch.filter(pa.array([bool(b) and silver(b) is not None for b in found], pa.bool_()))


def labelled_sample(pages: DataFrame) -> DataFrame:
    """``draw, html`` of about PAGES pages that mark their article (of all, if there are fewer),
    by a hash of the id: more pages are drawn until so many of the drawn ones do."""
    rows = pages.where(F.col("html").rlike(MARKED)).select("page_id", "html")
    share, draw = PAGES / max(1, rows.count()), F.pmod(F.xxhash64("page_id", F.lit(23)), F.lit(SPREAD))
    while True:
        sample = (rows.select(draw.alias("draw"), "html").where(F.col("draw") < share * SPREAD)
                  .mapInArrow(_labelled, "draw long, html string"))
        found = sample.count() if share < 1 else PAGES
        if found >= 0.75 * PAGES:
            return sample
        share *= PAGES / found if found > PAGES / 10 else 8


def train(pages: DataFrame) -> dict:
    """The model from a sample of about PAGES rows of ``pages`` (page_id, html) that mark their
    article; only if no page of the table does, every block counts as main text."""
    model = labelled_sample(pages).groupBy().applyInPandas(
        lambda r: pd.DataFrame({"model": [pickle.dumps(fit(r.sort_values(["draw", "html"])["html"].tolist()))]}),
        "model binary").collect()
    found = pickle.loads(model[0].model) if model else {"weights": {}}
    return found if found["weights"] else {"weights": {"bias": (0.0, 1.0)}, "move": [[0.0] * 2] * 2, "start": [0.0] * 2}


def _extracted(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "", model) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, model: dict) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``: main blocks joined by an empty
    line.  A null or empty page, or one without main text, has an empty text.  Null and repeated
    ids are kept, one row for each input row; other columns are not read."""
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").alias("html"))
            .mapInArrow(lambda b: _extracted(b, model), "page_id long, url string, text string, n_chars long"))
