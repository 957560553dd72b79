"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are block elements and the text segments between block boundaries; each is content or not. A node has a potential from its
features: tag and parent's tag, class, id and role words, length, share of the page's text, paragraphs below, share of link text,
siblings of the same tag, place in the page, sentence ends and a few telling words (``CUES``) of short texts. Each parent-child edge has
a potential from the 2 x 2 table of its kind of child. Sum-product messages go up and then down the tree; the segments whose content
marginal is above one half are the text. The weights are fitted by the likelihood's gradient (marginals minus labels, from the same
messages) on labelled pages that this module makes from a grammar of layouts (``labelled_pages``), in part with class names that say
nothing; nothing of the input is used.

Segments are decoded (character references), white space runs become one space, ``br`` counts as white space, blocks are joined by two
line feeds in page order. Nulls and pages without content give an empty text. Broken markup is closed as browsers do for p, li, cells
and options; unknown tags are inline. Scripts, styles and the like are passed over to their own end tag, whatever is inside. Rows are
independent, so repeated rows and clashing columns don't matter; an empty table gives no rows. Long pages take time and memory in
proportion to their length, also those of unclosed tags and quotes or of deep nesting.
"""
from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|(/?)([A-Za-z][^\s/>\"'<]*)|[!?/])")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")  # attributes, with > inside quoted values
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_SPACES = re.compile(r"\s+")
CUES = re.compile(r"\b(?:cookies?|privacy|subscri\w+|newsletters?|sign (?:in|up)|log ?in|register|comments?|repl(?:y|ies)|responses|related|popular|read also|recommended|share|tweet|follow us|advert\w*|sponsored|promo\w*|copyright|all rights reserved|terms|imprint|archives|tags|categories|search|menu|home|contact|buy|offers?|free)\b|\u00a9")
BLOCKS = frozenset("html body main article section div header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset blockquote pre figure figcaption address details summary hr center menu dialog legend label select option textarea button iframe".split())
RAW = frozenset("script style noscript template svg title object canvas audio video iframe".split())
TEXT = frozenset("script style title iframe".split())  # without an end tag these go to the end of the page; the others' start tag is then passed over
_ENDS = {t: re.compile(rf"</{t}(?![^\s/>])[^>]*>?", re.I) for t in RAW}
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
CLOSES_P = BLOCKS - frozenset("td th tr li dt dd option label button select textarea thead tbody tfoot html body caption legend summary".split())
_CLOSE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "attrs", "parent", "text", "n", "link", "paras", "start", "hint", "above", "ctx")

    def __init__(self, tag: str, attrs: str, parent: int, above: str, start: int) -> None:
        self.tag, self.attrs, self.parent, self.above, self.start = tag, attrs, parent, above, start
        self.text, self.n, self.link, self.paras, self.hint, self.ctx = None, 0, 0, 0, frozenset(), ()


def parse(page: str) -> list[Node]:
    """Block elements and text segments in page order; parents come before children."""
    nodes = [Node("#root", "", -1, "", 0)]
    stack, run, linked, in_link, at, pos, said = [0], [], 0, 0, 0, 0, 0
    open_: dict[str, list[int]] = {}  # depths in the stack by tag
    unclosed: set[str] = set()
    last, plain = page.rfind(">"), False

    def flush() -> None:
        nonlocal run, linked, said
        if run:
            text = _SPACES.sub(" ", html.unescape("".join(run))).strip()
            if text:
                t = Node("#text", "", stack[-1], nodes[stack[-1]].tag, said)
                t.text, t.n, t.link = text, len(text), linked
                said += len(text)
                nodes.append(t)
            run, linked = [], 0

    def pop_to(tags: set[str], stop: set[str]) -> None:
        """Close the innermost of tags and what is in it, unless one of stop is further in."""
        deepest = lambda names: max((open_[t][-1] for t in names if open_.get(t)), default=0)
        k = deepest(tags)
        if k and k > deepest(stop):
            for i in stack[k:]:
                open_[nodes[i].tag].pop()
            del stack[k:]

    while m := _OPEN.search(page, pos):
        if m.start() > at:
            piece = page[at : m.start()]
            run.append(piece)
            if in_link:
                linked += len(piece)
        at = pos = m.start()
        if m[1] or m[2]:  # without its end it goes to the end of the page
            end = page.find("-->" if m[1] else "]]>", m.end())
            if m[2]:
                run.append(html.escape(page[m.end() : end if end >= 0 else len(page)], False))
            at = pos = end + 3 if end >= 0 else len(page)
            continue
        if pos > last:  # no tag any more
            break
        if m[4] is None:
            at = pos = page.find(">", pos) + 1
            continue
        # Once attributes don't end before the page does, quotes don't count any more, so that no part is read again and again.
        rest = None if plain else _REST.match(page, m.end())
        if rest is None:
            plain = True
        at = pos = rest.end() if rest else page.find(">", m.end()) + 1
        attrs = page[m.end() : pos - 1]
        tag, closing = m[4].lower(), m[3] == "/"
        if tag == "br":
            run.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in RAW:
            # Nothing inside counts as markup but the element's own end tag.
            if not closing and not attrs.endswith("/") and tag not in unclosed:
                if end := _ENDS[tag].search(page, pos):
                    at = pos = end.end()
                elif tag in TEXT:
                    at = pos = len(page)
                else:
                    unclosed.add(tag)
        elif tag in BLOCKS:
            flush()
            if closing:
                pop_to({tag}, set())
                continue
            if tag in CLOSES_P:
                pop_to({"p"}, {"td", "th", "button", "table"})
            if tag in _CLOSE:
                pop_to(*_CLOSE[tag])
            nodes.append(Node(tag, attrs, stack[-1], nodes[stack[-1]].tag, said))
            if tag not in VOID:
                open_.setdefault(tag, []).append(len(stack))
                stack.append(len(nodes) - 1)
    if at < len(page):
        run.append(page[at:])
    flush()
    _measure(nodes)
    return nodes


def _measure(nodes: list[Node]) -> None:
    """What the features read of a node's place in the tree."""
    same: dict[tuple[int, str], int] = {}
    for x in reversed(nodes):
        if x.parent >= 0:
            p = nodes[x.parent]
            p.n += x.n
            p.link += x.link
            p.paras += x.paras + (x.tag == "p")
            same[x.parent, x.tag] = same.get((x.parent, x.tag), 0) + 1
    total = max(1, nodes[0].n)
    for x in nodes:
        if x.text is not None and x.n <= 300:
            found = frozenset(CUES.findall(x.text.lower()))
            if found:
                x.hint = found
                if x.n <= 60 and x.parent > 0:  # a short heading speaks for its block
                    nodes[x.parent].hint |= found
                    if nodes[x.parent].parent > 0:
                        nodes[nodes[x.parent].parent].hint |= found
    for x in nodes:
        share = 4 * x.link // x.n if x.n else 0
        heavy = 0 if 50 * x.n < total else 1 if 10 * x.n < total else 2 if 3 * x.n < total else 3
        ends = -1 if x.text is None else int(x.text[-1] in ".!?:…\"'”»)")
        paras = 0 if not x.paras else 1 if x.paras == 1 else 2 if x.paras < 5 else 3
        many = same.get((x.parent, x.tag), 1)
        x.ctx = (min(8, x.n.bit_length() - 1 if x.n else 0), min(3, share), heavy, paras, 5 * min(x.start, total - 1) // total, ends, 0 if many == 1 else 1 if many < 4 else 2)


def features(x: Node) -> list[str]:
    size, share, heavy, paras, place, ends, many = x.ctx
    text = x.text is not None
    out = ["bias", f"tag={x.tag}", f"tag={x.tag}<{x.above}", f"link={text}:{share}", f"size={text}:{size}", f"heavy={text}:{heavy}", f"paras={text}:{paras}", f"place={text}:{place}", f"many={x.tag}:{many}", f"heavy={heavy}:{paras}:{share}"]
    if text:
        out += [f"ends={ends}", f"ends={ends}:{size}"]
    if x.attrs:
        words = [w.lower() for m in _ATTR.finditer(x.attrs) for w in _WORDS.findall(m[2] or m[3] or m[4] or "")]
        out += [f"word={w}" for w in words]
    out += [f"cue={text}:{w}" for w in x.hint]
    if x.hint:
        out.append(f"cues={text}:{size < 6}")
    return out


_KINDS = {"#text": "text"} | dict.fromkeys("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption".split(), "line") | dict.fromkeys("nav aside header footer form".split(), "edge")


class Model:
    """Weights: log-odds of content by feature, and edge tables (log potentials) by kind of child."""

    def __init__(self) -> None:
        self.unary: dict[str, float] = {}
        self.edge: dict[str, list[float]] = {}
        self._memo: dict[tuple, float] = {}

    @staticmethod
    def kind(x: Node) -> str:
        return _KINDS.get(x.tag, "block")

    def _score(self, x: Node) -> float:
        key = (x.tag, x.above, x.attrs, x.ctx, x.hint)
        s = self._memo.get(key)
        if s is None:
            if len(self._memo) > 50_000:
                self._memo.clear()
            s = self._memo[key] = sum(self.unary.get(f, 0.0) for f in features(x))
        return s

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[tuple[float, ...]]]:
        """P(content) by node, and the joint of (parent, child) by node: n00, n01, n10, n11. Exact on the tree, by sum-product."""
        n = len(nodes)
        b0, b1 = [1.0] * n, [0.0] * n
        for i, x in enumerate(nodes):
            b1[i] = math.exp(max(-30.0, min(30.0, self._score(x))))
        table = {k: tuple(math.exp(v) for v in e) for k, e in self.edge.items()}
        flat = (1.0, 1.0, 1.0, 1.0)
        edge = [table.get(self.kind(x), flat) for x in nodes]
        m0, m1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):  # up
            e, p = edge[i], nodes[i].parent
            u0, u1 = b0[i] * e[0] + b1[i] * e[1], b0[i] * e[2] + b1[i] * e[3]
            s = u0 + u1
            m0[i], m1[i] = u0 / s, u1 / s
            b0[p] *= m0[i]
            b1[p] *= m1[i]
            s = b0[p] + b1[p]
            b0[p] /= s
            b1[p] /= s
        p1, joint = [0.0] * n, [()] * n
        p1[0] = b1[0] / (b0[0] + b1[0])
        for i in range(1, n):  # down
            p, e = nodes[i].parent, edge[i]
            q1 = p1[p] / max(m1[i], 1e-300)
            q0 = (1 - p1[p]) / max(m0[i], 1e-300)
            j = (q0 * b0[i] * e[0], q0 * b1[i] * e[1], q1 * b0[i] * e[2], q1 * b1[i] * e[3])
            s = sum(j) or 1.0
            joint[i] = tuple(v / s for v in j)
            p1[i] = joint[i][1] + joint[i][3]
        return p1, joint

    def fit(self, pages: list[tuple[list[Node], list[int]]], rounds: int = 60, rate: float = 1.0, l2: float = 1e-3) -> "Model":
        """Gradient ascent (Adagrad) on the likelihood of whole labelled trees."""
        self.edge = {k: [0.0] * 4 for k in sorted({"block", *_KINDS.values()})}
        feats = [[features(x) for x in nodes] for nodes, _ in pages]
        seen: dict = {}
        for _ in range(rounds):
            gu: dict[str, float] = {}
            ge = {k: [0.0] * 4 for k in self.edge}
            self._memo.clear()
            for (nodes, y), fs in zip(pages, feats):
                p1, joint = self.marginals(nodes)
                for i, x in enumerate(nodes):
                    d = y[i] - p1[i]
                    for f in fs[i]:
                        gu[f] = gu.get(f, 0.0) + d
                    if i:
                        g, at = ge[self.kind(x)], 2 * y[x.parent] + y[i]
                        for k in range(4):
                            g[k] += (k == at) - joint[i][k]
            for store, grad in ((self.unary, gu), *((self.edge[k], dict(enumerate(ge[k]))) for k in ge)):
                for f, g in grad.items():
                    old = store.get(f, 0.0) if isinstance(store, dict) else store[f]
                    g -= l2 * old
                    key = (id(store), f)
                    seen[key] = seen.get(key, 1e-8) + g * g
                    store[f] = old + rate * g / math.sqrt(seen[key])
        self._memo.clear()
        return self


MARK = "\ue000"  # in each content segment of a labelled page
_NAMES = {
    "body": "content article story post entry text main body article-body post-content entry-content story-body prose page-content article__text",
    "wrap": "wrapper container row col page inner outer site layout grid clearfix l-main wrap section block holder",
    "menu": "menu nav navbar navigation topbar main-menu site-nav links breadcrumb breadcrumbs pagination toc",
    "head": "header site-header masthead top branding logo banner-top",
    "foot": "footer site-footer bottom colophon legal copyright credits",
    "side": "sidebar side widget related recommended popular teaser more-stories secondary rail",
    "note": "notice cookie-notice consent gdpr alert disclaimer paywall modal popup message",
    "ad": "ad ads advert advertisement sponsored promo banner ad-slot sponsor",
    "form": "form signup newsletter search login subscribe contact-form",
    "talk": "comments comment-list discussion respond replies thread comment",
    "share": "share social sharing share-bar tools buttons",
}


def labelled_pages(n: int = 400, seed: int = 7, told: float = 0.55, names: dict[str, str] | None = None) -> list[str]:
    """Pages of random layouts; content segments hold MARK. A block's class is of ``names`` with probability ``told``, else says nothing."""
    rnd, names = random.Random(seed), {k: v.split() for k, v in (names or _NAMES).items()}
    letters = lambda a, b: "".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(a, b)))
    pool = [letters(1, 10) for _ in range(400)]

    def words(a: int, b: int) -> str:
        return " ".join(rnd.choice(pool) for _ in range(rnd.randint(a, b)))

    def prose(a: int, b: int) -> str:
        out, left = [], rnd.randint(a, b)
        while left > 0:
            k = min(left, rnd.randint(2, 18))
            out.append(words(k, k).capitalize() + rnd.choice("....!?"))
            left -= k
        return " ".join(out)

    def attr(kind: str) -> str:
        if rnd.random() < told:
            name = rnd.choice(names[kind])
            return f' class="{name}"' if rnd.random() < 0.8 else f' id="{name}"'
        return rnd.choice(["", "", f' class="{letters(2, 6)}-{rnd.randint(1, 99)}"', f' class="{letters(4, 8)}"'])

    def links(k: int, tag: str = "li") -> str:
        each = [f'<a href="/{letters(2, 6)}">{words(1, 3)}</a>' for _ in range(k)]
        return rnd.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>", " | ".join(each), "".join(f"<{tag}>{x}</{tag}>" for x in each) if tag != "li" else "<ul>" + "".join(f"<li>{x}" for x in each) + "</ul>"])

    say = lambda *options: rnd.choice(options)

    def menu() -> str:
        return say(f"<nav{attr('menu')}>{links(rnd.randint(2, 9))}</nav>", f"<div{attr('menu')}>{links(rnd.randint(2, 9))}</div>", f"<ul{attr('menu')}><li><a href='/'>Home</a><li><a href='/c'>Contact</a></ul>")

    def head() -> str:
        t = say(f"<div{attr('head')}>{words(1, 3)}</div>", f"<h2>{words(1, 3)}</h2><p>{words(2, 6)}</p>", f"<a href='/'>{words(1, 2)}</a>", f"<h1>{words(1, 3)}</h1>")
        return say(f"<header{attr('head')}>{t}{menu() if rnd.random() < 0.5 else ''}</header>", f"<div{attr('head')}>{t}{menu()}</div>")

    def foot() -> str:
        t = say(f"<p>&copy; 20{rnd.randint(10, 29)} {words(1, 4)}. All rights reserved.</p>", f"&copy; {words(1, 3)} &middot; {prose(2, 12)}", f"<p>Copyright {words(2, 6)}</p>{links(3, 'span')}", f"<p>{prose(4, 25)}</p><p>Terms and privacy.</p>")
        return say(f"<footer{attr('foot')}>{t}</footer>", f"<footer>{t}</footer>", f"<div{attr('foot')}>{t}</div>")

    def side() -> str:
        t = say(f"<h3>{say('Related', 'Popular', 'Read also', 'Recommended', words(1, 2))}</h3>{links(rnd.randint(2, 6))}", f"<p>{prose(3, 14)}</p>{links(3)}", f"<h4>{words(1, 3)}</h4><p>{prose(4, 20)}</p>")
        return say(f"<aside{attr('side')}>{t}</aside>", f"<div{attr('side')}>{t}</div>", f"<aside>{t}</aside>", f"<div role='complementary'>{t}</div>")

    def note() -> str:
        t = say("We use cookies to improve this site.", f"This site uses cookies. {prose(3, 12)}", f"By going on you accept our privacy terms. {words(2, 6)}.", f"Subscribe to read more. {prose(2, 8)}")
        return f"<div{attr('note')}>{say(t, f'<p>{t}</p>')}{say('<button>Accept</button>', '')}</div>"

    def ad() -> str:
        t = say(f"Buy {words(1, 3)} now.", f"Sponsored: {prose(3, 12)}", f"Advertisement {prose(2, 10)}", f"{prose(3, 15)}", f"Special offer: {words(2, 6)}, free today.")
        return f"<div{attr('ad') if rnd.random() < 0.5 else ' class=%s' % rnd.choice(names['ad'])}>{say(t, f'<p>{t}</p>')}</div>"

    def form() -> str:
        return f"<form{attr('form')}><label>{say('Sign up for our newsletter', 'Search', words(1, 5))}</label><input name=q>{say('', f'<p>{prose(3, 12)}</p>')}<button>Send</button></form>"

    def talk() -> str:
        each = [say(f"<div{attr('talk')}><b>{words(1, 2)}</b><p>{prose(2, 30)}</p></div>", f"<li><p>{prose(2, 30)}</p><a href='#'>Reply</a></li>", f"<article class='comment'><p>{prose(2, 30)}</p></article>") for _ in range(rnd.randint(1, 5))]
        name = f' class="{rnd.choice(names["talk"])}"' if rnd.random() < 0.6 else f' id="{rnd.choice(names["talk"])}"'
        title = say("<h3>Comments</h3>", f"<h2>{rnd.randint(2, 40)} responses</h2>", f"<h3>{rnd.randint(2, 40)} Comments</h3>", "")
        return say(f"<section{name}>{title}{''.join(each)}</section>", f"<div{name}>{title}<ol>{''.join(each)}</ol></div>")

    def share() -> str:
        return f"<div{attr('share')}>{say('Share ', '')}<a href='#'>Tweet</a> <a href='#'>{words(1, 1)}</a></div>"

    def block() -> str:
        t = MARK + prose(1, rnd.choice((8, 40, 120)))
        if rnd.random() < 0.08:  # what menus and notices say may stand in an article too
            t = MARK + say("All rights reserved.", f"{words(1, 3)} |", f"Licensed under {words(1, 4)}.", f"{words(1, 6)} free offer", f"He read the comments. {words(1, 9)}", f"{words(1, 4)} contact: a@b.c", f"{words(2, 6)} copyright {words(0, 4)}")
            return f"<p>{t}</p>"
        return say(
            *[f"<p>{t}</p>"] * 6, f"<p>{t} <a href='/{letters(1, 4)}'>{words(1, 3)}</a> {prose(2, 20)}</p>", f"<h{rnd.randint(2, 4)}>{MARK}{words(1, 8)}</h{rnd.randint(2, 4)}>", f"<ul>{''.join(f'<li>{MARK}{prose(1, 15)}</li>' for _ in range(rnd.randint(1, 5)))}</ul>",
            f"<blockquote><p>{t}</p></blockquote>", f"<pre>{MARK}{words(3, 20)}</pre>", f"<table><tr><td>{MARK}{words(1, 5)}</td><td>{MARK}{words(1, 5)}</td></tr></table>", f"<div>{t}</div>", f"<p><b>{t}<br>", f"{t}<br><br>{prose(5, 30)}", f"<figure><img src=x><figcaption>{MARK}{words(2, 12)}</figcaption></figure>", f"<ol><li>{MARK}{words(1, 9)}<li>{MARK}{prose(2, 20)}</ol>",
        )

    def article() -> str:
        title = say(f"<h1>{MARK}{words(1, 12)}</h1>", f"<h1>{MARK}{words(1, 12)}</h1>", f"<header><h1>{MARK}{words(1, 12)}</h1></header>", f"<h2>{MARK}{words(1, 9)}</h2>", "")
        parts = [block() for _ in range(rnd.choice((1, 2, 3, 5, 9)))]
        if rnd.random() < 0.5:
            parts.insert(rnd.randint(0, len(parts)), say(side, ad, share, form, note)())
        if rnd.random() < 0.2:
            parts.append(say(side, share, talk, foot)())
        inner = title + "".join(parts)
        if rnd.random() < 0.3:
            inner = title + f"<{(k := say('div', 'section'))}{attr('body')}>{''.join(parts)}</{k}>"
        return say(f"<article>{inner}</article>", f"<article{attr('body')}>{inner}</article>", f"<article class='{letters(3, 7)} has-{rnd.choice(names['side'])}'>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div{attr('body')}>{inner}</div>", f"<div{attr('body')}>{inner}</div>", f"<section{attr('body')}>{inner}</section>", f"<main{attr('wrap')}><div{attr('body')}>{inner}</div></main>")

    out = []
    for _ in range(n):
        pick = lambda most: "".join(rnd.choice((menu, head, side, note, ad, form))() for _ in range(rnd.randint(0, most)))
        after = "".join(rnd.choice((side, ad, form, talk, share, note, menu))() for _ in range(rnd.randint(0, 3)))
        near = say("", "", side())
        mid = say(near + article(), article() + near, article())
        for _ in range(rnd.choice((0, 0, 1, 2, 3))):
            mid = f"<div{attr('wrap')}>{mid}</div>"
        whole = pick(3) + mid + after + (foot() if rnd.random() < 0.8 else "")
        for _ in range(rnd.choice((0, 0, 1, 2))):
            whole = f"<div{attr('wrap')}>{whole}</div>"
        out.append(f"<html><head><title>{words(1, 8)}</title></head><body>{whole}</body></html>")
    return out


def labels(nodes: list[Node]) -> list[int]:
    """A segment is content if it is marked, a block if it holds content."""
    y = [int(x.text is not None and MARK in x.text) for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        if y[i]:
            y[nodes[i].parent] = 1
    return y


@functools.lru_cache(maxsize=1)
def train() -> Model:
    return Model().fit([(nodes, labels(nodes)) for nodes in map(parse, labelled_pages())])


def main_text(model: Model, page: str | None) -> str:
    if not page:
        return ""
    nodes = parse(page)
    p1, _ = model.marginals(nodes)
    return "\n\n".join(x.text for x, p in zip(nodes, p1) if x.text is not None and p > 0.5)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per page: page_id, url, text."""
    model = model or train()
    model._memo.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                text = pa.array([main_text(model, x) for x in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), text], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
