"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into its leaf blocks: runs of text between tags that are not inline. A block's features are the tags,
classes, ids and roles of its ancestors, and its text's length, links, punctuation and telling words. The field has two labels,
content and other, with a weight for each feature and each pair of neighbouring labels. It is trained by maximum likelihood on
pages that ``labelled_pages`` makes, with layouts of many kinds and the label of every block known, and decodes
a page's blocks together by Viterbi's algorithm.

Nothing of this comes from the pages that are read: class names are the common ones, and some layouts have names that say nothing.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import in_pieces, table

#: How HTML treats its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea iframe".split())
HIDDEN = RAW | frozenset("template noscript svg canvas object select".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
#: Words that tell notices, menus and the like from prose.
_TELLING = re.compile(r"\b(cookies?|subscribe|newsletter|advert\w*|sponsored|comments?|reply|share|log ?in|sign (?:in|up)|copyright|privacy|terms|related|read more|menu|search|follow us|all rights reserved|posted by)\b|[©®]", re.I)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def _element(tag: str, attributes: str) -> str:
    names = []
    for m in _NAMES.finditer(attributes) if "=" in attributes else ():
        names += [x.lower() for x in _SPLIT.split(m[1] or m[2] or m[3] or "") if x]
    return " ".join([tag, *names])


def _hidden_end(page: str, tag: str, at: int) -> int:
    """Where a hidden element that was opened before ``at`` ends. Text elements without an end tag go on to the page's end, as browsers
    have it; others then hide nothing.
    """
    depth = 1
    for m in re.compile(f"<(/?){tag}(?=[\\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 0 if tag in RAW or m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return len(page) if tag in RAW else at


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that have text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    linked, path, at, inside_a = 0, (), 0, 0

    def add(text: str) -> None:
        nonlocal linked, path
        if text:
            if "&" in text:
                text = entities.unescape(text)
            if not pieces:
                path = tuple(e for t, e in stack if t not in INLINE)
            pieces.append(text)
            if inside_a:
                linked += len(text)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, path, linked))
        pieces.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal inside_a
        inside_a -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        if tag in HIDDEN and not attributes.endswith("/"):
            at = _hidden_end(page, tag, at)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
        elif tag in CLOSED_BY_ITSELF:
            same = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSED_BY_ITSELF[tag]:
                    break
                if stack[k][0] in same:
                    pop_to(k)
                    break
        if not attributes.endswith("/") or tag in CLOSES_P:
            stack.append((tag, _element(tag, attributes)))
            inside_a += tag == "a"
    flush()
    return out


def path_features(path: tuple[str, ...]) -> list[str]:
    out = set()
    for element in path:
        tag, *names = element.split(" ")
        out.add(f"in:{tag}")
        out |= {f"name:{x}" for x in names}
    if path:
        own = path[-1].split(" ")[0]
        out.add(f"own:{own}")
        if len(path) > 1:
            out.add(f"pair:{path[-2].split(' ')[0]}>{own}")
    return sorted(out)


def text_features(block: Block) -> list[str]:
    t = block.text
    words = t.count(" ") + 1
    out = ["bias", f"words:{min(6, words.bit_length())}"]
    share = block.linked / len(t)
    out.append("links:" + ("0" if share == 0 else "few" if share < 0.3 else "many" if share < 0.9 else "all"))
    out.append("stop:" + ("1" if t[-1] in ".!?…" else "0"))
    out.append(f"commas:{min(2, t.count(','))}")
    if m := _TELLING.search(t):
        out.append("telling:short" if words < 25 else "telling:long")
        out.append(f"word:{m[0].lower()[:6]}")
    return out


_CONTENT = ["article", "main", "div content", "div post body", "div entry content", "div article body", "section story", "div text", "td content"]
_OTHER = [
    ("nav", "menu"), ("nav main nav", "menu"), ("div menu", "menu"), ("ul navbar", "menu"), ("header", "short"), ("header site header", "menu"), ("div header", "short"), ("div banner", "short"),
    ("footer", "legal"), ("footer site footer", "menu"), ("div footer", "legal"), ("div copyright", "legal"), ("aside", "teasers"), ("aside sidebar", "teasers"), ("div sidebar", "teasers"),
    ("div related", "teasers"), ("div widget", "teasers"), ("div ad", "prose"), ("div ads", "short"), ("div advert", "prose"), ("div sponsored", "prose"), ("div promo", "prose"), ("section advertisement", "prose"),
    ("div cookie notice", "notice"), ("div notice", "notice"), ("div gdpr banner", "notice"), ("div alert", "notice"), ("div popup modal", "notice"), ("form", "form"), ("form search", "form"), ("div login form", "form"),
    ("div subscribe", "form"), ("div newsletter", "form"), ("section comments", "comments"), ("div comments", "comments"), ("ol comment list", "comments"), ("div disqus thread", "comments"), ("div share", "short"),
    ("div social", "menu"), ("div breadcrumb", "menu"), ("div pagination", "menu"), ("div meta", "short"), ("div toolbar", "short"),
]
_WORDS = {
    "notice": "We use cookies to improve the site. By going on you accept our privacy terms. Cookie settings. Accept all.",
    "legal": "© 2024 All rights reserved. Privacy. Terms of use. Copyright notice. Imprint.",
    "form": "Subscribe to our newsletter. Sign up. Log in. Your e-mail address. Search. Submit.",
    "comments": "Reply. Posted by a reader. 3 comments. Leave a comment.",
}


#: Kinds of elements that also stand inside articles.
_INSIDE = ("ad", "ads", "advert", "sponsored", "promo", "alert", "share", "subscribe", "cookie")


def labelled_pages(n: int, seed: int = 7, content: list[str] = _CONTENT, others: list[tuple[str, str]] = _OTHER) -> list[tuple[str, dict[str, int]]]:
    """Pages and, for each text in them, its label: 1 for content. Words are invented, so that none of them teaches a label.

    ``content`` and ``others`` name the elements that pages are made of; a sixth of them have a name that says nothing.
    """
    rng = np.random.default_rng(seed)
    syllables = ["".join(x) for x in zip(rng.choice(list("bcdfghklmnprstvz"), 30), rng.choice("a e i o u é ö ou ie ß к".split(), 30), rng.choice(["", "", "n", "r", "s"], 30), strict=True)]
    marks = [",", ",", ",", ".", ";", ":", " |", " –", "#", "*"]
    used: set[str] = set()
    inside = [x for x in others if set(x[0].split()) & set(_INSIDE)] or others

    def say(low: int, high: int, stop: bool = True) -> str:
        while True:
            w = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(low, high + 1))]
            for i in range(len(w)):
                if rng.random() < 0.08 and len(w) > 6:
                    w[i] += rng.choice(marks)
            text = " ".join(w).capitalize() + ("." if stop and rng.random() < 0.85 else "")
            if text not in used:
                used.add(text)
                return text

    def opened(spec: str) -> tuple[str, str]:
        tag, *names = spec.split(" ")
        if names and rng.random() < 1 / 6:
            names = ["".join(rng.choice(list("bcdfgklmnprstvxz"), 4))]
        kind = "id" if names and rng.random() < 0.25 else "class"
        return f"<{tag}" + (f' {kind}="{"-".join(names) if rng.random() < 0.5 else " ".join(names)}"' if names else "") + ">", f"</{tag}>"

    def hidden() -> str:
        """What no reader sees, with things in it that look like markup."""
        return str(rng.choice(["<script>if (a < b) { c('<div>') }</script>", "<style>p > b { color: red }</style>", "<!-- left out: <p>old</p> -->", "<noscript><p>Turn it on</p></noscript>", "<svg><text>x</text></svg>", ""]))

    out = []
    for _ in range(n):
        labels: dict[str, int] = {}

        def put(text: str, label: int, labels: dict[str, int] = labels) -> str:
            labels[" ".join(text.split())] = label
            return entities.escape(text, quote=False)

        def other(spec: str, kind: str) -> str:
            a, z = opened(spec)
            if kind == "menu":
                body = "<ul>" + "".join(f'<li><a href="/{i}">{put(say(1, 3, False), 0)}</a></li>' for i in range(rng.integers(2, 9))) + "</ul>"
            elif kind == "teasers":
                body = "".join(f'<h3>{put(say(2, 5, False), 0)}</h3><p><a href="#">{put(say(3, 12), 0)}</a></p>' for _ in range(rng.integers(1, 4)))
            elif kind == "prose":
                body = "".join(rng.choice(["<p>{}</p>", "{}<br>"]).format(put(say(3, 30), 0)) for _ in range(rng.integers(1, 3)))
            elif kind == "short":
                body = "".join(f"<span>{put(say(1, 6, False), 0)}</span><br>" for _ in range(rng.integers(1, 3)))
            elif kind == "comments":
                body = "".join(f"<div class='comment'><b>{put(say(1, 2, False), 0)}</b><p>{put(say(4, 40), 0)}</p></div>" for _ in range(rng.integers(1, 5)))
            else:
                body = ""
            if kind in _WORDS:
                phrases = _WORDS[kind].split(". ")
                body += f"<p>{put(' '.join(rng.permutation(phrases)[: rng.integers(1, 4)]) + ' ' + say(1, 8), 0)}</p>"
            return a + body + z

        spec = str(rng.choice(content))
        a, z = opened(spec)
        body = f"<h1>{put(say(2, 10, False), 1)}</h1>" if rng.random() < 0.8 else ""
        for _ in range(rng.integers(1, 14)):
            r = rng.random()
            if r < 0.62:
                body += f"<p>{put(say(1, 70), 1)}" + str(rng.choice(["</p>", "</p>", "</p>", ""]))
            elif r < 0.7:  # inline elements that are not closed
                body += f"<p><{(t := str(rng.choice(['b', 'i', 'em', 'strong'])))}>{put(say(2, 40), 1)}<br><p>{put(say(2, 40), 1)}</{t}></p>"
            elif r < 0.78:
                body += f"<h2>{put(say(2, 6, False), 1)}</h2>"
            elif r < 0.84:
                body += "<ul>" + "".join(f"<li>{put(say(2, 12), 1)}</li>" for _ in range(rng.integers(1, 4))) + "</ul>"
            elif r < 0.88:
                body += f"<blockquote>{put(say(4, 30), 1)}</blockquote>"
            elif r < 0.92:
                body += f"{put(say(4, 30), 1)}<br>"
            else:
                body += other(*inside[rng.integers(len(inside))])
            body += hidden() if rng.random() < 0.05 else ""
        main = a + body + z
        if spec.startswith("td"):
            main = f"<table><tr>{main}</tr></table>"
        if rng.random() < 0.3:
            main = f"<div id='wrapper'>{main}</div>"
        before = "".join(other(*others[i]) for i in rng.integers(0, len(others), rng.integers(1, 4)))
        after = "".join(other(*others[i]) for i in rng.integers(0, len(others), rng.integers(1, 4)))
        title = put(say(2, 8, False), 0) if rng.random() < 0.8 else ""
        out.append((f"<!DOCTYPE html><html><head><title>{title}</title>{hidden()}</head><body>{before}{hidden()}{main}{after}</body></html>", labels))
    return out


@dataclass
class Field:
    """``weights`` favour content; ``link[a][b]`` goes from label a to label b."""

    weights: dict[str, float]
    link: list[list[float]]

    def __post_init__(self):
        self._paths: dict[tuple[str, ...], float] = {}

    def favours(self, block: Block) -> float:
        known = self._paths.get(block.path)
        if known is None:
            if len(self._paths) > 50_000:
                self._paths.clear()
            known = self._paths[block.path] = sum(self.weights.get(f, 0.0) for f in path_features(block.path))
        return known + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def decode(self, found: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks, together."""
        (l00, l01), (l10, l11) = self.link
        no, yes, back = 0.0, 0.0, []
        for i, b in enumerate(found):
            e = self.favours(b)
            if i == 0:
                no, yes = 0.0, e
                continue
            from_no, from_yes = (0, 1) if no + l00 >= yes + l10 else (1, 0), (0, 1) if no + l01 >= yes + l11 else (1, 0)
            back.append((from_no[0], from_yes[0]))
            no, yes = max(no + l00, yes + l10), e + max(no + l01, yes + l11)
        label = int(yes > no)
        out = [label] if found else []
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[str, dict[str, int]]], steps: int = 150, rate: float = 0.15, penalty: float = 0.02) -> Field:
    """Maximum likelihood with a squared penalty, by Adam; gradients from the forward-backward recursions over all pages at once."""
    seqs = []
    for page, labels in pages:
        known = [(b, labels.get(b.text)) for b in blocks(page)]
        seqs.append([(path_features(b.path) + text_features(b), y) for b, y in known if y is not None])
    seqs = [s for s in seqs if s]
    names = sorted({f for s in seqs for fs, _ in s for f in fs})
    number = {f: i for i, f in enumerate(names)}
    length = np.array([len(s) for s in seqs])
    n, t = len(seqs), int(length.max())
    at = np.array([(i, j) for i, s in enumerate(seqs) for j in range(len(s))])
    gold = np.zeros((n, t))
    gold[at[:, 0], at[:, 1]] = [y for s in seqs for _, y in s]
    feats = [[number[f] for f in fs] for s in seqs for fs, _ in s]
    row = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    col = np.array([f for fs in feats for f in fs])
    on = np.arange(t)[None] < length[:, None]
    pairs = on[:, 1:] & on[:, :-1]
    gold_link = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    x = np.zeros(len(names) + 4)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, link = x[:-4], x[-4:].reshape(2, 2)
        e = np.zeros((n, t, 2))
        e[at[:, 0], at[:, 1], 1] = np.bincount(row, w[col], minlength=len(feats))
        f, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        f[:, 0] = e[:, 0]
        for j in range(1, t):
            f[:, j] = np.where(on[:, j, None], np.logaddexp.reduce(f[:, j - 1, :, None] + link, axis=1) + e[:, j], f[:, j - 1])
        for j in range(t - 2, -1, -1):
            b[:, j] = np.where(on[:, j + 1, None], np.logaddexp.reduce(link + (e[:, j + 1] + b[:, j + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(f[:, -1], axis=1)
        p = np.exp(f[..., 1] + b[..., 1] - z[:, None]) * on
        joint = np.exp(f[:, :-1, :, None] + link + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        g = np.concatenate([np.bincount(col, (p - gold)[at[:, 0], at[:, 1]][row], minlength=len(names)), (joint.sum((0, 1)) - gold_link).ravel()]) / n + penalty * x / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field({f: float(x[i]) for f, i in number.items()}, x[-4:].reshape(2, 2).tolist())


@lru_cache(maxsize=2)
def trained(pages: int = 300) -> Field:
    """The field for ``pages`` pages; the same on every machine."""
    return train(labelled_pages(pages))


def main_text(page: str | None, field: Field) -> str:
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, field.decode(found), strict=True) if y)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of every row, ``text`` and its code points ``n_chars``.

    Null and empty pages, and pages without content, have empty text. Malformed markup is read as far as it goes. Nulls
    in other columns stay; repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    field = trained()
    weights, link = {k: w for k, w in field.weights.items() if w}, field.link  # a few hundred features
    fields = [f for f in pages.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string", "n_chars long"])
    given = pages.select(*[F.col(f.name) for f in fields], F.col(html_col).alias("_html"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Field(weights, link)
        for part in in_pieces(parts):
            texts = [main_text(h, here) for h in part.column("_html").to_pylist()]
            columns = [part.column(f.name) for f in fields] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in fields], "text", "n_chars"])

    return given.mapInArrow(run, schema)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page. Null and empty pages, repeated rows, clashing columns and empty tables: as ``extract``."""
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
