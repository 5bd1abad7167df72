"""Main text of web pages: a recurrent network labels every text block.

A page becomes a sequence of leaf blocks (runs of text between block-level tags).
A block is read as two hashed vectors, of its tag path (tags, classes, ids of all
open elements) and of its words, and a few proportions. A bidirectional LSTM reads
the whole sequence, so each block is judged in the context of the document, and
gives each block the probability of being article text. A page is read whole, whatever
its length; only the features of a part of it are held at once.

Parsing takes time in proportion to the page, whatever it holds: open elements are
found by lists of their places, and the tag path is a bitmap kept up to date.

The network is trained in numpy, from a fixed seed, on generated pages whose blocks
are labelled by construction; the generated pages vary the containers, names and
order of articles, menus, headers, footers, sidebars, notices, adverts, forms and
comments.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import small_batches

PATH_DIM, WORD_DIM, EXTRA_DIM, HIDDEN = 256, 64, 6, 24
IN_DIM = PATH_DIM + WORD_DIM + EXTRA_DIM

# Elements of HTML by the way a reader treats them.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset(
    "head script style noscript template svg math iframe object canvas audio video select textarea button datalist".split()
)
RAW_TAGS = frozenset("script style textarea title noscript template iframe".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SIBLING_WALLS = frozenset("ul ol dl table menu dir select".split())

MARKED_TAGS = SIBLING_WALLS.union(SIBLINGS, *SIBLINGS.values())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)", re.S)
ATTRS = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+")
ATTR = re.compile(r"\b(class|id|role|aria-label|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z0-9]+")


class Block:
    """A run of text; ``path``: bitmap of its tag path's hashed tags, classes and ids; ``leaf``: its innermost tag."""

    __slots__ = ("path", "leaf", "text", "linked")

    def __init__(self, path: int, leaf: str, text: str, linked: int):
        self.path, self.leaf, self.text, self.linked = path, leaf, text, linked


class _Open:
    """The open elements of a page."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.own: list[list[int]] = []  # bits of each element
        self.leaves: list[str] = []
        self.places: dict[str, list[int]] = {}  # by tag
        self.blocks: list[int] = []  # places of block-level elements
        self.marks: list[int] = []  # places of elements that siblings close, and of those that they don't pass
        self.bits, self.path = [0] * PATH_DIM, 0
        self.silent = 0  # open elements whose text no reader sees

    def push(self, tag: str, names: list[str]) -> None:
        at = len(self.tags)
        own = [_path_bit(x) for x in names]
        for b in own:
            if not self.bits[b]:
                self.path |= 1 << b
            self.bits[b] += 1
        self.leaves.append(tag if ":" not in tag else self.leaf())
        self.tags.append(tag)
        self.own.append(own)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK_TAGS:
            self.blocks.append(at)
        if tag in MARKED_TAGS:
            self.marks.append(at)
        self.silent += tag in SILENT_TAGS

    def pop(self) -> None:
        tag = self.tags.pop()
        at = len(self.tags)
        for b in self.own.pop():
            self.bits[b] -= 1
            if not self.bits[b]:
                self.path &= ~(1 << b)
        self.leaves.pop()
        self.places[tag].pop()
        for held in (self.blocks, self.marks):
            if held and held[-1] == at:
                held.pop()
        self.silent -= tag in SILENT_TAGS

    def leaf(self) -> str:
        return self.leaves[-1] if self.leaves else ""

    def linked(self) -> bool:
        return bool(self.places.get("a"))

    def paragraph(self) -> int:
        """Place of the paragraph that holds text directly or by inline elements, or -1."""
        return self.blocks[-1] if self.blocks and self.tags[self.blocks[-1]] == "p" else -1

    def sibling(self, tag: str) -> int:
        """Place of the element that ends where ``tag`` begins, or -1."""
        for i in reversed(self.marks):
            if self.tags[i] in SIBLINGS[tag]:
                return i
            if self.tags[i] in SIBLING_WALLS:
                return -1
        return -1


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, white space collapsed, character references decoded."""
    page = page or ""
    found: list[Block] = []
    stack = _Open()
    parts: list[str] = []
    linked = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(stack.path, stack.leaf(), text, linked))
            parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        if stack.blocks and stack.blocks[-1] >= i:
            flush()
        while len(stack.tags) > i:
            stack.pop()

    def read(text: str) -> None:
        nonlocal linked
        if text and not stack.silent:
            parts.append(text)
            linked += len(text.strip()) if stack.linked() else 0

    while at < n:
        m = TOKEN.search(page, at)
        read(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        if m["cdata"] and not stack.silent:
            parts.append(m["cdata"].replace("&", "&amp;"))
        if not m["tag"]:
            continue
        # A tag ends at the first > outside of quotes; where a quote is left open, at the first one.
        stop = ATTRS.match(page, at).end()
        if page[stop : stop + 1] != ">":
            stop = page.find(">", at)
            if stop < 0:
                read(page[m.start() :])
                break
        attrs, at = page[at:stop], stop + 1
        tag = m["tag"].lower()
        if m["end"]:
            if stack.places.get(tag):
                pop_to(stack.places[tag][-1])
            elif tag == "p":
                flush()
            continue
        if tag in CLOSES_P and (i := stack.paragraph()) >= 0:
            pop_to(i)
        if tag in SIBLINGS and (i := stack.sibling(tag)) >= 0:
            pop_to(i)
        if tag == "body" and stack.places.get("head"):
            pop_to(stack.places["head"][-1])
        if tag in BLOCK_TAGS:
            flush()
        if tag in VOID_TAGS or attrs.endswith("/"):
            if tag == "br":
                parts.append(" ")
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
            continue
        own = [tag]
        if attrs:
            for name, a, b, c in ATTR.findall(attrs):
                own += [f"{name.lower()}:{w}" for w in WORD.findall((a or b or c).lower())]
        stack.push(tag, own)
    flush()
    return found


def _bucket(token: str, dim: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % dim


@functools.lru_cache(maxsize=50_000)
def _path_bit(name: str) -> int:
    return _bucket(name, PATH_DIM)


@functools.lru_cache(maxsize=20_000)
def _path_vector(path: int, leaf: str) -> np.ndarray:
    v = np.unpackbits(np.frombuffer(path.to_bytes(PATH_DIM // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
    if leaf:
        v[_bucket(f"leaf {leaf}", PATH_DIM)] = 1
    return v


_word_buckets: dict[str, int] = {}


def _word_vector(text: str) -> np.ndarray:
    if len(_word_buckets) > 300_000:
        _word_buckets.clear()
    at, ids = _word_buckets, []
    for w in text.lower().split():
        b = at.get(w)
        if b is None:
            b = at[w] = _bucket(w, WORD_DIM)
        ids.append(b)
    v = np.bincount(ids, minlength=WORD_DIM).astype(np.float32)
    return v / max(1.0, float(np.linalg.norm(v)))


def features(found: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """One row for each of the page's blocks from ``start`` to ``stop``."""
    part = found[start:stop]
    x = np.zeros((len(part), IN_DIM), np.float32)
    if not part:
        return x
    places: dict[tuple[int, str], int] = {}
    path = [places.setdefault((b.path, b.leaf), len(places)) for b in part]
    x[:, :PATH_DIM] = np.stack([_path_vector(*k) for k in places])[path]
    for i, b in enumerate(part):
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = _word_vector(b.text)
    n = np.array([len(b.text) for b in part], float)
    k = np.arange(start, start + len(part))
    signs = np.array([sum(map(b.text.count, ".,;:!?")) for b in part], float)
    linked = np.array([b.linked for b in part], float)
    x[:, -6:] = np.stack([np.log1p(n) / 6, np.minimum(1, linked / n), signs / n, k / len(found), 1 / (1 + k), 1 / (len(found) - k)], 1)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(
    gates: np.ndarray, u: np.ndarray, mask: np.ndarray, learn: bool = True, state: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
    """Hidden states (T, B, H), what :func:`_lstm_back` needs, and the last state; gates: the inputs' share (T, B, 4H); a masked step keeps the state."""
    steps, batch, _ = gates.shape
    h, c = state or (np.zeros((batch, HIDDEN), np.float32),) * 2
    out, tape = np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = gates[t] + h @ u
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        m = mask[t][:, None]
        if learn:
            tape.append((i, f, o, g, c, tc, h, m))
        h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
        out[t] = h
    return out, tape, (h, c)


def _lstm_back(dout: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    dgates, du = np.zeros((*dout.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh = np.zeros_like(dout[0])
    dc = np.zeros_like(dh)
    for t in range(len(tape) - 1, -1, -1):
        i, f, o, g, c, tc, h, m = tape[t]
        dh = dh + dout[t]
        d = dh * m
        dct = dc * m + d * o * (1 - tc * tc)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), d * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
        dgates[t] = dz
        du += h.T @ dz
        dh, dc = dz @ u.T + dh * (1 - m), dct * f + dc * (1 - m)
    return dgates, du


class BlockLabeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def untrained(cls, rng: np.random.Generator) -> BlockLabeller:
        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        w = {"v": draw(2 * HIDDEN, 1), "vb": np.zeros(1, np.float32)}
        for side in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            w |= {f"w{side}": draw(IN_DIM, 4 * HIDDEN) * 2, f"u{side}": draw(HIDDEN, 4 * HIDDEN), f"b{side}": bias}
        return cls(w)

    def forward(self, x: np.ndarray, mask: np.ndarray, learn: bool = True) -> tuple[np.ndarray, tuple]:
        w = self.w
        hf, tf, _ = _lstm(x @ w["wf"] + w["bf"], w["uf"], mask, learn)
        hb, tb, _ = _lstm((x @ w["wb"] + w["bb"])[::-1], w["ub"], mask[::-1], learn)
        h = np.concatenate([hf, hb[::-1]], 2)
        return _sigmoid((h @ w["v"])[:, :, 0] + w["vb"]), (x, h, tf, tb)

    def gradients(self, p: np.ndarray, y: np.ndarray, mask: np.ndarray, saved: tuple) -> dict[str, np.ndarray]:
        x, h, tf, tb = saved
        w = self.w
        d = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        out = {"v": np.einsum("tbh,tbo->ho", h, d), "vb": d.sum((0, 1))}
        dh = d @ w["v"].T
        for side, grad, tape in (("f", dh[:, :, :HIDDEN], tf), ("b", dh[::-1, :, HIDDEN:], tb)):
            dg, out[f"u{side}"] = _lstm_back(grad, w[f"u{side}"], tape)
            dg = dg if side == "f" else dg[::-1]
            out[f"w{side}"] = x.reshape(-1, IN_DIM).T @ dg.reshape(-1, 4 * HIDDEN)
            out[f"b{side}"] = dg.sum((0, 1))
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, rng: np.random.Generator, batch: int = 64) -> None:
        """Adam on the blocks' cross-entropy; pages: (features, labels)."""
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        batches = [order[i : i + batch] for i in range(0, len(order), batch)]
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                x, mask, y = _padded([pages[i][0] for i in batches[k]], [pages[i][1] for i in batches[k]])
                p, saved = self.forward(x, mask)
                grads = self.gradients(p, y, mask, saved)
                step += 1
                for name, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.999 * m2[name] + 0.001 * g * g
                    self.w[name] -= 0.01 * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)

    def label(self, pages: list[list[Block]], budget: int = 16_384, steps: int = 4_096) -> list[np.ndarray]:
        """Probability of article text for each block of each page, read in the context of its whole page.

        ``budget``: padded blocks in a batch. ``steps``: blocks whose features are held at
        once; the network's state goes on from one part of a page to the next, so it
        changes no result.
        """
        out = [np.zeros(len(p)) for p in pages]
        todo = sorted((i for i, page in enumerate(pages) if page), key=lambda i: len(pages[i]))
        at = 0
        while at < len(todo):
            stop = at + 1
            while stop < len(todo) and len(pages[todo[stop]]) * (stop + 1 - at) <= budget:
                stop += 1
            for i, p in zip(todo[at:stop], self._read([pages[i] for i in todo[at:stop]], steps), strict=True):
                out[i][:] = p
            at = stop
        return out

    def _read(self, pages: list[list[Block]], steps: int) -> list[np.ndarray]:
        """Probabilities of pages of like lengths, by parts of ``steps`` blocks: forwards, then backwards."""
        w, longest = self.w, max(map(len, pages))
        z = np.zeros((longest, len(pages)), np.float32)
        starts, held = list(range(0, longest, steps)), None
        for side, v in (("f", w["v"][:HIDDEN]), ("b", w["v"][HIDDEN:])):
            turn, state = (1 if side == "f" else -1), None
            for a in starts[::turn]:
                if held is None or held[0] != a:  # the last part forwards is the first one backwards
                    held = (a, *_padded([features(p, a, a + steps) for p in pages], None)[:2])
                _, x, mask = held
                h, _, state = _lstm((x @ w[f"w{side}"] + w[f"b{side}"])[::turn], w[f"u{side}"], mask[::turn], False, state)
                z[a : a + steps] += (h[::turn] @ v)[:, :, 0]
        p = _sigmoid(z + w["vb"])
        return [p[: len(page), k] for k, page in enumerate(pages)]


def _padded(xs: list[np.ndarray], ys: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x = np.zeros((steps, len(xs), IN_DIM), np.float32)
    mask, y = np.zeros((steps, len(xs)), np.float32), np.zeros((steps, len(xs)), np.float32)
    for k, v in enumerate(xs):
        x[: len(v), k], mask[: len(v), k] = v, 1
        if ys is not None:
            y[: len(v), k] = ys[k]
    return x, mask, y


# Names that page authors give to containers, by what they hold.
ARTICLE_NAMES = "content post entry story article body main text prose post-content entry-content article-body blog markdown document hentry primary page-content lead".split()
CLUTTER_NAMES = {
    "menu": "nav navbar sidenav archive menu navigation breadcrumb breadcrumbs topnav toolbar tabs pagination pager toc".split(),
    "header": "header masthead site-header banner top branding logo".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
    "sidebar": "sidebar side widget related recommended popular trending rail aside more".split(),
    "notice": "cookie notice consent alert popup modal gdpr message warning overlay".split(),
    "advert": "ad ads advert advertisement sponsored promo sponsor adsense banner-ad".split(),
    "form": "form newsletter subscribe login search signup contact".split(),
    "comment": "comments comment replies reply discussion disqus respond thread commentlist".split(),
    "share": "share social sharing follow tags meta byline".split(),
}
CLUTTER_TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "form": ["form", "div"], "comment": ["section", "div", "ol"]}
CLUTTER_WORDS = "home about contact login subscribe cookies accept privacy terms copyright reserved share reply comment posted advertisement sponsored menu search next previous read more related".split()


def generated_pages(count: int, seed: int) -> Iterator[tuple[str, list[int]]]:
    """Pages with the label of each block (1: article text)."""
    rng = random.Random(seed)

    def words(lo: int, hi: int, clutter: bool = False) -> str:
        made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéèäöüñó") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(lo, hi))]
        if clutter and rng.random() < 0.4:
            made[rng.randrange(len(made))] = rng.choice(CLUTTER_WORDS)
        if not clutter and rng.random() < 0.1:
            made[rng.randrange(len(made))] = rng.choice(CLUTTER_WORDS)
        text = " ".join(made)
        if rng.random() < 0.1:
            text = text.upper()
        if rng.random() < 0.15:
            text = " ".join(w + rng.choice(["!!", "###", "&amp;&amp;", "%%%", "$$"]) for w in text.split())
        return text.capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def attrs(names: list[str], chance: float = 1.0) -> str:
        if rng.random() > chance:
            return ""
        name = rng.choice(names)
        name = rng.choice([name, name, f"{name}-{rng.choice(['box', 'wrap', 'inner', 'area', 'list', 'item'])}", f"js-{name}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def clutter(labels: list[int], kind: str | None = None, depth: int = 0) -> str:
        kind = kind or rng.choice(list(CLUTTER_NAMES))
        tag = rng.choice(CLUTTER_TAGS.get(kind, ["div", "div", "section", "aside"]))
        plain = tag in ("nav", "footer", "aside", "form") or (tag == "header" and depth == 0)
        at = attrs(CLUTTER_NAMES[kind], 0.4 if plain else 1.0)
        inner = []
        if kind in ("menu", "sidebar", "share") or rng.random() < 0.15:
            items = rng.randint(1, 9)
            linked = rng.random() < 0.85
            inner += [f'<li><a href="/x">{words(1, 3, True)}</a></li>' if linked else f"<li>{words(1, 5, True)}</li>" for _ in range(items)]
            labels += [0] * items
            body = "".join(inner) if tag in ("ul", "ol") else f"<ul>{''.join(inner)}</ul>"
        elif tag in ("ol", "ul"):
            items = rng.randint(1, 5)
            body = "".join(f"<li>{words(3, 40, True)}</li>" for _ in range(items))
            labels += [0] * items
        elif rng.random() < 0.45:
            body = words(1, 25, True)
            labels.append(0)
        else:
            items = rng.randint(1, 5 if kind == "comment" else 3)
            t = rng.choice(["p", "div", "h3", "p"])
            body = "".join(f"<{t}>{words(1, 60 if kind == 'comment' else 25, True)}</{t}>" for _ in range(items))
            labels += [0] * items
        return f"<{tag}{at}>{body}</{tag}>"

    def article(labels: list[int]) -> str:
        tag = rng.choice(["article", "article", "article", "main", "div", "section", ""])
        out = []
        if rng.random() < 0.85:
            head = f"<h1>{words(1, 14)}</h1>"
            labels.append(1)
            out.append(f"<header>{head}</header>" if tag == "article" and rng.random() < 0.1 else head)
        for _ in range(rng.randint(1, rng.choice([3, 10, 20]))):
            r = rng.random()
            if r < 0.72:
                text = words(1, rng.choice([3, 10, 40, 120]))
                if rng.random() < 0.15:
                    text = f'{text} <a href="/y">{words(1, 3)}</a> {words(1, 5)}'
                out.append(rng.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}"]))
                labels.append(1)
            elif r < 0.78:
                t = rng.choice(["h2", "h3", "blockquote", "pre", "div", "h4"])
                out.append(f"<{t}>{words(1, 12)}</{t}>")
                labels.append(1)
            elif r < 0.84:
                n = rng.randint(1, 5)
                out.append(f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{words(1, 15)}</li>" for _ in range(n)) + f"</{t}>")
                labels += [1] * n
            elif r < 0.87:
                n = rng.randint(1, 6)
                out.append("<table><tr>" + "".join(f"<td>{words(1, 6)}</td>" for _ in range(n)) + "</tr></table>")
                labels += [1] * n
            elif r < 0.93:
                out.append(clutter(labels, depth=1))
            else:
                out.append(f"<figure><figcaption>{words(2, 12)}</figcaption></figure>")
                labels.append(1)
        body = "".join(out)
        if not tag:
            return body
        if rng.random() < 0.25:
            body = f"<div{attrs(ARTICLE_NAMES, 0.8)}>{body}</div>"
        return f"<{tag}{attrs(ARTICLE_NAMES, 0.2 if tag in ('article', 'main') else 1.0)}>{body}</{tag}>"

    def table(labels: list[int]) -> str:
        """A page laid out by a table: a title, links beside the article, a last line."""
        rows = []
        if rng.random() < 0.8:
            labels.append(0)
            rows.append(f"<tr><td colspan=2><font size=5>{words(1, 4, True)}</font></td></tr>")
        links = "<br>".join(f"<a href=x.html>{words(1, 3, True)}</a>" for _ in range(rng.randint(2, 8)))
        labels.append(0)
        main, its = [], rng.randint(1, 6)
        if rng.random() < 0.8:
            main.append(f"<h2>{words(1, 8)}</h2>")
        main += [rng.choice(["<p>{}", "<p>{}</p>"]).format(words(4, 60)) for _ in range(its)]
        labels += [1] * len(main)
        rows.append(f"<tr><td width=120>{links}</td><td>{''.join(main)}</td></tr>")
        if rng.random() < 0.8:
            labels.append(0)
            rows.append(f"<tr><td colspan=2>{rng.choice(['<a href=m>{}</a>', '{}']).format(words(1, 6, True))}</td></tr>")
        return f"<html><body><table>{''.join(rows)}</table></body></html>"

    for _ in range(count):
        labels: list[int] = []
        if rng.random() < 0.07:
            yield table(labels), labels
            continue
        out = ["<html><head><title>t</title></head><body>"]
        wrap = rng.random() < 0.2
        out.append(f"<div{attrs(['page', 'wrapper', 'container', 'site'])}>" if wrap else "")
        for kind in rng.sample(["menu", "header", "notice", "advert", "form", None], rng.randint(0, 4)):
            out.append(clutter(labels, kind))
        for _ in range(0 if rng.random() < 0.06 else 1):
            out.append(article(labels))
        for kind in rng.sample(["comment", "sidebar", "share", "advert", "form", "menu", None], rng.randint(0, 4)):
            out.append(clutter(labels, kind))
        if rng.random() < 0.7:
            out.append(clutter(labels, "footer"))
        yield "".join(out) + ("</div>" if wrap else "") + "</body></html>", labels


@functools.lru_cache(maxsize=4)
def trained(pages: int = 2_400, epochs: int = 7, seed: int = 7) -> BlockLabeller:
    """The labeller, trained on ``pages`` generated pages."""
    data = []
    for page, labels in generated_pages(pages, seed):
        found = blocks(page)
        if found and len(found) == len(labels):
            data.append((features(found), np.array(labels, np.float32)))
    rng = np.random.default_rng(seed)
    model = BlockLabeller.untrained(rng)
    model.fit(data, epochs, rng)
    return model


def extract(pages: list[str | None], model: BlockLabeller, threshold: float = 0.5) -> list[str]:
    """Main text of each page."""
    found = [blocks(p) for p in pages]
    scores = model.label(found)
    return ["\n".join(b.text for b, s in zip(bs, p, strict=True) if s >= threshold) for bs, p in zip(found, scores, strict=True)]


def extract_text(
    pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", threshold: float = 0.5, rows: int = 64
) -> DataFrame:
    """One row per page: the columns of ``keep``, ``text`` and ``n_chars`` (code points).

    A map-only operator: pages are labelled ``rows`` at a time, in the task that
    reads them. Null and empty pages, and pages without article text, have the empty
    text. Repeated rows give repeated results; an empty table an empty one. Columns
    outside ``keep`` are not read; ``keep`` may not name ``text`` or ``n_chars``.
    """
    if clash := {"text", "n_chars"} & {c.lower() for c in keep}:
        raise ValueError(f"columns of the result can't be kept from the input: {', '.join(sorted(clash))}")
    small_batches(pages.sparkSession)
    source = pages.select(*[pages[f"`{c}`"] for c in keep], pages[f"`{html_col}`"].alias("html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    weights = trained().w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BlockLabeller(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = extract(part.column(part.num_columns - 1).to_pylist(), model, threshold)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                names = [*keep, "text", "n_chars"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return source.mapInArrow(run, f"{schema}, text string, n_chars bigint")
