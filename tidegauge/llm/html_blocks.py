"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between block-level tags.
Each block is seen as the bag of the tags above it (with their classes, ids and
roles), the bag of its words, and a few measures. A bidirectional LSTM reads a
page's blocks from both ends and says of each whether it is main text. It is
trained on a bounded sample of pages labelled by their markup, and on copies of
them with other containers, with boilerplate put in and with markup taken away.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import carried, hash_words, sample_contents, small_batches, utf8_rows, with_fields

# How HTML treats its elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript iframe object svg canvas math head title".split())
# An opening tag of the first kind ends an open element of the second.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
} | {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
# What such an implied end does not reach across.
BARRIERS = frozenset("table ul ol dl div section article main body td th".split())

# Words in tags, classes, ids and roles that mark the surroundings of the main text, and the main text.
AROUND_TAGS = frozenset("nav header footer aside form button select textarea menu dialog fieldset".split())
AROUND_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disclaimer footer header login masthead menu nav navbar navigation newsletter notice notification pagination "
    "popup promo promoted recommended related reply replies respond share sharing sidebar signup social sponsor "
    "sponsored subscribe tags toolbar widget complementary contentinfo search colophon discussion disqus".split()
)
MAIN_TAGS = frozenset({"article", "main"})
PAGE_TAGS = frozenset({"html", "body"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Tags that hold a piece of text rather than a part of the page.
LEAF_TAGS = INLINE | HEADINGS | frozenset("p pre blockquote li dt dd tr td th caption figcaption figure summary".split())
MAIN_WORDS = frozenset("article articlebody content entry main post story body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|iframe|svg|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


@dataclass(frozen=True)
class Block:
    path: tuple[str, ...]  # tag names and attribute words (after a dot or colon, see _path_words), outermost first
    text: str
    linked: int  # characters inside links


def _path_words(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id and role.

    Words after a dot tell what part of the page the element is. Those after a
    colon hardly do: the words of the whole page, those of compound names on
    leaf tags (``section-header``; but ``cookie-notice``, all of whose words mark
    surroundings, has dots), and ``header`` on a heading.
    """
    words = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        for one in value.lower().split():
            parts = _NAME_WORD.findall(one)
            compound = len(parts) > 1 and not AROUND_WORDS.issuperset(parts)
            weak = tag in PAGE_TAGS or (tag in LEAF_TAGS and compound) or (tag in HEADINGS and parts == ["header"])
            words += [f"{':' if weak else '.'}{w}" for w in parts]
    return (tag, *words)


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks in page order. Scripts, styles, the head and hidden elements have none.

    Unclosed and misnested tags are taken as browsers roughly do: an opening
    tag ends what cannot contain it, a closing tag ends all opened since its start.
    """
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    blocks: list[Block] = []
    pieces: list[str] = []
    linked = in_link = unseen = at = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not unseen:
            pieces.append(text)
            linked += len(text) if in_link else 0

    def close_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            blocks.append(Block(tuple(w for _, words, _ in stack for w in words), text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal in_link, unseen
        for tag, _, hides in stack[depth:]:
            in_link -= tag == "a"
            unseen -= hides
        del stack[depth:]

    for token in _TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        slash, tag, attributes = token.group(2), token.group(3), token.group(4)
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            close_block()
        elif tag == "br":
            add(" ")
        if slash:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                pop_to(depth)
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in CLOSES.get(tag, ()):
                pop_to(i)
                break
            if stack[i][0] in BARRIERS:
                break
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            hides = tag in UNSEEN or bool(_HIDDEN.search(attributes))
            stack.append((tag, _path_words(tag, attributes), hides))
            in_link += tag == "a"
            unseen += hides
    add(page[at:])
    close_block()
    return blocks


def markup_label(path: tuple[str, ...]) -> bool:
    """Whether the markup says main text: inside an article and not inside anything around it.

    Inside an article, words after a colon do not tell of surroundings; those of html and body nowhere do.
    """
    main = inside = False
    tag = ""
    for w in path:
        if w[0] not in ".:":
            tag, inside = w, main
            main = main or w in MAIN_TAGS
            if w in AROUND_TAGS:
                return False
        else:
            main = main or w[1:] in MAIN_WORDS
            if w[1:] in AROUND_WORDS and (w[0] == "." or not (inside or tag in PAGE_TAGS)):
                return False
    return main


# Pages above this size are not learned from unless ``fit`` is told otherwise; text is taken from them like from all others.
MOST_LEARNED_BYTES = 200_000
# Copies of each page learned from, and pages made up where no page can be learned from.
COPIES, MADE_UP_PAGES = 6, 150
PATH_SIZE, WORD_SIZE = 1024, 4096
PATH_WIDTH, WORD_WIDTH, MEASURES = 24, 12, 8
HIDDEN = 16
INPUT = PATH_WIDTH + WORD_WIDTH + MEASURES


@dataclass
class Page:
    """A page's blocks as the network reads them; bags as flat arrays with their bounds."""

    paths: np.ndarray
    path_at: np.ndarray
    words: np.ndarray
    word_at: np.ndarray
    measures: np.ndarray


def _hashed(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    joined = b" ".join(texts)
    starts, _, hashes = hash_words(joined)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    return (hashes % np.uint64(size)).astype(np.int64), np.searchsorted(starts, offsets)


def encode_page(blocks: list[Block]) -> Page:
    paths, path_at = _hashed([" ".join(b.path).encode() for b in blocks], PATH_SIZE)
    texts = [b.text.lower().encode() for b in blocks]
    words, word_at = _hashed(texts, WORD_SIZE)
    n = len(blocks)
    length = np.array([len(b.text) for b in blocks], float)
    count = np.diff(word_at)
    place = np.arange(n) / max(1, n - 1)
    measures = np.stack(
        [
            np.log1p(length) / 5,
            np.log1p(count) / 4,
            np.array([b.linked for b in blocks]) / np.maximum(length, 1),
            np.array([b.text[-1] in ".!?…。" for b in blocks], float),
            np.array([sum(map(b.text.count, ".,;:")) for b in blocks]) / np.maximum(count, 1),
            place,
            np.minimum(np.arange(n), 10) / 10,
            np.minimum(np.arange(n)[::-1], 10) / 10,
        ],
        axis=1,
    )
    return Page(paths, path_at, words, word_at, measures.reshape(n, MEASURES))


def _bag_sums(table: np.ndarray, items: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[items], axis=0)])
    return sums[at[1:]] - sums[at[:-1]]


Weights = dict[str, np.ndarray]


def initial_weights(seed: int = 3) -> Weights:
    rng = np.random.Generator(np.random.PCG64(seed))
    weights = {"path": rng.normal(0, 0.3, (PATH_SIZE, PATH_WIDTH)), "word": rng.normal(0, 0.1, (WORD_SIZE, WORD_WIDTH))}
    for side in "fb":
        weights[f"x{side}"] = rng.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN))
        weights[f"h{side}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        weights[f"b{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return weights | {"out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, weights: Weights, side: str) -> tuple[np.ndarray, list]:
    """States over time of a batch (time, page, input), and what going back needs. Padding passes the state on."""
    steps, pages, _ = x.shape
    projected = x @ weights[f"x{side}"] + weights[f"b{side}"]
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    states, kept = np.zeros((steps, pages, HIDDEN)), []
    for t in range(steps):
        z = projected[t] + h @ weights[f"h{side}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * g
        squashed = np.tanh(new)
        kept.append((h, c, i, f, o, g, squashed, m))
        h, c = m * (o * squashed) + (1 - m) * h, m * new + (1 - m) * c
        states[t] = h
    return states, kept


def _lstm_back(x: np.ndarray, kept: list, d_states: np.ndarray, weights: Weights, side: str) -> tuple[np.ndarray, Weights]:
    steps, pages, _ = x.shape
    recurrent = weights[f"h{side}"]
    dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    dz, d_recurrent = np.zeros((steps, pages, 4 * HIDDEN)), np.zeros_like(recurrent)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, squashed, m = kept[t]
        dh = dh + d_states[t]
        d_out, carried = m * dh, (1 - m) * dh
        d_new = d_out * o * (1 - squashed**2) + m * dc
        parts = (d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_out * squashed * o * (1 - o), d_new * i * (1 - g**2))
        dz[t] = np.concatenate(parts, axis=1)
        d_recurrent += h.T @ dz[t]
        dh, dc = dz[t] @ recurrent.T + carried, d_new * f + (1 - m) * dc
    flat = dz.reshape(-1, 4 * HIDDEN)
    grads = {f"x{side}": x.reshape(-1, x.shape[2]).T @ flat, f"h{side}": d_recurrent, f"b{side}": flat.sum(axis=0)}
    return dz @ weights[f"x{side}"].T, grads


def _batch(pages: list[Page], weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (time, page, input) padded at the end, and the mask of what is no padding."""
    longest = max(len(p.measures) for p in pages)
    x, mask = np.zeros((longest, len(pages), INPUT)), np.zeros((longest, len(pages)))
    for j, page in enumerate(pages):
        n = len(page.measures)
        # Each tag of a path counts in full; of the words, the mean.
        path = _bag_sums(weights["path"], page.paths, page.path_at)
        word = _bag_sums(weights["word"], page.words, page.word_at) / np.maximum(np.diff(page.word_at), 1)[:, None]
        x[:n, j] = np.concatenate([path, word, page.measures], axis=1)
        mask[:n, j] = 1
    return x, mask


def _forward(x: np.ndarray, mask: np.ndarray, weights: Weights) -> tuple[np.ndarray, tuple]:
    ahead, kept_f = _lstm(x, mask, weights, "f")
    back, kept_b = _lstm(x[::-1], mask[::-1], weights, "b")
    both = np.concatenate([ahead, back[::-1]], axis=2)
    return _sigmoid(both @ weights["out"] + weights["bias"]), (both, kept_f, kept_b)


def probabilities(pages: list[Page], weights: Weights, together: int = 64) -> list[np.ndarray]:
    """For each page the probability of each block to be main text. Pages of similar length go together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if len(p.measures)), key=lambda i: len(pages[i].measures))
    for at in range(0, len(order), together):
        group = order[at : at + together]
        x, mask = _batch([pages[i] for i in group], weights)
        p, _ = _forward(x, mask, weights)
        for j, i in enumerate(group):
            out[i] = p[: len(pages[i].measures), j]
    return out


def _gradients(pages: list[Page], labels: list[np.ndarray], weights: Weights) -> Weights:
    x, mask = _batch(pages, weights)
    p, (both, kept_f, kept_b) = _forward(x, mask, weights)
    y = np.zeros_like(mask)
    for j, own in enumerate(labels):
        y[: len(own), j] = own
    d = mask * (p - y) / mask.sum()
    grads = {"out": np.tensordot(d, both, 2), "bias": np.array([d.sum()])}
    d_both = d[:, :, None] * weights["out"]
    dx_f, grads_f = _lstm_back(x, kept_f, d_both[:, :, :HIDDEN], weights, "f")
    dx_b, grads_b = _lstm_back(x[::-1], kept_b, d_both[::-1, :, HIDDEN:], weights, "b")
    dx = dx_f + dx_b[::-1]
    grads |= grads_f | grads_b | {"path": np.zeros_like(weights["path"]), "word": np.zeros_like(weights["word"])}
    for j, page in enumerate(pages):
        n = len(page.measures)
        d_path, d_word = dx[:n, j, :PATH_WIDTH], dx[:n, j, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH]
        in_path, in_words = np.diff(page.path_at), np.diff(page.word_at)
        np.add.at(grads["path"], page.paths, np.repeat(d_path, in_path, axis=0))
        np.add.at(grads["word"], page.words, np.repeat(d_word / np.maximum(in_words, 1)[:, None], in_words, axis=0))
    return grads


# Containers for copies of the sample: what may stand around the main text, what may hold it, and what says nothing.
_AROUND = (
    ("nav", ".menu"), ("header",), ("header", ".site"), ("footer",), ("aside",), ("aside", ".sidebar"), ("div", ".sidebar"),
    ("div", ".cookie", ".notice"), ("div", ".notice"), ("div", ".banner"), ("div", ".ad"), ("div", ".ads"), ("div", ".advert"),
    ("section", ".comments"), ("div", ".comments"), ("div", ".comment"), ("ol", ".comment", ".list"), ("form",),
    ("form", ".newsletter"), ("div", ".share"), ("div", ".social"), ("div", ".related"), ("div", ".promo"), ("ul", ".menu"),
    ("div", ".footer"), ("div", ".header"), ("div", ".nav"), ("section", ".related"), ("div", ".popup"), ("div", ".subscribe"),
    ("div", ".breadcrumb"), ("div", ".login"), ("div", ".widget"), ("button",), ("dialog",), ("label", ".search"),
    ("div", ".masthead"), ("div", ".colophon"), ("div", ".disqus"), ("div", ".pagination"), ("nav",), ("div", ".respond"),
)
_HOLDS = (
    ("article",), ("main",), ("div", ".content"), ("div", ".post"), ("section", ".story"), ("div", ".entry", ".content"),
    ("div", ".article", ".body"), ("section", "article"), ("article", "section"), ("main", "article"), ("div", ".main"), ("div", ".text"),
)
_WRAPPERS = (("div",), ("section",), ("div", ".page"), ("div", ".container"), ("div", ".wrapper"), ("div", ".row"), ("div", ".col"),
             ("div", ".site"), ("div", ".primary"), ("div", ".inner"), ("center",), ("table", "tr", "td"))
# What says nothing about a block: figures of all kinds, and compound names with a word that elsewhere marks surroundings.
_FIGURES = (("figure",), ("figure", "figcaption"), ("figure", "pre"), ("figure", "blockquote", "p"), ("figure", "table", "tr", "td"), ("figure", "table", "caption"))
_COMPOUND = ("section", "title", "block", "part", "text", "chapter", "my")
_LEAVES = ("p", "div", "li", "span", "h2", "h3", "td", "blockquote", "pre")


def _wrappers(rng: np.random.Generator, most: int) -> tuple[str, ...]:
    """Up to ``most`` containers that say nothing, of known names, of names made up, or of none."""
    out: list[str] = []
    for _ in range(int(rng.integers(0, most + 1))):
        if rng.random() < 0.4:
            letters = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(1, 9))))
            out += [("div", "section")[rng.integers(2)], f".{letters}"]
        else:
            out += _WRAPPERS[rng.integers(len(_WRAPPERS))]
    return tuple(out)


def _altered(blocks: list[Block], labels: np.ndarray, spare: list[Block], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A copy of a page in another skeleton, and with blocks put around, between and below the main text.

    The skeleton has wrappers that say nothing above everything, above what
    holds the main text, below it, and above each part around it. Now and then
    nothing names what holds the main text, and in some copies letters change
    places, as if the page were in a language not learned from.
    """
    page = ("html", "body", *((".post",) if rng.random() < 0.05 else ()), *_wrappers(rng, 4))
    holder = (*_wrappers(rng, 3), *_HOLDS[rng.integers(len(_HOLDS))], *_wrappers(rng, 2))
    if rng.random() < 0.12:
        holder = _wrappers(rng, 3)
    out, wanted = [], []
    around_words = sorted(AROUND_WORDS)
    around: dict[tuple[str, ...], tuple[str, ...]] = {}

    def neutral(path: tuple[str, ...]) -> tuple[str, ...]:
        chance = rng.random()
        if chance < 0.1:
            return (*path[:-1], *_FIGURES[rng.integers(len(_FIGURES))])
        if chance < 0.2:
            leaf = ("h2", "h3", "p", "td", "span")[rng.integers(5)]
            names = (_COMPOUND[rng.integers(len(_COMPOUND))], around_words[rng.integers(len(around_words))])
            return (*path[:-1], leaf, *(f":{w}" for w in names))
        return path

    def surroundings(inside: bool) -> None:
        container = _AROUND[rng.integers(len(_AROUND))]
        if rng.random() < 0.4:  # any of the words, now and then beside another
            container = (("div", "div", "section", "ul", "p")[rng.integers(5)], f".{around_words[rng.integers(len(around_words))]}")
            container = (*container, *((f".{around_words[rng.integers(len(around_words))]}",) if rng.random() < 0.3 else ()))
        above = (*page, *(holder if inside else _wrappers(rng, 2)), *container, *_wrappers(rng, 2))
        for _ in range(int(rng.integers(1, 5))):
            block = spare[rng.integers(len(spare))]
            leaf = _LEAVES[rng.integers(len(_LEAVES))]
            out.append(Block(neutral((*above, leaf)), block.text, len(block.text) if rng.random() < 0.3 else 0))
            wanted.append(False)

    for block, main in zip(blocks, labels):
        if rng.random() < (0.12 if main else 0.3):
            surroundings(inside=bool(main) and rng.random() < 0.8)
        own = tuple(w for w in block.path if w not in ("html", "body", "article", "main"))
        if main:
            path = (*page, *holder, *own)
            if rng.random() < 0.1:
                path = (*path[:-1], _LEAVES[rng.integers(len(_LEAVES))])
            path = neutral(path)
        else:
            # All blocks of one part stay under the same wrappers.
            path = (*page, *around.setdefault(own[:1], _wrappers(rng, 2)), *own)
        out.append(replace(block, path=path))
        wanted.append(bool(main))
    for _ in range(int(rng.integers(0, 4))):
        surroundings(inside=rng.random() < 0.5)
    if rng.random() < 0.4:
        letters = rng.permutation(26)
        table = {97 + i: 97 + int(k) for i, k in enumerate(letters)} | {65 + i: 65 + int(k) for i, k in enumerate(letters)}
        out = [replace(block, text=block.text.translate(table)) for block in out]
    return out, np.array(wanted, bool)


def _made_up(rng: np.random.Generator, pages: int) -> list[tuple[list[Block], np.ndarray]]:
    """Pages of made-up words in the built-in containers, to learn from where no page names its main text."""
    letters = np.array(list("eeeaaiioonnttrrsslldcumpfghbvkwyjz"))
    words = ["".join(rng.choice(letters, int(n))) for n in rng.integers(2, 11, 3000)]

    def text(least: int, most: int, ends: str) -> str:
        chosen = [words[int(len(words) * x * x)] for x in rng.random(int(rng.integers(least, most)))]
        return " ".join(w + ("," if rng.random() < 0.08 and ends else "") for w in chosen).capitalize() + ends

    def page() -> tuple[list[Block], np.ndarray]:
        found: list[tuple[tuple[str, ...], str, bool, bool]] = []
        found += [(("nav", "ul", "li"), text(1, 3, ""), True, False) for _ in range(int(rng.integers(0, 8)))]
        found += [(("div", ".ad"), text(3, 14, "."), False, False)] * int(rng.integers(0, 2))
        found += [(("h1",), text(3, 12, ""), False, True)] * int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 9))):
            found += [(("p",), text(8, 120, "."), False, True)] + [(("h2",), text(1, 6, ""), False, True)] * int(rng.integers(0, 2))
        found += [(("div", ".comments", "p"), text(3, 30, "."), False, False) for _ in range(int(rng.integers(0, 4)))]
        found += [(("footer", "p"), text(3, 16, "."), False, False)] * int(rng.integers(0, 2))
        blocks = [Block(("html", "body", *path), t, len(t) if linked else 0) for path, t, linked, _ in found]
        return blocks, np.array([main for *_, main in found], bool)

    return [page() for _ in range(pages)]


def fit(
    pages: DataFrame, page: str = "html", most_pages: int = 150, rounds: int = 8, most_bytes: int = MOST_LEARNED_BYTES
) -> Weights:
    """Train on the blocks of ``most_pages`` different pages, picked by a hash among those of at most ``most_bytes``.

    These are the bounds of the operator, and of what is learned from alone.
    Copies of a page count once. Pages whose markup names no main text are passed over. With none left the
    network learns from made-up pages in the built-in containers.
    """
    known = pages.where(F.octet_length(F.col(page)) <= most_bytes).select(F.col(page).alias("html"), F.lit(0).alias("all"))
    rows = sample_contents(known, "all", "html", most_pages).select(F.col("content").alias("html")).collect()
    return train(sorted(r.html for r in rows), rounds)


def train(pages: list[str], rounds: int = 8) -> Weights:
    """Weights from pages labelled by their markup, and from copies of them in other skeletons."""
    rng = np.random.Generator(np.random.PCG64(11))
    examples: list[tuple[list[Block], np.ndarray]] = []
    for text in pages:
        blocks = leaf_blocks(text)
        labels = np.array([markup_label(b.path) for b in blocks], bool)
        if labels.any():
            examples.append((blocks, labels))
    if not examples:
        examples = _made_up(rng, MADE_UP_PAGES)
    spare = [b for blocks, _ in examples for b in blocks]
    for blocks, labels in list(examples):
        examples += [_altered(blocks, labels, spare, rng) for _ in range(COPIES)]
        if rng.random() < 0.15:  # the text alone, in bare paragraphs
            bare = [Block(("p",) if rng.random() < 0.5 else (), b.text, 0) for b, main in zip(blocks, labels) if main]
            examples.append((bare, np.ones(len(bare), bool)))
    encoded = [(encode_page(blocks), labels.astype(float)) for blocks, labels in examples]
    weights = initial_weights()
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    step, steps = 0, rounds * -(-len(encoded) // 16)
    for _ in range(rounds):
        # Pages of similar length together, in random order of groups.
        order = sorted(rng.permutation(len(encoded)).tolist(), key=lambda i: len(encoded[i][1]) // 8)
        groups = [order[i : i + 16] for i in range(0, len(order), 16)]
        for g in rng.permutation(len(groups)):
            own = [encoded[i] for i in groups[g]]
            grads = _gradients([p for p, _ in own], [y for _, y in own], weights)
            step += 1
            # Steps get smaller, so that the last batches do not undo what the others taught.
            rate = 0.012 * (1 - 0.92 * step / steps)
            for k, grad in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad**2
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def extract(
    pages: DataFrame, weights: Weights, keep: list[str] | None = None, page: str = "html", at_least: float = 0.5
) -> DataFrame:
    """The columns ``keep`` of ``pages`` (all by default) with ``text`` and ``n_chars``.

    ``text`` joins the blocks found to be main text by line ends, references
    decoded and white space run together. NULL and empty pages, and pages
    without main text, have an empty one. Existing columns of the two names are replaced.
    """
    added = ("text", "n_chars")
    keep = [c for c in (pages.columns if keep is None else keep) if c not in added]
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches, 1):
            blocks = [leaf_blocks(row.decode("utf-8", "replace")) for row in utf8_rows(batch.column(1))]
            chosen = [p >= at_least for p in probabilities([encode_page(b) for b in blocks], own)]
            texts = ["\n".join(b.text for b, take in zip(page, takes) if take) for page, takes in zip(blocks, chosen)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["row", *added]
            )

    given = pages.select(carried(keep).alias("row"), F.col(page).alias("page"))
    extracted = given.mapInArrow(run, with_fields(given.select("row").schema, "text string, n_chars long"))
    return extracted.select(*(F.col("row")[c].alias(c) for c in keep), *added)
