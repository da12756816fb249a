"""Main text of web pages: leaf blocks labelled by a recurrent model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from steepgrid.llm.block_labeller import Recurrent, padded
from steepgrid.llm.words import batched, rows_of

SAMPLE = 400  # pages that the labeller learns from
SAMPLE_BLOCKS = 400  # blocks of a sampled page that it learns from
EPOCHS = 8
SEED = 3
PATHS, WORDS, NUMBERS = 256, 64, 6
TOGETHER = 2048  # blocks labelled in one batch, or one page

# Elements of HTML by how they part text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template svg math iframe object canvas audio video".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
# What marks a block as outside the article, for the weak labels.
OUTSIDE_TAGS = set("head title nav footer aside form menu button select option label textarea dialog".split())
OUTSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav "
    "navigation navbar breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert "
    "comment comments reply replies respond discussion disqus share sharing social related recommended newsletter subscribe "
    "subscription signup login modal popup overlay pagination pager widget toolbar search copyright legal form tags meta".split()
)
INSIDE_TAGS = {"article", "main"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.DOTALL
)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    path: tuple[str, ...]  # open elements, each a tag followed by words of its class, id and role
    text: str
    linked: int  # characters inside links


def blocks_of(html: str | None) -> list[Block]:
    """Leaf blocks in page order: runs of text that no block element interrupts.

    Scripts, styles and comments are left out; missing and stray end tags are borne as browsers bear them.
    """
    html = html or ""
    open_tags: list[tuple[str, str]] = []
    held: list[str] = []
    out: list[Block] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(Block(tuple(mark for tag, mark in open_tags if tag not in INLINE), text, linked))
            held.clear()
        linked = 0

    def close(tags: set[str], barrier: set[str]) -> None:
        """Close the innermost open element of ``tags``, unless one of ``barrier`` is around it."""
        nonlocal links
        for at in range(len(open_tags) - 1, -1, -1):
            if open_tags[at][0] in tags:
                for tag, _ in open_tags[at:]:
                    links -= tag == "a"
                del open_tags[at:]
                return
            if open_tags[at][0] in barrier:
                return

    at = 0
    while True:
        found = _TOKEN.search(html, at)
        text = html[at : found.start() if found else len(html)]
        if text:
            held.append(text)
            if links:
                linked += len(text)
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if tag in UNSEEN:
            if not found[1] and not found[0].endswith("/>"):
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag not in INLINE:
            flush()
        if found[1]:
            if any(t == tag for t, _ in open_tags):
                close({tag}, set())
            continue
        if tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, {"td", "th", "table", "button", "object"})
        if tag in SIBLINGS:
            close(SIBLINGS[tag], {"ul", "ol", "dl", "table", "select"})
        words = " ".join(x.lower() for m in _MARK.findall(found[3]) for x in m if x)
        open_tags.append((tag, f"{tag} {words}" if words else tag))
        links += tag == "a"
    flush()
    return out


def weak_label(block: Block, has_inside: bool) -> int:
    """1 for text of the article by the page's own markers: what the labeller is taught."""
    inside = False
    for mark in block.path:
        tag, _, words = mark.partition(" ")
        if tag in OUTSIDE_TAGS or OUTSIDE_WORDS.intersection(_PART.findall(words)):
            return 0
        if tag == "header" and not inside:
            return 0
        inside = inside or tag in INSIDE_TAGS
    if has_inside:
        return int(inside)
    return int(2 * block.linked <= len(block.text))


def weak_labels(blocks: list[Block]) -> list[int]:
    has = any(mark.partition(" ")[0] in INSIDE_TAGS for b in blocks for mark in b.path)
    return [weak_label(b, has) for b in blocks]


_places: dict[str, int] = {}


def _place(word: str, size: int) -> int:
    key = f"{size} {word}"
    if key not in _places:
        if len(_places) > 200_000:
            _places.clear()
        _places[key] = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass")) % size
    return _places[key]


def vectors_of(blocks: list[Block]) -> np.ndarray:
    """Per block: hashed elements and marks of its path, hashed words, and a few numbers."""
    out = np.zeros((len(blocks), PATHS + WORDS + NUMBERS), np.float32)
    for i, b in enumerate(blocks):
        for mark in b.path:
            for part in _PART.findall(mark):
                out[i, _place(part, PATHS)] = 1
        out[i, _place("own " + (b.path[-1].partition(" ")[0] if b.path else ""), PATHS)] = 1
        words = b.text.lower().split(" ")
        for w in set(words):
            out[i, PATHS + _place(w, WORDS)] += len(words) ** -0.5
        out[i, PATHS + WORDS :] = (
            np.log1p(len(b.text)) / 5,
            min(1.0, b.linked / max(1, len(b.text))),
            b.text[-1] in ".!?",
            i / len(blocks),
            len(words) < 4,
            1.0,
        )
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vectors", pa.binary()), ("labels", pa.binary())])

    def rows():
        for (html,) in rows_of(batches, "html"):
            found = blocks_of(html)
            if found:
                labels = weak_labels(found)[:SAMPLE_BLOCKS]
                yield vectors_of(found)[:SAMPLE_BLOCKS].tobytes(), bytes(labels)

    yield from batched(rows(), schema, 64)


def label_pages(model: Recurrent, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block is main text; pages of like length go through the model together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = iter(sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i])))
    for i in order:
        group = [i, *islice(order, max(0, TOGETHER // len(pages[i]) - 1))]
        x, real, _ = padded([(vectors_of(pages[j]), np.zeros(len(pages[j]))) for j in group])
        odds = model.log_odds(x, real)
        for j, row in zip(group, odds):
            out[j] = row[: len(pages[j])] > 0
    return out


def _extract(model: Recurrent):
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("blocks", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held = rows_of(batches, "page_id", "url", "html")
            while some := list(islice(held, 128)):
                pages = [blocks_of(html) for _, _, html in some]
                for (key, url, _), found, main in zip(some, pages, label_pages(model, pages)):
                    text = "\n".join(b.text for b, keep in zip(found, main) if keep)
                    yield key, url, text, len(text), len(found)

        yield from batched(rows(), schema, 512)

    return run


def extract_main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    sample: int = SAMPLE,
) -> DataFrame:
    """The article of every page, block by block, as a bidirectional LSTM labels them.

    A page becomes a sequence of leaf blocks with character references decoded and white space made single blanks. Each
    block is described by its hashed path of elements, classes and roles, its hashed words and a few numbers. The labeller
    is trained in numpy on a bounded sample of pages, drawn by the digest of the id, whose labels come from what the
    pages say of themselves (``weak_label``); paths of some blocks are hidden in training. It then labels all blocks
    of all pages, each in the context of its whole page.

    Returns ``page_id, url, text, n_chars, blocks``. Null and empty html give an empty text. Repeated rows and null ids are
    extracted each by itself; a long page is one long sequence; an empty table gives an empty result; other
    columns are ignored.
    """
    given = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    drawn = (
        given.where("html <> ''")
        .select(F.xxhash64("page_id", F.lit(SEED)).alias("_draw"), "html")
        .orderBy("_draw")
        .limit(sample)
        .select("html")
    )
    examples = drawn.mapInArrow(_examples, "vectors binary, labels binary").collect()
    width = PATHS + WORDS + NUMBERS
    taught = [
        (np.frombuffer(r["vectors"], np.float32).reshape(-1, width), np.frombuffer(r["labels"], np.uint8)) for r in examples
    ]
    model = Recurrent(width, SEED)
    if taught:
        model.train(taught, EPOCHS, SEED, blank=0.1, paths=PATHS)
    out = given.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long, blocks long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
