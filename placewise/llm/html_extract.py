"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Every leaf block is article text or not. Its features are the tags and the class, id and role words of its ancestors and
the shape of its text (length, share of links, closing punctuation, place on the page). The field is trained on labelled
pages, invented layouts and a bounded sample of the table itself, by gradient steps on the regularised log-likelihood
(forward-backward over all pages at once); a page is decoded by Viterbi.

Pages of the sample are labelled by their own markup: text inside ``article`` or ``main`` but outside nested menus,
asides, forms, headers and comments is article text. Pages without such an element are not used for training.

A null page is empty and gives empty text; markup that breaks off is read as far as it goes. Repeated rows give repeated
results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placewise.llm import common as C
from placewise.llm.html_blocks import Block, leaf_blocks
from placewise.llm.page_layouts import labelled_pages

SCHEMA = "page_id long, url string, text string, n_chars long"
LAYOUT_PAGES = 600
SAMPLE_PAGES = 200  # expected size of the sample from the table; at most twice as many
SAMPLE_CHARS = 200_000  # longer pages are left out of the training sample, not of the extraction
STEPS = 150
DECAY = 1e-4
INNER = {"nav", "aside", "form", "footer"}
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Words in class, id and role that say what an element is for
PURPOSE = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs",
    "header": "header masthead logo banner branding hero",
    "footer": "footer copyright colophon",
    "side": "sidebar side widget related recommended recommend more popular trending complementary",
    "advert": "ad ads advert adverts advertisement adsbygoogle promo promotion promoted sponsor sponsored",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer privacy",
    "form": "form search login signup newsletter subscribe subscription share social",
    "comment": "comment comments reply replies discussion responses respond disqus reader user review reviews",
    "article": "article content post entry story text body main blog page",
}
PURPOSE_OF = {w: k for k, words in PURPOSE.items() for w in words.split()}


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        found = {"any", "leaf " + next((e.tag for e in reversed(b.path)), "none")}
        for e in b.path:
            found.add("in " + e.tag)
            if e.names:
                for word in SPLIT.findall(e.names):
                    if word.lower() in PURPOSE_OF:
                        found.add("for " + PURPOSE_OF[word.lower()])
            if e.hidden:
                found.add("hidden")
        purposes = sorted(f for f in found if f.startswith("for "))
        found.update("main & " + p for p in purposes if "in article" in found or "in main" in found)
        size = len(b.text)
        found.add(f"size {min(size.bit_length(), 11)}")
        found.add(f"links {round(4 * min(b.linked / size, 1))}")
        found.add("ends " + ("stop" if b.text[-1] in ".!?:;\"'”’…" else "word"))
        found.add(f"place {5 * i // n}")
        if "©" in b.text or "copyright" in b.text.lower():
            found.add("copyright")
        if i and [e.tag for e in blocks[i - 1].path] == [e.tag for e in b.path]:
            found.add("as before")
        out.append(sorted(found))
    return out


class Field:
    """Weights of the field: one per feature and label, and one per pair of neighbouring labels."""

    def __init__(self, names: list[str]):
        self.index = {f: i for i, f in enumerate(names)}
        self.weights = np.zeros((len(names), 2))
        self.moves = np.zeros((2, 2))

    def scores(self, found: list[list[str]]) -> np.ndarray:
        """Unary score of each block under each label."""
        rows = [[self.index[f] for f in fs if f in self.index] for fs in found]
        flat = np.fromiter((i for r in rows for i in r), np.int64)
        sums = np.concatenate((np.zeros((1, 2)), np.cumsum(self.weights[flat], axis=0)))
        ends = np.cumsum([len(r) for r in rows])
        return sums[ends] - sums[np.concatenate(([0], ends[:-1]))]

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best sequence of labels (Viterbi)."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        unary = scores.tolist()
        best0, best1 = unary[0]
        back = []
        for u0, u1 in unary[1:]:
            a0, a1, b0, b1 = best0 + m00, best1 + m10, best0 + m01, best1 + m11
            back.append((a1 > a0, b1 > b0))
            best0, best1 = max(a0, a1) + u0, max(b0, b1) + u1
        label = best1 > best0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return np.array(out[::-1], bool)

    def fit(self, pages: list[list[list[str]]], labels: list[np.ndarray], steps: int = STEPS) -> None:
        """Gradient steps on the mean log-likelihood of the label sequences, with an L2 penalty."""
        n, longest = len(pages), max(map(len, pages))
        inside = np.arange(longest)[None, :] < np.array([len(p) for p in pages])[:, None]
        hot = np.zeros((int(inside.sum()), len(self.index)), np.float32)
        row = 0
        for page in pages:
            for found in page:
                hot[row, [self.index[f] for f in found if f in self.index]] = 1
                row += 1
        gold = np.zeros((n, longest, 2))
        gold[inside, np.concatenate(labels).astype(int)] = 1
        pair = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
        params = [self.weights, self.moves]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            unary = np.zeros((n, longest, 2))
            unary[inside] = hot @ self.weights.astype(np.float32)
            single, double = self._marginals(unary, inside)
            slopes = [hot.T @ (gold[inside] - single[inside]).astype(np.float32) / n - DECAY * self.weights,
                      (pair - double) / n - DECAY * self.moves]
            for p, g, m, s in zip(params, slopes, mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)

    def _marginals(self, unary: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each label per block, and expected numbers of each pair of neighbours."""
        n, longest, _ = unary.shape
        here = np.where(inside[..., None], np.exp(unary - unary.max(axis=2, keepdims=True)), 1.0)
        move = np.exp(self.moves - self.moves.max())
        forward, backward = np.ones_like(here), np.ones_like(here)  # scaled to sum 1 at each place
        forward[:, 0] = here[:, 0] / here[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            new = (forward[:, t - 1] @ move) * here[:, t]
            forward[:, t] = np.where(inside[:, t, None], new / new.sum(axis=1, keepdims=True), forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = (backward[:, t + 1] * here[:, t + 1]) @ move.T
            backward[:, t] = np.where(inside[:, t + 1, None], new / new.sum(axis=1, keepdims=True), backward[:, t + 1])
        single = forward * backward
        single /= single.sum(axis=2, keepdims=True)
        left, right = forward[:, :-1][inside[:, 1:]], (here * backward)[:, 1:][inside[:, 1:]]
        between = left[:, :, None] * move * right[:, None, :]
        return single, (between / between.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def layout_labels(blocks: list[Block]) -> np.ndarray:
    """Labels of a written page: inside ``data-main``, but not inside an insertion."""
    marks = ([e for e in b.path if e.main or e.other] for b in blocks)
    return np.array([bool(m) and m[-1].main for m in marks])


def markup_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels by the page's own elements, or null if it has neither ``article`` nor ``main``."""
    if not any(e.tag in ("article", "main") for b in blocks for e in b.path):
        return None

    def is_main(b: Block) -> bool:
        at = max((i for i, e in enumerate(b.path) if e.tag in ("article", "main")), default=-1)
        inner = b.path[at + 1:]
        words = {w.lower() for e in b.path for w in SPLIT.findall(e.names)}
        return at >= 0 and not any(e.tag in INNER for e in inner) and not words & set(PURPOSE["comment"].split())

    return np.array([is_main(b) for b in blocks])


def fit_field(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE_PAGES,
              layouts: int = LAYOUT_PAGES) -> Field:
    """A field trained on written layouts and a bounded sample of the table (by a hash of the id)."""
    draw = F.pmod(F.xxhash64(F.lit("page sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    few = pages.where(draw < sample / max(pages.count(), 1)).select(F.col(html_col).alias("html"))
    few = few.where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    drawn = [r.html for r in few.limit(2 * sample).collect()]
    blocks, labels = [], []
    for page in labelled_pages(layouts):
        found = leaf_blocks(page)
        if found:
            blocks.append(found)
            labels.append(layout_labels(found))
    for page in drawn:
        found = leaf_blocks(page)
        marked = markup_labels(found) if found else None
        if marked is not None:
            blocks.append(found)
            labels.append(marked)
    described = [features(b) for b in blocks]
    field = Field(sorted({f for page in described for found in page for f in found}))
    field.fit(described, labels)
    return field


def main_text(page: str, field: Field) -> str:
    """Article blocks in page order, a line each."""
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    chosen = field.decode(field.scores(features(blocks)))
    return "\n".join(b.text for b, yes in zip(blocks, chosen) if yes)


def extract_pages(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(field)  # one weight per feature seen in the training pages

    def one(batch):
        texts = [main_text(h or "", shared.value) for h in batch.column("text").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    rows = C.narrow(pages, page_id=pages[id_col].cast("long"), url=pages[url_col].cast("string"), text=html_col)
    return C.per_chunk(rows, SCHEMA, one)
