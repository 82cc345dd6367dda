"""Main text of web pages: boosted trees over element features, decoded from the root down."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcast.llm.boosting import Trees, boost
from seqcast.llm.html_tree import Tree, node_features, parse
from seqcast.llm.sampling import smallest_hashes
from seqcast.sources.ship import ship_package

# Pages to learn from, at most (those with the smallest hashes of their ids), how long they may be, and layouts made of each.
MOST_PAGES = 150
MOST_CHARS = 20_000
LAYOUTS = 5
SEED = 11
# What it costs to treat parts of an element differently.
SPLIT_COST = 1.0
SURE = 4.0

#: Marks text of made layouts that is not the article's.
NOISE = ""

# Names that made layouts take their elements from.
ARTICLES = ("article", "article class=post", "main", "main id=main", "div class=content", "div id=main-content", "div class='post-body entry'",
            "section class=story", "div class=article-text", "div", "section", "td class=text", "div id=page", "div role=main")
MENUS = ("nav", "ul class=menu", "div id=navbar", "div class=breadcrumbs", "nav class=main-nav", "div class=topnav", "div class=pagination", "div role=navigation")
EDGES_BEFORE = ("header", "div class=header", "div id=masthead", "header class=site-header")
EDGES_AFTER = ("footer", "div class=footer", "div id=copyright", "footer class=site-footer", "div role=contentinfo")
SIDES = ("aside", "div class=sidebar", "div class=related", "section class=widget", "aside id=recommended", "div class='side-rail popular'")
ADVERTS = ("div class=ad", "div class=advert", "div class=ad-banner", "ins class=adsbygoogle", "div id=promo", "aside class=sponsored", "p class=advertisement")
NOTICES = ("div class=cookie-notice", "div id=cookie-consent", "div class=alert", "div role=alert", "div class='popup modal'", "div id=gdpr-banner", "div class=notice")
FORMS = ("form", "form class=newsletter", "div class=subscribe", "form id=search", "div class=login-form")
COMMENTS = ("section class=comments", "div id=comments", "div class=replies", "ol class=comment-list", "div id=disqus_thread", "section id=responses class=discussion")
SHARES = ("div class=share", "ul class=social", "div class=tags", "p class=byline")


class Layouts:
    """Pages made of real pages' paragraphs in many layouts, so that the article's text is known whatever the markup."""

    def __init__(self, seed: int, pool: list[str]) -> None:
        self.rng, self.pool = np.random.default_rng(seed), pool or ["Words that stand on no page of the table."]

    def _one(self, names: Iterable[str]) -> str:
        names = list(names)
        return names[self.rng.integers(len(names))]

    def _chance(self, p: float) -> bool:
        return self.rng.random() < p

    def _noise(self, words: int | None = None) -> str:
        text = self._one(self.pool)
        return NOISE + (" ".join(text.split()[:words]) if words else text)

    def _wrap(self, name: str, inside: str) -> str:
        return f"<{name}>{inside}</{name.split()[0]}>"

    def _links(self, n: int) -> str:
        item = self._one(("<li><a href=/x>{}</a></li>", "<a href=/x>{}</a> ", "<div><a href=/x>{}</a></div>"))
        inside = "".join(item.format(self._noise(int(self.rng.integers(1, 4)))) for _ in range(n))
        return f"<ul>{inside}</ul>" if item.startswith("<li") else inside

    def _prose(self) -> str:
        text = self._noise(int(self.rng.integers(3, 40)))
        return text if self._chance(0.5) else f"<p>{text}</p>"

    def _comments(self) -> str:
        item = self._one(("<div class=comment><p>{}</p><p>{}</p></div>", "<li><b>{}</b><p>{}</p></li>", "<article class=comment><p>{}</p><p>{}</p></article>",
                          "<div><span>{}</span> {}</div>"))
        return self._wrap(self._one(COMMENTS), f"<h3>{self._noise(2)}</h3>" + "".join(
            item.format(self._noise(2), self._noise()) for _ in range(self.rng.integers(1, 6))))

    def _piece(self) -> str:
        kind = self.rng.integers(8)
        if kind == 0:
            return self._wrap(self._one(MENUS), self._links(int(self.rng.integers(2, 8))))
        if kind == 1:
            return self._wrap(self._one(SIDES), f"<h3>{self._noise(3)}</h3>" + (self._links(4) if self._chance(0.6) else self._prose() * 2))
        if kind in (2, 3):
            return self._wrap(self._one(ADVERTS), self._prose())
        if kind == 4:
            return self._wrap(self._one(NOTICES), self._prose() + (f"<button>{self._noise(1)}</button>" if self._chance(0.7) else ""))
        if kind == 5:
            return self._wrap(self._one(FORMS), f"<label>{self._noise(3)}</label><input><button>{self._noise(1)}</button>" + (self._prose() if self._chance(0.5) else ""))
        if kind == 6:
            return self._wrap(self._one(SHARES), self._links(3))
        return self._comments()

    def page(self, title: str, paragraphs: list[str]) -> str:
        """One page; noise carries its mark."""
        style = self._one(("<p>{}</p>",) * 4 + ("<p>{}", "<div>{}</div>", "<p><b>{}<br>", "<p>{}<a href=/y>link</a></p>"))
        heading = self._one(("<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>", "<h1 class=title>{}</h1>"))
        body = [heading.format(title)]
        for text in paragraphs:
            kind = self.rng.random()
            if kind < 0.08:
                body.append("<ul>" + "".join(f"<li>{t}.</li>" for t in text.split(". ")[:5]) + "</ul>")
            elif kind < 0.12:
                body.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.17:
                body.append(f"<h3>{' '.join(text.split()[:4])}</h3>")
            elif kind < 0.2:
                body.append(f"<table><tr><td>{'</td><td>'.join(text.split()[:6])}</td></tr></table>")
            else:
                body.append(style.format(text))
            if self._chance(0.06):
                body.append(self._piece())
        if self._chance(0.15):
            body.append(self._comments())
        inside = "".join(body)
        name = self._one(ARTICLES)
        main = f"<table><tr><{name}>{inside}</td></tr></table>" if name.startswith("td") else self._wrap(name, inside)
        before = [self._piece() for _ in range(self.rng.integers(0, 3))]
        if self._chance(0.6):
            before.insert(0, self._wrap(self._one(EDGES_BEFORE), f"<a href=/>{self._noise(2)}</a>" + (self._prose() if self._chance(0.5) else "")))
        if self._chance(0.6):
            before.insert(1, self._wrap(self._one(MENUS), self._links(6)))
        after = [self._piece() for _ in range(self.rng.integers(0, 3))] + ([self._comments()] if self._chance(0.3) else [])
        if self._chance(0.8):
            after.append(self._wrap(self._one(EDGES_AFTER), f"&copy; {self._noise(6)}" + (self._links(2) if self._chance(0.4) else "")))
        if self._chance(0.3):
            main = self._wrap(self._one(("div", "div class=wrapper", "div id=page", "div class=container", "div class=row")), "".join(before) + main + "".join(after))
            before, after = [], []
        return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def _article_blocks(tree: Tree) -> list[str]:
    """Blocks inside an ``article`` or ``main`` element, the teacher's plain sign of an article."""
    inside = [False] * len(tree.tags)
    for i, p in enumerate(tree.parents):
        inside[i] = tree.tags[i] in ("article", "main") or (p >= 0 and inside[p])
    return [t for o, t in zip(tree.owners, tree.texts, strict=True) if inside[o]]


def _examples(tree: Tree, noise: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of elements whose text is all the article's or all not."""
    n = len(tree.tags)
    bad, every = np.zeros(n), np.zeros(n)
    for owner, text, is_noise in zip(tree.owners, tree.texts, noise, strict=True):
        while owner >= 0:
            every[owner] += len(text)
            bad[owner] += len(text) * is_noise
            owner = tree.parents[owner]
    share = bad / np.maximum(every, 1)
    use = (every > 0) & ((share < 0.05) | (share > 0.95))
    return node_features(tree)[use], (share[use] < 0.5).astype(float)


def train_extractor(pages: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> Trees:
    """Fit trees to pages that mark their article with an ``article`` or ``main`` element, and to layouts made of their text."""
    trees = [parse(p) for p in pages]
    articles = [_article_blocks(t) for t in trees]
    pool = [s for a in articles for t in a[1:4] for s in (t, t.split(". ")[0])]
    make = Layouts(seed, pool)
    examples = []
    for tree, article in zip(trees, articles, strict=True):
        if article:
            kept = set(article)
            examples.append(_examples(tree, [t not in kept for t in tree.texts]))
    texts = [a for a in articles if len(a) > 1] or [["A title", "A first paragraph, with some words in it.", "And a second. It ends here."]] * 20
    for article in texts:
        for _ in range(layouts):
            body = article[1: 1 + make.rng.integers(1, 12)]
            if make.rng.random() < 0.25:  # an article may be shorter than what surrounds it
                body = [article[-1].split(". ")[0]]
            made = parse(make.page(article[0], body))
            examples.append(_examples(made, [NOISE in t for t in made.texts]))
    return boost(np.concatenate([x for x, _ in examples]), np.concatenate([y for _, y in examples]))


def decode(tree: Tree, margin: np.ndarray) -> list[bool]:
    """Which blocks to keep, with no contradiction between an element and those in it.

    An element is kept whole, dropped whole, or split: then its own blocks follow its own margin, each child decides for itself, and
    ``SPLIT_COST`` is paid. Every block weighs the logarithm of its length. The best assignment is found from the leaves up and read
    from the root down.
    """
    n = len(tree.tags)
    margin = np.clip(margin, -SURE, SURE).tolist()
    weight = [0.0] * n
    for owner, text in zip(tree.owners, tree.texts, strict=True):
        weight[owner] += np.log1p(len(text))
    keep = [m * w for m, w in zip(margin, weight, strict=True)]
    split = [abs(k) - SPLIT_COST for k in keep]
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        best[i] = max(keep[i], -keep[i], split[i])
        p = tree.parents[i]
        if p >= 0:
            keep[p] += keep[i]
            split[p] += best[i]
    state = [0] * n
    for i in range(n):
        p = tree.parents[i]
        if p >= 0 and state[p]:
            state[i] = state[p]
        elif best[i] == keep[i]:
            state[i] = 1
        elif best[i] == -keep[i]:
            state[i] = -1
    return [state[o] > 0 or (state[o] == 0 and margin[o] > 0) for o in tree.owners]


def extract(pages: list[str], model: Trees) -> list[str]:
    trees = [parse(p) for p in pages]
    margins = model.margin(np.concatenate([node_features(t) for t in trees])) if trees else np.zeros(0)
    out, at = [], 0
    for tree in trees:
        kept = decode(tree, margins[at: at + len(tree.tags)])
        at += len(tree.tags)
        out.append("\n\n".join(t for t, k in zip(tree.texts, kept, strict=True) if k))
    return out


def _extract_task(model: Trees):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = extract([h or "" for h in part.column("html").to_pylist()], model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return task


def main_text(pages: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: the article's blocks in page order, two line ends between them.

    The trees are fitted here to at most ``most_pages`` pages of at most ``MOST_CHARS`` characters whose markup names the article, and to layouts made of
    them with other markup, adverts, notices, forms and comments. Then each page is read, classified element by
    element and decoded in the task that holds it; nothing is shuffled.

    Null and empty html give an empty text. Repeated rows and null ids are extracted as they come. Without pages to learn from, the trees
    know the made layouts alone. An empty table gives no rows; other columns are ignored.
    """
    ship_package(pages.sparkSession.sparkContext)
    html = pages.select("page_id", "url", "html")
    # Ids first, then the few pages. Of pages that share an id one is taken.
    usable = (F.length("html") <= MOST_CHARS) & F.col("html").rlike("(?i)<(article|main)[ >]") & F.col("page_id").isNotNull()
    chosen = smallest_hashes(html.filter(usable).select("page_id"), "page_id", most_pages).distinct()
    learned = html.filter(usable).join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).collect()
    model = train_extractor([r["html"] for r in sorted(learned, key=lambda r: r["page_id"])])
    return html.mapInArrow(_extract_task(model), "page_id long, url string, text string, n_chars long")
