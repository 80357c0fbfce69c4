"""Main text of web pages: flat text blocks, features of a block and its neighbours, a decision tree.

A page is one pass of a tag scanner that never fails on broken markup. Text between block-level tags is a block.
Its features: words, link density, the same of the block before and after, whether it stands in a part of the page
that names itself page furniture (tag, role, class or id; 0.5 where a name only hints at it) or as article, and whether it is a heading. The tree (CART,
Gini) is trained at first use on the labelled table LABELLED below.

Defined cases: null and empty html give an empty text; equal pages give equal texts; repeated rows are read each; hidden elements and formulas
are text like any other; an empty table gives no rows; pages of any length are read whole, nothing is cut off or capped;
columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, declarations, tags. A quote counts only behind an equals sign, as browsers read it; loops do not go back, so broken markup costs no more.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
RAW = {x: re.compile(rf"</{x}\b[^>]*>", re.I) for x in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "canvas", "video", "audio", "xmp", "noembed", "noframes")}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Block-level tags that close an open p.
NESTS = BLOCKS - {"p", "link", "meta"}
FURNITURE = frozenset("nav footer aside form menu dialog button label fieldset search".split())
NAMES = re.compile(r"""(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer|foot|header|masthead|sidebar\w*|side|widget\w*|cookies?|consent|notice|gdpr|popup|modal|overlay|comments?|disqus|replies|respond|discussion|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|toolbar|pagination|pager|skip|copyright|legal|alert)(?=$|[\s_-])""", re.I)
#: Parts of names that say nothing for or against, names of what holds the article, and prefixes that speak of another element.
NEUTRAL = re.compile(r"site|page|top|bottom|left|right|global|primary|secondary|area|box|bar|list|container|wrapper|wrap|block|section|items?|links?|btn|button|inner|outer|group|icons?|the|my|js|\d+", re.I)
HOLDS = frozenset("layout content page main article post entry story".split())
SPEAKS = frozenset("has no with without".split())
HEADER = re.compile(r"(?:^|(?<=[\s_-]))header(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "furniture", "article", "heading")
#: Labelled blocks in the order of FEATURES, then 1 for main text. Densities are shares of linked words; furniture is 0.5 where a name only hints at it.
LABELLED = (
    (42, 0.0, 12, 0.0, 60, 0.0, 0, 1, 0, 1), (118, 0.02, 42, 0.0, 75, 0.0, 0, 1, 0, 1), (9, 0.0, 3, 1.0, 80, 0.0, 0, 1, 1, 1),
    (6, 0.0, 90, 0.0, 64, 0.0, 0, 1, 1, 1), (1, 0.0, 40, 0.0, 33, 0.0, 0, 1, 0, 1), (3, 0.0, 25, 0.0, 2, 1.0, 0, 1, 0, 1),
    (14, 0.3, 55, 0.0, 48, 0.0, 0, 1, 0, 1), (5, 1.0, 51, 0.0, 70, 0.0, 0, 1, 0, 1), (2, 0.0, 1, 1.0, 1, 1.0, 0, 1, 1, 1),
    (240, 0.0, 7, 0.0, 0, 0.0, 0, 1, 0, 1), (16, 0.1, 14, 0.0, 18, 0.05, 0, 1, 0, 1), (21, 0.0, 0, 0.0, 12, 0.0, 0, 1, 0, 1),
    (55, 0.0, 6, 0.0, 61, 0.0, 0, 0, 0, 1), (80, 0.05, 33, 0.0, 47, 0.1, 0, 0, 0, 1), (25, 0.0, 70, 0.0, 90, 0.0, 0, 0, 0, 1),
    (8, 0.0, 2, 1.0, 66, 0.0, 0, 0, 1, 1), (5, 0.0, 88, 0.0, 41, 0.0, 0, 0, 1, 1), (31, 0.0, 18, 0.0, 20, 0.0, 0, 0, 0, 1),
    (12, 0.0, 63, 0.0, 58, 0.0, 0, 0, 0, 1), (150, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 1), (44, 0.2, 52, 0.0, 39, 0.0, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 1, 0, 0, 0), (14, 0.0, 2, 1.0, 9, 0.0, 1, 0, 0, 0),
    (30, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0), (45, 0.0, 80, 0.0, 22, 0.0, 1, 0, 0, 0), (4, 0.0, 45, 0.0, 30, 0.0, 1, 0, 1, 0),
    (25, 0.0, 4, 0.0, 28, 0.0, 1, 1, 0, 0), (60, 0.0, 25, 0.0, 31, 0.0, 1, 1, 0, 0), (90, 0.1, 12, 0.0, 5, 1.0, 1, 0, 0, 0),
    (3, 0.0, 90, 0.0, 40, 0.0, 1, 1, 1, 0), (7, 0.5, 12, 0.0, 6, 0.8, 1, 0, 0, 0), (120, 0.0, 30, 0.0, 60, 0.0, 1, 0, 0, 0),
    (1, 1.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (3, 1.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0), (6, 0.8, 5, 1.0, 7, 0.9, 0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (12, 0.9, 10, 0.9, 11, 0.9, 0, 0, 0, 0),
    (5, 0.0, 0, 0.0, 4, 0.0, 0, 0, 0, 0), (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 0, 0), (20, 0.7, 14, 0.8, 30, 0.6, 0, 0, 0, 0),
    # outside <article>: last paragraphs, paragraphs before headings, before link blocks and after them
    (13, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1), (28, 0.0, 44, 0.0, 0, 0.0, 0, 0, 0, 1), (70, 0.05, 35, 0.0, 0, 0.0, 0, 0, 0, 1), (7, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0, 1),
    (18, 0.0, 30, 0.0, 3, 0.0, 0, 0, 0, 1), (35, 0.1, 4, 0.0, 5, 0.0, 0, 0, 0, 1), (66, 0.0, 3, 0.0, 8, 0.0, 0, 0, 0, 1), (9, 0.0, 5, 0.0, 2, 0.0, 0, 0, 0, 1),
    (22, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 1), (48, 0.15, 20, 0.0, 30, 0.8, 0, 0, 0, 1), (11, 0.0, 25, 0.0, 16, 1.0, 0, 0, 0, 1), (75, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0, 1),
    (16, 0.25, 6, 1.0, 1, 1.0, 0, 0, 0, 1), (8, 0.1, 12, 0.0, 5, 1.0, 0, 0, 0, 1), (40, 0.3, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (14, 0.0, 0, 0.0, 20, 0.7, 0, 0, 0, 1),
    # outside <article>: short items of lists, and headings before anything
    (6, 0.0, 5, 0.0, 7, 0.0, 0, 0, 0, 1), (3, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 1), (2, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 1), (4, 0.0, 24, 0.0, 3, 0.0, 0, 0, 0, 1),
    (2, 0.0, 5, 0.0, 38, 0.0, 0, 0, 0, 1), (5, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 1), (1, 0.0, 2, 0.0, 1, 0.0, 0, 0, 0, 1), (4, 0.2, 6, 0.0, 5, 0.0, 0, 0, 0, 1),
    (3, 0.0, 20, 0.0, 6, 0.0, 0, 0, 1, 1), (2, 0.0, 40, 0.0, 3, 0.0, 0, 0, 1, 1), (7, 0.0, 0, 0.0, 4, 0.0, 0, 0, 1, 1), (4, 0.0, 30, 0.0, 12, 0.3, 0, 0, 1, 1),
    # within <article>: before and among link blocks
    (60, 0.0, 40, 0.0, 30, 0.8, 0, 1, 0, 1), (15, 0.0, 22, 0.0, 14, 1.0, 0, 1, 0, 1), (110, 0.0, 50, 0.0, 40, 0.6, 0, 1, 0, 1), (6, 0.0, 14, 1.0, 25, 0.9, 0, 1, 0, 1),
    (30, 0.1, 16, 0.7, 18, 0.5, 0, 1, 0, 1), (4, 0.0, 33, 0.0, 13, 0.9, 0, 1, 1, 1), (13, 0.6, 40, 0.0, 0, 0.0, 0, 1, 0, 1), (24, 0.4, 30, 0.8, 28, 0.7, 0, 1, 0, 1),
    # outside <article>: lists of links, also beside prose
    (2, 1.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0), (4, 1.0, 2, 1.0, 35, 0.0, 0, 0, 0, 0), (8, 0.9, 60, 0.0, 50, 0.0, 0, 0, 0, 0), (15, 1.0, 13, 1.0, 18, 0.9, 0, 0, 0, 0),
    (25, 0.8, 20, 0.0, 0, 0.0, 0, 0, 0, 0), (5, 1.0, 3, 0.0, 6, 1.0, 0, 0, 0, 0), (3, 1.0, 5, 0.0, 4, 0.0, 0, 0, 0, 0), (40, 0.75, 25, 0.0, 30, 0.0, 0, 0, 0, 0),
    (90, 0.9, 4, 0.0, 0, 0.0, 0, 0, 0, 0), (12, 0.6, 30, 0.0, 2, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (110, 0.65, 70, 0.0, 60, 0.0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0), (1, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0),
    (6, 0.5, 2, 1.0, 30, 0.0, 0, 0, 0, 0), (18, 0.7, 40, 0.0, 90, 0.0, 0, 0, 0, 0), (9, 1.0, 45, 0.0, 80, 0.0, 0, 0, 0, 0), (30, 1.0, 0, 0.0, 70, 0.0, 0, 0, 0, 0),
    (2, 0.7, 13, 0.0, 14, 1.0, 0, 0, 0, 0), (200, 1.0, 50, 0.0, 12, 0.0, 0, 0, 0, 0), (7, 0.7, 2, 0.0, 66, 0.0, 0, 0, 0, 0), (50, 0.9, 90, 0.0, 1, 1.0, 0, 0, 0, 0),
    # names that hint at furniture: prose and headings, lists of links and short notes
    (60, 0.0, 40, 0.0, 55, 0.0, 0.5, 0, 0, 1), (20, 0.0, 3, 1.0, 0, 0.0, 0.5, 0, 0, 1), (35, 0.2, 8, 0.0, 90, 0.0, 0.5, 1, 0, 1), (14, 0.0, 25, 0.0, 4, 0.0, 0.5, 0, 0, 1),
    (5, 0.0, 2, 1.0, 40, 0.0, 0.5, 0, 1, 1), (3, 0.0, 40, 0.0, 30, 0.0, 0.5, 1, 1, 1), (8, 0.1, 30, 0.0, 20, 0.0, 0.5, 1, 0, 1), (6, 0.0, 20, 0.0, 5, 0.0, 0.5, 1, 0, 1),
    (2, 1.0, 3, 1.0, 1, 1.0, 0.5, 0, 0, 0), (12, 0.9, 40, 0.0, 10, 1.0, 0.5, 0, 0, 0), (4, 0.7, 0, 0.0, 30, 0.0, 0.5, 0, 0, 0), (20, 0.8, 60, 0.0, 70, 0.0, 0.5, 0, 0, 0),
    # short first blocks, and headings after link lists
    (3, 0.0, 0, 0.0, 30, 0.0, 0, 1, 1, 1), (2, 0.0, 0, 0.0, 8, 0.0, 0, 1, 0, 1), (1, 0.0, 1, 0.0, 0, 0.0, 0, 1, 0, 1), (4, 0.0, 0, 0.0, 3, 1.0, 0, 1, 0, 1),
    (3, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1, 1), (2, 0.0, 1, 0.0, 25, 0.0, 0, 0, 1, 1), (1, 0.0, 0, 0.0, 70, 0.0, 0, 0, 1, 1), (3, 0.0, 2, 1.0, 50, 0.0, 0, 0, 1, 1),
    (3, 0.0, 2, 1.0, 12, 0.0, 0, 0, 1, 1), (2, 0.0, 1, 1.0, 5, 0.0, 0, 0, 1, 1), (4, 0.0, 3, 1.0, 30, 0.0, 0, 0, 1, 1), (5, 0.0, 2, 1.0, 15, 0.0, 0, 0, 0, 1),
    (5, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0, 1), (1, 0.0, 2, 1.0, 20, 0.0, 0, 0, 1, 1), (6, 0.1, 2, 1.0, 35, 0.0, 0, 0, 0, 1), (5, 0.0, 4, 1.0, 0, 0.0, 0, 0, 0, 1),
    (12, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0, 1), (30, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0, 1), (8, 0.0, 3, 0.0, 14, 1.0, 0, 0, 0, 1), (20, 0.1, 1, 1.0, 3, 1.0, 0, 0, 0, 1),
    (6, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 1), (38, 0.2, 0, 0.0, 1, 1.0, 0, 0, 0, 1), (10, 0.3, 2, 1.0, 1, 1.0, 0, 0, 0, 1), (7, 0.0, 1, 1.0, 5, 1.0, 0, 0, 0, 1),
    # within <article>: linked blocks, and short ones beside them
    (8, 1.0, 30, 0.0, 40, 0.0, 0, 1, 0, 1), (3, 1.0, 4, 1.0, 2, 1.0, 0, 1, 0, 1), (12, 0.8, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (25, 0.7, 9, 0.0, 80, 0.0, 0, 1, 0, 1),
    (1, 1.0, 70, 0.0, 3, 1.0, 0, 1, 0, 1), (40, 0.9, 20, 0.0, 35, 0.0, 0, 1, 0, 1), (18, 0.5, 45, 0.0, 90, 0.0, 0, 1, 0, 1), (6, 1.0, 2, 0.0, 0, 0.0, 0, 1, 0, 1),
    (90, 0.6, 5, 1.0, 6, 1.0, 0, 1, 0, 1), (2, 1.0, 15, 0.3, 25, 0.1, 0, 1, 0, 1), (15, 1.0, 14, 1.0, 16, 1.0, 0, 1, 0, 1), (30, 0.55, 1, 0.0, 10, 0.9, 0, 1, 0, 1),
    (2, 0.0, 2, 1.0, 30, 0.0, 0, 1, 0, 1), (1, 0.0, 3, 1.0, 4, 0.0, 0, 1, 0, 1), (4, 0.0, 6, 1.0, 2, 1.0, 0, 1, 0, 1), (3, 0.0, 14, 0.95, 0, 0.0, 0, 1, 0, 1),
    (3, 0.0, 0, 0.0, 2, 0.0, 0, 1, 1, 1), (2, 0.0, 0, 0.0, 3, 0.0, 0, 1, 1, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (5, 0.0, 0, 0.0, 4, 0.0, 0, 1, 0, 1),
    (1, 0.0, 0, 0.0, 1, 0.0, 0, 1, 0, 1), (4, 0.1, 0, 0.0, 2, 1.0, 0, 1, 0, 1), (5, 0.0, 0, 0.0, 1, 0.0, 0, 1, 1, 1), (2, 0.0, 0, 0.0, 4, 1.0, 0, 1, 0, 1),
    # furniture within <article>: lists of links, and prose
    (4, 1.0, 3, 1.0, 5, 1.0, 1, 1, 0, 0), (2, 1.0, 50, 0.0, 4, 1.0, 1, 1, 0, 0), (14, 0.9, 12, 0.9, 40, 0.0, 1, 1, 0, 0), (35, 0.6, 20, 0.0, 30, 0.0, 1, 1, 0, 0),
    (9, 0.5, 30, 0.0, 2, 1.0, 1, 1, 0, 0), (1, 1.0, 25, 0.0, 60, 0.0, 1, 1, 0, 0), (40, 0.0, 60, 0.0, 20, 0.0, 1, 1, 0, 0), (6, 0.0, 3, 1.0, 2, 1.0, 1, 1, 0, 0),
    (5, 0.8, 0, 0.0, 0, 0.0, 1, 1, 0, 0), (3, 1.0, 7, 0.0, 9, 0.0, 1, 1, 1, 0), (20, 1.0, 18, 1.0, 0, 0.0, 1, 1, 0, 0), (12, 0.7, 2, 0.0, 50, 0.0, 1, 1, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple | float:
    """CART: (feature, threshold, tree at or below, tree above), or the share of 1 in a leaf."""
    p = float(y.mean())
    if depth == 0 or p in (0.0, 1.0):
        return p
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            a, b = y[low], y[~low]
            gini = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(cut))
    if best is None:
        return p
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(maxsize=1)
def tree() -> tuple | float:
    rows = np.array(LABELLED, float)
    return grow(rows[:, :-1], rows[:, -1])


def keeps(row: tuple) -> bool:
    at = tree()
    while isinstance(at, tuple):
        at = at[2] if row[at[0]] <= at[1] else at[3]
    return at >= 0.5


def named(value: str) -> int:
    """Whether a class or id names furniture: 0 no, 1 it hints at it, 2 it does."""
    got = 0
    for name in value.split():
        if not NAMES.search(name):
            continue
        parts = [x for x in re.split(r"[_-]+", name) if x]
        for k, x in enumerate(parts):
            if x.lower() in SPEAKS:
                parts = parts[:k]
                break
        listed = [bool(NAMES.search(x)) for x in parts]
        if any(listed):
            got = max(got, 2 if all(ok or NEUTRAL.fullmatch(x) for ok, x in zip(listed, parts, strict=True)) else 1)
    return 1 if got == 2 and any(x.lower() in HOLDS for x in value.split()) else got


def blocks(page: str) -> list[tuple[str, int, int, float, bool, bool]]:
    """(text, words, linked words, in furniture, in article, heading) for each block with words."""
    out: list[tuple[str, int, int, float, bool, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, furniture (1 hinted at by a name, 2 named, 3 by tag or role), article
    parts: list[str] = []
    linked: list[str] = []
    in_link = False
    heading = False

    def flush() -> None:
        nonlocal heading
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                n = len(html.unescape("".join(linked)).split()) if linked else 0
                _, furniture, article = stack[-1] if stack else ("", 0, False)
                out.append((" ".join(words), len(words), min(n, len(words)), min(furniture, 2) / 2, article, heading))
            parts.clear()
            linked.clear()

    def text(s: str) -> None:
        if s:
            parts.append(s)
            if in_link:
                linked.append(s)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closes, attrs = m[1], m[3] or ""
        if name in RAW:
            if not closes and not attrs.rstrip().endswith("/"):
                end = RAW[name].search(page, at)
                at = end.end() if end else n
            continue
        if name == "a":
            in_link = not closes
            continue
        if name == "br":
            text(" ")
            continue
        block = name in BLOCKS
        if block:
            flush()
            if name in NESTS:
                in_link = False
        if closes:
            if block:
                heading = False
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k]
                        break
                    if stack[k][0] in BLOCKS:
                        break
            continue
        if name in VOID:
            continue
        if block and stack and stack[-1][0] == "p":
            stack.pop()
        if name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            stack.pop()
        furniture, article = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        opens = name in ("article", "main")
        article = article or opens
        if name in FURNITURE or (name == "header" and not article):
            furniture = 3
        if attrs and furniture < 3 and name not in ("html", "body"):
            own = 0
            for a in ATTR.finditer(attrs):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "role":
                    furniture = 3 if value.lower() in ROLES else furniture
                else:  # a header within an article is its own
                    own = max(own, named(HEADER.sub("", value) if article else value))
        else:
            own = 0
        if opens:  # not furniture by an outer name, unless its own says so (comments)
            furniture = furniture if furniture == 3 or own == 2 else 0
        else:
            furniture = max(furniture, own)
        if block or furniture != (stack[-1][1] if stack else 0):
            if not block:
                flush()
            stack.append((name, furniture, article))
        if name[0] == "h" and name[1:].isdigit():
            heading = True
    flush()
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    edge = ("", 0, 0, 0.0, False, False)
    shares = [(b[1], b[2] / b[1] if b[1] else 0.0) for b in (edge, *found, edge)]
    kept = []
    for k, b in enumerate(found):
        row = (*shares[k + 1], *shares[k], *shares[k + 2], b[3], b[4], b[5])
        if keeps(row):
            kept.append(b[0])
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo : lo + 512]
                texts = [main_text(x) for x in part["html"]]
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(html_col).alias("html"))
    return src.mapInPandas(run, "page_id long, url string, text string, n_chars long")
