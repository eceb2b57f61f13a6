"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides each block by
its length, its share of stop words and its share of linked characters, and
by the section it stands in (menus, footers, side bars, forms, adverts,
notices, reader comments are named by tag, class, id or role). Short blocks
and headings stay ambiguous. Pass two gives each of them the label of the
nearest decided block before and after it (inside an article, of its own
section); a heading follows the block after it. Where a page marks its article or main
part and text is found there, blocks outside it are left out.

Names count by whole words of a class, id or role, and not where the word only
describes the page (``comments-open``, ``content-sidebar-wrap``). They don't
drop an article or main part; where one stands in a named holder and holds
more than the rest, or where names leave no text at all, names give way.

Character references are decoded, white space inside a block is one space,
blocks are trimmed and joined by two newlines in page order. Markup that is
cut off or never closed is read as far as it goes.

Edge cases: null or empty html, or a page without main text, gives empty
text; repeated rows are extracted each; pages of any size are read whole;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Frequent function words of the languages in view; fixed values.
STOP_WORDS = frozenset("""
a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its
more most no not of on one or other our she so such than that the their them there these they this to was we were
which who will with would you your
aber als am an auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit
nach nicht noch nur oder sich sie sind um und von vor war wie wir zu zum zur über
au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui
sa se ses son sont sur un une vous été
al como con del el ella en entre era es esta este fue ha la las lo los más mi muy no o para pero por que se sin sobre
su sus también un una y ya yo
""".split())

RAW = "noscript|template|textarea|iframe|svg|math|object|select|button|title|canvas|audio|video"
DROPPED = frozenset("nav footer aside form menu dialog head".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td
tfoot th thead tr ul""".split())
HOLDERS = frozenset("""article aside blockquote body details dialog div dl fieldset figure footer form head header html
li main menu nav ol section table td th tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = frozenset("""ad ads adbox adsbygoogle advert adverts advertisement advertisements advertising alert alerts banner
banners breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright crumb crumbs disclaimer footer
hidden legal login masthead menu modal nav navbar navigation newsletter newsletters notice notices overlay pager pagination
popup promo promos recommend recommendation recommendations recommended related replies reply respond share sharing side
sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tags teaser teasers toc toolbar widget
widgets""".split())
#: Beside these words a name describes the page or the post, not a section.
_ABOUT = frozenset("""by category closed disabled enabled format has have layout no not off on open opened status tag topic
type with without""".split())
#: Between others, a name beside these is one part of a holder of several.
_PARTS = frozenset("article body content entry main post story text".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s/>=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*>|\Z)|\Z)"
    # others end at their end tag; without one before the next of their kind, at the next block tag
    r"|<(" + RAW + r")\b[^>]*+(?:(?<=/)>|>(?:[^<]*+(?:<(?!/?\2\b)[^<]*+)*+</\2\s*>"
    r"|[^<]*+(?:<(?!/?(?:" + "|".join(sorted(BLOCKS)) + r")\b)[^<]*+)*+)|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_SPACE = re.compile(r"\s+")

GOOD, BAD, OPEN = 1, 0, None
#: What drops a section: the name of a holder of its article, a name, its tag or being hidden.
HOLDER_NAMED, NAMED, AWAY = 1, 2, 3


class Block:
    __slots__ = ("parts", "linked", "section", "dropped", "inside", "heading", "label", "text")

    def __init__(self, section, dropped, inside, heading):
        self.parts, self.linked = [], 0
        self.section, self.dropped, self.inside, self.heading = section, dropped, inside, heading
        self.label, self.text = OPEN, ""


def _is_name(token: str) -> bool:
    """Does one class, id or role name a section that isn't main text?"""
    words = [w.lower() for w in _WORD.findall(token)]
    if NAMES.isdisjoint(words) or not _ABOUT.isdisjoint(words):
        return False
    return words[0] in NAMES or words[-1] in NAMES or _PARTS.isdisjoint(words)


def _dropped_by(tag: str, attrs: str, inside: bool) -> int:
    """Does a section's tag, class, id or role say that it isn't main text?"""
    if tag in DROPPED or (tag == "header" and not inside):
        return AWAY
    if not attrs or tag in ("html", "body", "main"):
        return 0
    if _HIDDEN.search(attrs):
        return AWAY
    if tag == "article" and not inside:
        return 0
    return NAMED if any(_is_name(t) for _, a, b, c in _ATTR.findall(attrs) for t in (a or b or c).split()) else 0


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, undecided. ``section`` numbers the holder
    that a block stands in; ``inside``: in an article or main part."""
    out: list[Block] = []
    held: list[tuple] = []          # open holders: (tag, section, dropped, inside)
    state = {"section": 0, "links": 0, "breaks": 0}
    sections, now = 0, None

    def close():
        nonlocal now
        if now is not None:
            now.text = _SPACE.sub(" ", html.unescape("".join(now.parts))).strip()
            if now.text:
                out.append(now)
            now = None

    def add(text):
        nonlocal now
        if now is None:
            if not text.strip():
                return
            _, section, dropped, inside = held[-1] if held else ("", 0, 0, False)
            now = Block(section, dropped, inside, state.get("heading", False))
        now.parts.append(text)
        if state["links"] > 0:
            now.linked += len(_SPACE.sub(" ", text))
        if text.strip():
            state["breaks"] = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m[4] or m[7]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[3] or m[6])
        attrs = m[5] or m[8] or ""
        if tag == "a":
            state["links"] = 0 if closing else 1
        elif tag == "br":
            state["breaks"] += 1
            if state["breaks"] > 1:
                close()
            else:
                add(" ")
        elif tag in BLOCKS:
            close()
            state["links"], state["breaks"] = 0, 0
            state["heading"] = tag in HEADINGS and not closing
            if tag in HOLDERS:
                if closing:
                    for i in range(len(held) - 1, -1, -1):
                        if held[i][0] == tag:
                            del held[i:]
                            break
                elif not attrs.endswith("/"):
                    _, _, dropped, inside = held[-1] if held else ("", 0, 0, False)
                    sections += 1
                    if dropped == NAMED and not inside and tag in ("article", "main"):
                        dropped = HOLDER_NAMED
                    held.append((tag, sections, max(dropped, _dropped_by(tag, attrs, inside)),
                                 inside or tag in ("article", "main")))
    if at < len(page):
        add(page[at:])
    close()
    return out


def _decide(b: Block, allowed: int) -> int | None:
    """Pass one: by section, links, length and stop words."""
    n = len(b.text)
    if b.dropped > allowed or b.linked >= 0.5 * n:
        return BAD
    if b.heading:
        return OPEN
    if b.inside:
        return GOOD if n >= 40 and b.linked < 0.3 * n else OPEN
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if n < 70:
        return OPEN
    if b.linked > 0.2 * n:
        return BAD
    if n >= 200:
        return GOOD if stops >= 0.15 else BAD
    return GOOD if stops >= 0.3 else (OPEN if stops >= 0.15 else BAD)


def extract_text(page: str) -> tuple[str, int, int]:
    """(main text, blocks, blocks kept) of one page."""
    blocks = blocks_of(page)

    def decide(allowed):
        """Labels by pass one; (characters found in marked parts, anywhere)."""
        for b in blocks:
            b.label = _decide(b, allowed)
        good = [b for b in blocks if b.label == GOOD]
        return sum(len(b.text) for b in good if b.inside), sum(len(b.text) for b in good)

    marked, found = decide(0)
    if not marked and any(b.dropped == HOLDER_NAMED for b in blocks) and decide(HOLDER_NAMED)[0] <= found:
        decide(0)
    if not found and not any(b.label == GOOD for b in blocks) and any(b.dropped == NAMED for b in blocks):
        decide(NAMED)
    # pass two: the nearest decided blocks on both sides, own section first
    decided = [i for i, b in enumerate(blocks) if b.label is not OPEN]
    marked = any(b.inside and b.label == GOOD for b in blocks)
    of_section: dict[int, list[int]] = {}
    for i in decided:
        of_section.setdefault(blocks[i].section, []).append(i)
    labels = [b.label for b in blocks]

    def near(i, among):
        k = bisect(among, i)
        return (among[k - 1] if k else None), (among[k] if k < len(among) else None)

    for i, b in enumerate(blocks):
        if b.label is not OPEN:
            continue
        before, after = near(i, of_section.get(b.section, []) if b.inside else decided)
        if b.inside and before is None and after is None:
            labels[i] = GOOD
            continue
        if b.heading and after is not None:
            before = after
        found = [blocks[j].label for j in (before, after) if j is not None]
        if len(set(found)) == 2:
            gap = (i - before) - (after - i)
            labels[i] = GOOD if b.inside else blocks[before if gap < 0 else after].label if gap else BAD
        else:
            labels[i] = found[0] if found else BAD
    kept = [b.text for b, label in zip(blocks, labels) if label == GOOD and (b.inside or not marked)]
    return "\n\n".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(*keep, text, n_chars, n_blocks, n_kept), a row per row of ``pages``."""
    C.ship_package(pages.sparkSession)
    src = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    names = [*keep, "text", "n_chars", "n_blocks", "n_kept"]

    def run(batches):
        for b in batches:
            at = 0
            for part in C.by_bytes(b.column("_html").to_pylist(), len, 8 << 20):
                rows = [extract_text(p) for p in part]
                yield pa.RecordBatch.from_arrays(
                    [b.column(n).slice(at, len(part)) for n in keep]
                    + [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()),
                       pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                    names=names)
                at += len(part)

    schema = src.select(*keep).schema.add("text", "string")
    for n in names[-3:]:
        schema = schema.add(n, "long")
    return src.mapInArrow(run, schema)


def op2_block_rules(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(C.table(spark, sf_dir, "pages"))
