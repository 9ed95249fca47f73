"""HTML extraction by the maximum-scoring subsequence.

A page becomes a row of words and tags.  Elements that never hold an article
(scripts, menus, forms, adverts, reader comments and so on, by name or by the words
of their class, id or role) are taken out first.  Words then score above zero and
tags below, with weights learned from labelled pages: the log of how much oftener a
token stands inside the content than outside.  Labelled are those pages of the table
that mark one article or main element (a bounded sample of them) and pages laid out by
rule; both count alike.  A linear scan finds the contiguous region with the highest sum;
its text, cut at block tags, is the main text.  Within an article marked as such tags
hardly count, so that none ends it.

Defined cases: a null or empty page, and one without words, has an empty text; tags
that never close end with the page (an unwanted one at the next block); repeated
pages give repeated rows; an empty table gives no rows; of regions with equal sums the
first and shortest is taken; any page is read whole by one task, in one pass; extra
columns are never read, whatever their names.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quote opens a value only behind "=", and closes it only before what can follow a value; any other is a character.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+"[^"]*+"(?=[\s/>])|=\s*+'[^']*+'(?=[\s/>])|=|["'])*+)>|[^<]+|<""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
#: Elements whose content is no markup.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "title", "xmp"}
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.IGNORECASE | re.ASCII) for name in RAW}
#: Elements that hold no article, by name.
UNWANTED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "audio", "video", "canvas", "map"}
#: Words of a class, id or role that mark other elements as such.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation topnav
    breadcrumb breadcrumbs cookie cookies consent notice notices notification alert popup modal overlay comment comments discussion disqus
    replies respond share sharing social related recommended newsletter subscribe subscription signup login search footer header masthead
    toolbar pagination pager widget widgets contentinfo complementary copyright legal disclaimer tags""".split()
)
#: Words that say nothing beside a mark; within an article a class is unwanted only if it has marks and these alone.
PLAIN = frozenset(
    """area bar block body bottom box btn button buttons card col container content cta form frame group head holder icon icons inner item items label left
    link links list media module outer panel post posts right row section slot stories text title top unit wrap wrapper""".split()
)
NEVER_UNWANTED = {"html", "body", "main", "article"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    *"address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
}


def marked(value: str, strict: bool) -> bool:
    """Whether a class, id or role marks what holds no article: by any of its words, or, ``strict``, by all words of one name but plain ones."""
    for name in re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().split() if not strict else re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        words = re.findall(r"[a-z]+", name)
        if not MARKS.isdisjoint(words) and (not strict or all(w in MARKS or w in PLAIN for w in words)):
            return True
    return False


def unwanted(name: str, attributes: str, in_article: bool, later: bool, strict: bool = False) -> bool:
    """Whether an element holds no article; ``later``: whether an article came before (comments are marked up as such, too)."""
    if name in NEVER_UNWANTED and not (name == "article" and later):
        return False
    if name in UNWANTED and not (name == "header" and in_article):
        return True
    if not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" and m.start() and attributes[m.start() - 1].isspace() or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id", "role") and marked(value, in_article or strict):
            return not (name in ("header", "h1", "h2", "h3", "p", "span", "b", "i", "a") and in_article and key == "class" and value.lower() in ("header", "side", "tags"))
    return False


def pieces_of(page: str) -> list[tuple[str, str, str]]:
    """(name, "/" if closing, attributes or text) of all tags and texts but those that are no markup's."""
    flat: list[tuple[str, str, str]] = []
    at, endless, last = 0, set(), page.rfind(">")  # endless: names whose end doesn't come any more
    while at < len(page) and (m := TOKEN.match(page, at)):
        if at > last:  # no tag ends any more: what is left is text, up to an open comment
            flat.append(("", "", page[at:].partition("<!--")[0].partition("<![CDATA[")[0]))
            break
        at = m.end()
        if m[1]:
            name, closing = m[1].lower(), m[0][1] == "/"
            if name in RAW and not closing and not m[0].endswith("/>"):
                end = None if name in endless else RAW_END[name].search(page, at)
                if end is None:
                    endless.add(name)
                at = end.end() if end else len(page) if name in ("script", "style") else at
                continue
            if not (name in RAW and closing):
                flat.append((name, "/" if closing else "", m[2] or ""))
        elif m[0][0] != "<" or m[0] == "<":
            flat.append(("", "", m[0]))
    return flat


def tokens(page: str) -> list[tuple[str, str]]:
    """("", text) and (tag name, "" or "/") in order, without unwanted elements; "/" stands before a closing tag's name."""
    flat = pieces_of(page)
    out: list[tuple[str, str]] = []
    closes = Counter(name for name, closing, _ in flat if closing)
    letters = sum(len(x[2]) for x in flat if not x[0])
    i, articles, seen = 0, 0, False
    while i < len(flat):
        name, closing, more = flat[i]
        i += 1
        if not name:
            out.append(("", more))
            continue
        closes[name] -= bool(closing)
        if not closing and name not in VOID and unwanted(name, more, articles > 0, seen):
            depth, k = 1, i
            if closes[name] > 0:
                while k < len(flat) and depth:
                    depth += (flat[k][0] == name) * (-1 if flat[k][1] else 1)
                    if name == "head" and flat[k][0] == "body" and not flat[k][1]:
                        break
                    k += 1
            inner = flat[i:k]
            if k > i and not unwanted(name, more, articles > 0, seen, True) and 3 * sum(len(x[2]) for x in inner if not x[0]) > letters:
                out.append((name, ""))  # much of the page under a name that only sounds so
                continue
            if k > i and (not seen and any(x[0] in ("article", "main") and not x[1] for x in inner) or name == "form" and 2 * sum(len(x[2]) for x in inner if not x[0]) > letters):
                out.append((name, ""))  # a frame around the page's content, whatever its name
                continue
            if closes[name] <= 0 or depth and name != "head":  # never closed: up to the next block
                k = i
                while k < len(flat) and flat[k][0] not in BLOCK:
                    k += 1
            for x in flat[i:k]:
                closes[x[0]] -= bool(x[1])
            i = k
            out.append(("p", ""))  # a cut between blocks
            continue
        articles += (name == "article") * (-1 if closing else 1)
        seen |= name in ("article", "main")
        out.append((name, closing))
    return out


def token_counts(pages) -> tuple[Counter, Counter]:
    """Counts of token kinds ("" is a word) inside and outside the content of pages given as (before, content, after), three pieces of one page's html."""
    inside, outside = Counter(), Counter()
    for before, content, after in pages:
        for counts, piece in ((inside, content), (outside, before), (outside, after)):
            for name, closing, text in pieces_of(piece):
                counts[name and f"{closing}{name}"] += 1 if name else len(text.split())
    return inside, outside


def weigh(*sets: tuple[Counter, Counter]) -> dict[str, float]:
    """Weights by token kind ("" is a word): the mean over sets of counts, of those that know the kind."""
    found: dict[str, list[float]] = {}
    for inside, outside in sets:
        kinds, n_in, n_out = {*inside, *outside}, sum(inside.values()), sum(outside.values())
        for k in kinds:
            found.setdefault(k, []).append(math.log((inside[k] + 0.5) / (n_in + 0.5 * len(kinds))) - math.log((outside[k] + 0.5) / (n_out + 0.5 * len(kinds))))
    odds = {k: sum(x) / len(x) for k, x in found.items()}
    word = max(odds.pop("", 0.0), 0.25)
    return {"": word} | {k: min(v, -word / 8) for k, v in odds.items()}


#: Bounds of the sample of labelled pages, and of a page's characters in it.
LABELLED, LABELLED_CHARS = 500, 200_000
CONTENT = re.compile(r"<(article|main)\b[^>]*+>", re.IGNORECASE)


def split_page(page: str) -> tuple[str, str, str] | None:
    """(before, content, after) of a page that marks one article, or, without any, one main element."""
    marks = [m for m in CONTENT.finditer(page)]
    for name in ("article", "main"):
        own = [m for m in marks if m[1].lower() == name]
        if own:
            end = page.lower().rfind(f"</{name}") if len(page.lower()) == len(page) else -1
            return (page[: own[0].end()], page[own[0].end() : end], page[end:]) if len(own) == 1 and end > own[0].end() else None
    return None


def learned(pages: DataFrame) -> dict[str, float]:
    """Weights from the labelled pages of a table, by hash of their id, and from those laid out by rule."""
    html = F.col("html")
    able = pages.where((F.length(html) <= LABELLED_CHARS) & html.rlike(r"(?i)<(article|main)\b")).select(F.xxhash64("page_id", html).alias("h"), html.alias("html"))
    least = [r[0] for r in able.select("h").distinct().orderBy("h").limit(LABELLED).collect()]  # hashes alone meet, not pages
    chosen = able.where(F.col("h").isin(least)).dropDuplicates(["h"])

    def count(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for v in batch.column(0):
                if (parts := split_page(v.as_py())) is not None:
                    a, b = token_counts([parts])
                    inside.update(a)
                    outside.update(b)
        if inside or outside:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps([inside, outside])])], names=["counts"])

    found = [[Counter(x) for x in json.loads(r[0])] for r in chosen.select("html").mapInArrow(count, "counts string").collect()]  # a row for each task that has labelled pages
    inside, outside = (sum((f[k] for f in found), Counter()) for k in range(2))
    rule = token_counts(labelled_pages())
    return weigh(rule, (inside, outside)) if inside and outside else weigh(rule)


def labelled_pages() -> list[tuple[str, str, str]]:
    """Pages with known content, laid out by rule: semantic and plain containers, lists, quotes, tables and headings, and what stands around."""
    out, prose = [], "plain words of a sentence that goes on for some while and then ends"
    for k in range(24):
        box = ("article", "main", 'div id="content"', 'div class="text"', "section", "td")[k % 6]
        name = box.split()[0]
        paragraphs = "".join(f"<p>{prose} {prose}</p>" for _ in range(3 + k % 4))
        extras = (
            f"<ul><li>{prose}</li><li>{prose}</li></ul>", f"<blockquote><p>{prose}</p></blockquote>", f"<h2>{prose[:20]}</h2><p>{prose}</p>",
            f"<ol><li>{prose}</li></ol>", f"<table><tr><td>{prose}</td><td>{prose}</td></tr></table>", f"<p>{prose} <a>words</a> <b>more</b> <i>words</i><br>{prose}</p>",
        )
        content = f"<h1>{prose[:30]}</h1>{paragraphs}{extras[k % 6]}{extras[(k + 1) % 6]}<p>{prose}</p>"
        links = "".join(f"<a>{w}</a> " for w in prose.split())
        lists = "".join(f"<div><span><a>{w}</a></span></div>" for w in prose.split()[:6])
        before = (f"<html><body><div><div>{links}</div></div>", f"<html><body><table><tr><td>{links}</td></tr>", f"<html><body><div>{lists}</div>")[k % 3]
        after = (f"<div><div>{links}</div><div>All rights</div></div></body></html>", f"<div>{lists}</div><small>made by us</small></body></html>", f"<hr><center>{links}</center></body></html>")[(k // 2) % 3]
        out.append((f"{before}<{box}>", content, f"</{name}>{after}"))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the highest sum, the earliest and, of equal ones, the shortest."""
    best, start, end, total, first = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += x
        if total > best + 1e-9:
            best, start, end = total, first, i + 1
    return start, end


def extract(page: str, weights: dict[str, float]) -> str:
    """Main text of a page."""
    row = tokens(page)
    word = weights[""]
    unknown = min(weights.values())
    scores, depth = [], 0
    for name, text in row:
        if not name:
            scores.append(word * len(text.split()))
        elif name in ("article", "main"):
            depth = max(depth + (name == "article") * (-1 if text else 1), 0)
            scores.append(unknown)
        else:  # within an article marked as such no tag ends it
            scores.append(-word / 1000 if depth else weights.get(f"{text}{name}", -word))
    start, end = best_region(scores)
    blocks, own = [], []
    for name, text in [*row[start:end], ("p", "")]:
        if not name:
            own.append(text)
        elif name in BLOCK:
            if block := " ".join(html.unescape("".join(own)).split()):
                blocks.append(block)
            own = []
        elif name == "br":
            own.append(" ")
    return "\n\n".join(blocks)


def main_texts(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    weights = weights or learned(pages)
    kind, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))

    def run(batches):
        for batch in batches:
            texts = [extract(v.as_py() or "", weights) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url {url}, text string, n_chars long")
