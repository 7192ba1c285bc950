"""Main text of web pages by equivalence classes of template tokens.

A page's tokens are its block tags and its text blocks outside the article. A tag is told apart by its place: its path and its
number among equal siblings, so it occurs once in a page; a text by its path alone, so that it may move. A token's occurrence vector
says how often it occurs in each page of a host; vectors are compared as sums of page hashes, so one aggregation finds them however
many pages a host has. Tokens with equal vectors are a class. A class is valid with MIN_TAGS tags in MIN_PAGES pages, and is nested
if the tag around each of its tags is its own or that of another nested class; the nested classes are the host's template, optional
parts included. Text whose vector is that of a nested class stands on just these pages and belongs to the template; what is left are
slots. Slots under menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are dropped; of the rest
the article (or main) element with most text is the result, or, without one, all slots that aren't mostly links.

Outside an article one word of a class or id names boilerplate; within one all words of a name must, so that `side-effects` or
`related-work` stay. Null or empty html: empty text, n_chars 0. A url without a host shares the host ''. Repeated pages count each and
give a row each; text inside an article is never template text, and a page of template text only keeps it, so that copies keep
theirs. Unclosed tags end with what is around them. Equal vectors tie into one class; of articles of equal length the first is taken.
Other columns are kept; text and n_chars are replaced.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallywright.llm.shared import lean, stored, table

MIN_PAGES = 5
MIN_TAGS = 3
TOKENS = 500_000  # of all templates, up to which they are broadcast: 4 MB
LINKS = 0.5  # share of a block's characters in links from which it is no text, outside an article

# Element names of the HTML standard, and words that name boilerplate in class, id and role.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "object", "canvas", "audio", "video", "head", "fieldset", "datalist", "output"}
MARKS = set(
    "ad ads adv advert adverts advertisement advertising advertorial banner banners sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs"
    " header masthead topbar footer foot bottombar copyright sidebar sidebars side aside rail widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe"
    " subscription signup login comment comments commentlist reply replies respond disqus discussion related recommended share sharing social search pagination pager toolbar skip".split()
)
PLAIN = set(  # words that say nothing beside one of MARKS
    "box block list lists container wrapper wrap area section item items inner outer link links post posts article articles bar panel content unit slot top bottom left right user users reader readers text body"
    " form title site page global mobile desktop sticky fixed card button buttons icons thread js x".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</[^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _boilerplate(name: str, attributes: dict[str, str], inside: bool) -> bool:
    if name in DROPPED and not (inside and name == "header"):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    if name in ("body", "html", "article", "main"):
        return False
    for label in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in _WORDS.findall(label)}
        if inside and words & (MARKS - {"header"}) and words <= MARKS | PLAIN or not inside and words & MARKS:
            return True
    return False


def blocks(html: str):
    """(tags, blocks): opening tags as hashes (place, place around it or 0), and (text, path hash, article number or 0, dropped, link characters)."""
    stack: list[tuple] = []  # name, path, article, dropped, place, children by path
    tags, found, words = [], [], []
    state = {"articles": 0, "links": 0}
    top = ("", 0, 0, False, 0, {})

    def flush():
        text = _SPACE.sub(" ", entities.unescape("".join(words))).strip()
        if text:
            at = next((s for s in reversed(stack) if s[0] not in INLINE), top)
            found.append((text, at[1], at[2], any_dropped, state["links"]))
        words.clear()
        state["links"] = 0

    any_dropped = False
    at = 0
    size = len(html)
    while at <= size:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else size]
        if text:
            here = stack[-1] if stack else top
            if here[3] != any_dropped and words:
                flush()
            any_dropped = here[3]
            words.append(text)
            if any(s[0] == "a" for s in stack[-4:]):
                state["links"] += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            words.append(" ")
            continue
        block = name not in INLINE and name not in VOID
        if block:
            flush()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None and (block or all(s[0] in INLINE for s in stack[depth:])):
                del stack[depth:]
            continue
        if block:
            if name in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[name]:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "article", "main", "div", "section"):
                        break
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        attributes = _attributes(m[3])
        above = stack[-1] if stack else top
        path = xxhash.xxh64_intdigest(f"{name}.{attributes.get('class', '')}#{attributes.get('id', '')}", seed=above[1]) & 0x7FFFFFFFFFFFFFFF
        place, children = above[4], above[5]
        if block:
            children[path] = children.get(path, 0) + 1
            place = xxhash.xxh64_intdigest(children[path].to_bytes(4), seed=path ^ above[4]) & 0x7FFFFFFFFFFFFFFF
            tags.append((place, above[4]))
            children = {}
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else size + 1
            continue
        if name in VOID or m[3].rstrip().endswith("/") and name in ("path", "circle", "rect", "use"):
            continue
        article = above[2]
        if name in ("article", "main") and not (article and name == "main"):
            if not article or name == "article" and stack and any(s[0] == "main" for s in stack) and not any(s[0] == "article" for s in stack):
                state["articles"] += 1
                article = state["articles"]
            dropped = _boilerplate(name, attributes, True) or bool(above[2]) and above[3]
        else:
            dropped = above[3] or _boilerplate(name, attributes, bool(article))
        stack.append((name, path, article, dropped, place, children))
    flush()
    return tags, found


def _text_token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=path) & 0x7FFFFFFFFFFFFFFF


def main_text(html: str | None, template: set[int] = frozenset()) -> str:
    """The main text of a page; template: text tokens of its host that are no slots."""
    _, found = blocks(html or "")
    named = [b for b in found if not b[3]]
    kept = [b for b in named if b[2] or _text_token(b[1], b[0]) not in template] or named
    weight: dict[int, int] = {}
    for text, _, article, _, _ in kept:
        if article:
            weight[article] = weight.get(article, 0) + len(text)
    if weight:
        best = max(weight, key=lambda k: (weight[k], -k))
        return "\n".join(b[0] for b in kept if b[2] == best)
    return "\n".join(b[0] for b in kept if b[4] <= LINKS * len(b[0]))


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


_VECTORS = "host string, token long, is_text boolean, parent long, vector long, n long"


def _vectors(batches):
    for batch in batches:
        rows: dict[tuple, list[int]] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass")) >> 8
            tags, found = blocks(html)
            own: dict[tuple, int] = {}
            for place, around in tags:
                own[host, place, False, around] = 1
            for text, path, article, dropped, _ in found:
                if not article and not dropped:
                    key = host, _text_token(path, text), True, 0
                    own[key] = own.get(key, 0) + 1
            for key, n in own.items():
                held = rows.setdefault(key, [0, 0])
                held[0] = (held[0] + page * n) & 0xFFFFFFFFFFFFFFFF
                held[1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int64()), pa.array([k[2] for k in rows], pa.bool_()), pa.array([k[3] for k in rows], pa.int64()), pa.array([(v[0] ^ (1 << 63)) - (1 << 63) for v in rows.values()], pa.int64()), pa.array([v[1] for v in rows.values()], pa.int64())],
            names=["host", "token", "is_text", "parent", "vector", "n"],
        )


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the text tokens of each host's template. Vectors add up in 64 bits and wrap."""
    seen = pages.where("html is not null and html <> ''").select(_host().alias("host"), "html")
    tokens = seen.mapInArrow(lean(_vectors), _VECTORS)
    parts = tokens.groupBy("host", "token", "is_text").agg(F.sum(F.col("vector").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"), F.min("parent").alias("parent"))
    classes = stored(parts.where(f"n >= {MIN_PAGES}").withColumn("vector", F.pmod("v", F.lit("18446744073709551616").cast("decimal(38,0)"))).select("host", "token", "is_text", "vector", "parent"), "tokens")
    tags = classes.where("not is_text")
    nested = stored(tags.groupBy("host", "vector").agg(F.count("*").alias("tags")).where(f"tags >= {MIN_TAGS}").select("host", "vector"), "classes")
    while True:  # a round takes away the classes inside slots, then those within these; most hosts have none
        members = tags.join(nested, ["host", "vector"], "left_semi")
        within = members.select("host", F.col("token").alias("parent"))
        loose = stored(members.where("parent <> 0").join(within, ["host", "parent"], "left_anti").select("host", "vector").distinct(), "loose")
        if loose.isEmpty():
            break
        nested = stored(nested.join(loose, ["host", "vector"], "left_anti"), "classes")
    return classes.where("is_text").join(nested, ["host", "vector"], "left_semi").groupBy("host").agg(F.collect_set("token").alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """pages (url, html, ...) with text and n_chars (code points)."""
    pages = pages.drop("text", "n_chars", "__host", "__template")
    found = stored(templates(pages), "templates").select(F.col("host").alias("__host"), F.col("template").alias("__template"))
    size = found.agg(F.sum(F.size("__template") + F.length("__host"))).first()[0] or 0
    found = F.broadcast(found) if size <= TOKENS else found
    fields = [f for f in pages.schema.fields if f.name != "html"]
    rows = pages.join(found, _host() == F.col("__host"), "left").select(*(f.name for f in fields), "html", "__template")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                piece = batch.slice(a, 500)
                texts = [main_text(h, frozenset(t or ())) for h, t in zip(piece.column(len(fields)).to_pylist(), piece.column(len(fields) + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(fields)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in fields), "text", "n_chars"])

    return rows.mapInArrow(lean(run), StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())]))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
