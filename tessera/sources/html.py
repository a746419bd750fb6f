"""Listing and detail pages as rows: one Arrow pass reads the marked-up fields, Columns clean them.

The parser only collects texts and links by tag and class; ids, numbers, URLs and outcomes are Column expressions. Elements nested
deeper than ``DEEPEST`` become siblings; no text is lost.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_multiline, clean_text
from ..functions.values import absolute_url, entity_id_of, item_id_of, parse_compact_number, safe_url

#: Names of icons that precede an entity's name, and titles of placeholder pages.
ICONS = ("face", "local_library", "accessibility_new", "local_offer")
PLACEHOLDER_TITLES = ("|俺の3Dエロ動画",)  # after NFKC
GONE_DATE, GONE_TIME = "-0001-11-30", "00:00"
DEEPEST = 400
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A tag as most pages write it; pages with other markup, or elements with rules of their own for what they hold, are read by ``HTMLParser``.
_PLAIN = re.compile(r'<(/?)([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&<>]*")*)>')
_ATTRIBUTE = re.compile(r' ([a-z-]+)="([^"]*)"')
_OWN_RULES = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp svg math".split())


class _Element:
    __slots__ = ("tag", "attrs", "classes", "children")

    def __init__(self, tag: str, attrs: dict, classes: Sequence[str] = ()):
        self.tag = tag
        self.attrs = attrs
        self.classes = classes
        self.children = []

    def find(self, tag: str = "", cls: str = "") -> list[_Element]:
        out, todo = [], self.children[::-1]
        while todo:
            x = todo.pop()
            if x.__class__ is _Element:
                if (not tag or x.tag == tag) and (not cls or cls in x.classes):
                    out.append(x)
                if x.children:
                    todo += x.children[::-1]
        return out

    def first(self, tag: str = "", cls: str = "") -> _Element | None:
        return next(iter(self.find(tag, cls)), None)

    def text(self) -> str:
        if len(self.children) == 1 and self.children[0].__class__ is str:
            return self.children[0]
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.__class__ is str:
                out.append(x)
            else:
                todo += x.children[::-1]
        return "".join(out)


class _Root(_Element):
    """A page; ``by_tag`` are all its elements in document order."""

    __slots__ = ("by_tag",)

    def __init__(self) -> None:
        super().__init__("", {})
        self.by_tag: dict[str, list[_Element]] = {}

    def find(self, tag: str = "", cls: str = "") -> list[_Element]:
        return [e for e in self.by_tag.get(tag, ()) if not cls or cls in e.classes]


class _Builder(HTMLParser):
    """Elements do not know their parents, so that a tree that was read is freed without a search for cycles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Root()
        self.open = [self.root]

    def _add(self, tag: str, attrs: list) -> _Element:
        found = {k: v or "" for k, v in attrs}
        e = _Element(tag, found, found.get("class", "").split())
        self.open[-1].children.append(e)
        self.root.by_tag.setdefault(tag, []).append(e)
        return e

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = self._add(tag, attrs)
        if tag not in _VOID and len(self.open) <= DEEPEST:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        _close(self.open, tag)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _close(opened: list[_Element], tag: str) -> None:
    """Closes the innermost open element of a tag, and those within it; the root stays open."""
    for k in range(len(opened) - 1, 0, -1):
        if opened[k].tag == tag:
            del opened[k:]
            return


def _attributes(text: str) -> tuple[dict[str, str], list[str]]:
    found = dict(_ATTRIBUTE.findall(text))
    return found, found.get("class", "").split()


_short_attributes = lru_cache(4096)(_attributes)  # pages repeat them; elements only read what they share


def _plain_tree(html: str) -> _Root | None:
    """The tree of a page of plain tags, as ``_Builder`` makes it; null if there is other markup."""
    parts = _PLAIN.split(html)
    if any("<" in text for text in parts[::4]) or not _OWN_RULES.isdisjoint(parts[2::4]):
        return None
    root = _Root()
    by_tag, opened = root.by_tag, [root]
    if parts[0]:
        root.children.append(unescape(parts[0]))
    for slash, tag, attrs, text in zip(parts[1::4], parts[2::4], parts[3::4], parts[4::4]):
        if not slash:
            e = _Element(tag, *(_short_attributes if len(attrs) < 100 else _attributes)(attrs))
            opened[-1].children.append(e)
            if tag in by_tag:
                by_tag[tag].append(e)
            else:
                by_tag[tag] = [e]
            if tag not in _VOID and len(opened) <= DEEPEST:
                opened.append(e)
        elif attrs:
            return None
        elif opened[-1].tag == tag:
            del opened[max(len(opened) - 1, 1) :]
        else:
            _close(opened, tag)
        if text:
            opened[-1].children.append(unescape(text) if "&" in text else text)
    return root


def _tree(html: str | None) -> _Root:
    plain = _plain_tree(html or "")
    if plain is not None:
        return plain
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _txt(e: _Element | None) -> str | None:
    return None if e is None else e.text()


def _nfkc(text: str | None) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize("NFKC", text)


def _name_candidates(e: _Element) -> list[str]:
    """Texts that may be an entity's name: those of the marked children, the most specific mark first, then the link's own."""
    for tag, cls in (("", "tag-text"), ("", "aside-list-name"), ("", "box-text-in"), ("div", "video-center"), ("span", "video-center")):
        texts = [t for x in e.find(tag, cls) if (t := " ".join(x.text().split())) and t not in ICONS]
        if texts:
            return texts
    return [e.text()]


_LISTING = "struct<grid:boolean,cells:array<struct<href:string,title:string,creator:string,thumbnail:string,stats:array<string>>>,pages:array<string>>"
_DETAIL = (
    "struct<title:string,clean_title:string,page_title:string,image:string,counters:array<struct<icon:string,value:string>>,dates:array<string>,"
    "links:array<struct<href:string,name:string>>,videos:array<string>,comment:string>"
)


def _listing(root: _Root) -> dict:
    grid = next((e for e in root.find("div", "g-main-grid")), None)
    cells = []
    for article in grid.find("article") if grid else []:
        inside = article.find()
        first = lambda tag, cls: next((e for e in inside if (not tag or e.tag == tag) and cls in e.classes), None)  # noqa: B023, E731
        link = first("a", "box")
        if link is None:
            continue
        title, image, box = first("h2", "box-h2"), first("img", "main-thumbnail"), first("", "box-text1")
        creator = box.first(cls="box-text-in") if box else None
        cells.append({"href": link.attrs.get("href"), "title": _nfkc(_txt(title)), "creator": _nfkc(_txt(creator)), "thumbnail": image.attrs.get("src") if image else None, "stats": [_nfkc(e.text()) for e in inside if "figure-text-in" in e.classes]})
    pages = [a.attrs.get("href", "") for ul in root.find("ul", "pagination") for a in ul.find("a", "page-link")]
    return {"grid": grid is not None, "cells": cells, "pages": pages}


def _detail(root: _Root) -> dict:
    views = root.find("ul", "video-views")
    counters = []
    for li in (li for ul in views for li in ul.find("li", "f-label-in")):
        icon, value = li.first("i", "material-icons"), li.first(cls="video-text")
        if icon is not None and value is not None:
            counters.append({"icon": icon.text().strip(), "value": value.text()})
    links = [{"href": a.attrs.get("href"), "name": _nfkc(_name_candidates(a)[-1])} for s in root.find("section", "video-section-tag") for a in s.find("a")]
    title = _txt(root.first("h1", "video-h1"))
    image = next((m.attrs.get("content") for m in root.find("meta") if m.attrs.get("property") == "og:image"), None)
    return {
        "title": title, "clean_title": _nfkc(title), "page_title": _nfkc(_txt(root.first("title"))), "image": image, "counters": counters,
        "dates": [e.text() for ul in views for e in ul.find(cls="video-text")], "links": links,
        "videos": [a.attrs.get("href") for a in root.find("a", "video-watch-btn2")], "comment": _txt(root.first("blockquote", "video-information-comment")),
    }


_KINDS = {"listing": (_LISTING, _listing), "detail": (_DETAIL, _detail)}


def _read(pages: DataFrame, *kinds: str) -> DataFrame:
    """Adds ``listing`` or ``detail`` with the raw fields of that kind of page (texts that are cleaned later have been through NFKC)."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    fields = [StructField(k, _parse_datatype_string(_KINDS[k][0])) for k in kinds]
    keep = [c for c in pages.columns if c not in ("html", "listing", "detail")]
    made = [(to_arrow_type(f.dataType), _KINDS[f.name][1]) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                gc.disable()  # trees have no cycles, and the collector would walk them again and again
                try:
                    found = [[read(tree) for _, read in made] for tree in map(_tree, part.column("html").to_pylist())]
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array([x[k] for x in found], kind) for k, (kind, _) in enumerate(made))], names=[*keep, *kinds])

    return pages.mapInArrow(run, StructType([*(pages.schema[c] for c in keep), *fields]))


def _link(c: Column, base: str, hosts: Sequence[str]) -> Column:
    return safe_url(absolute_url(c, base), hosts)


def _without_icons(c: Column) -> Column:
    return F.regexp_replace(c, f"^(?:(?:{'|'.join(ICONS)}) )+(?=.)", "")


def entity_name(c: Column) -> Column:
    """A name without the icons before it."""
    return _without_icons(clean_text(c))


def extract_listings(pages: DataFrame, base: str, hosts: Sequence[str]) -> DataFrame:
    """Item rows of listing pages (page_id): position, id, url, title, creator, thumbnail, counters, and the page's last_page."""
    last = F.array_max(F.transform("listing.pages", lambda x: F.regexp_extract(x, r"[?&]page=([0-9]+)", 1).try_cast("int")))
    rows = _read(pages, "listing").where("listing.grid").select("page_id", last.alias("last_page"), F.posexplode("listing.cells").alias("pos", "x"))
    rows = rows.withColumn("url", _link(F.col("x.href"), base, hosts))
    return rows.select(
        "page_id", "pos", "last_page", item_id_of(F.col("url")).alias("item_id"), "url", clean_text(F.col("x.title"), normalised=True).alias("title"), F.nullif(clean_text(F.col("x.creator"), normalised=True), F.lit("")).alias("creator_name"),
        _link(F.col("x.thumbnail"), base, hosts).alias("thumbnail_url"), parse_compact_number(clean_text(F.try_element_at("x.stats", F.lit(1)), normalised=True)).alias("view_count"), parse_compact_number(clean_text(F.try_element_at("x.stats", F.lit(2)), normalised=True)).alias("favorite_count"),
    ).where("item_id is not null")


def _counter(icon: str) -> Column:
    values = F.filter("detail.counters", lambda x: x["icon"] == icon)
    return parse_compact_number(F.trim(F.try_element_at(values, F.lit(-1))["value"]))


def _entities(kind: str, base: str, hosts: Sequence[str]) -> Column:
    """The links of a kind as (id, name, url), each id once in document order (names have been through NFKC in ``_read``)."""
    links = F.transform(F.filter("detail.links", lambda x: F.contains(x["href"], F.lit(f"/{kind}/"))), lambda x: F.struct(
        _link(x["href"], base, hosts).alias("url"), x["name"].alias("name")))
    refs = F.transform(links, lambda x: F.struct(  # of a second pass, so that a link is resolved once
        entity_id_of(x["url"]).alias("id"), _without_icons(clean_text(x["name"], normalised=True)).alias("name"), x["url"].alias("url")))
    fine = F.filter(refs, lambda x: x["id"].isNotNull() & (x["name"] != ""))
    first = lambda links: F.filter(links, lambda x, i: F.array_position(F.transform(links, lambda y: y["id"]), x["id"]) == i + 1)
    return F.transform(F.array(fine), first)[0]  # bound by a lambda, so that the links are parsed once


def is_placeholder() -> Column:
    """A detail page that stands for a removed item."""
    first = lambda k: F.trim(F.try_element_at("detail.dates", F.lit(k)))
    dated = (first(1) == GONE_DATE) & (first(2) == GONE_TIME) & (_counter("remove_red_eye") == 0) & (_counter("favorite") == 0)
    return F.coalesce((F.trim(F.coalesce("detail.title", F.lit(""))) == "") & clean_text(F.col("detail.page_title"), normalised=True).isin(*PLACEHOLDER_TITLES) & dated, F.lit(False))


def extract_details(pages: DataFrame, base: str, hosts: Sequence[str], video_hosts: Sequence[str]) -> DataFrame:
    """One record for each detail page with an ``outcome``: ok, missing (placeholder) or drift (no title)."""
    rows = _read(pages, "detail")
    date = lambda k: F.trim(F.try_element_at("detail.dates", F.lit(k)))
    videos = F.filter(F.transform("detail.videos", lambda x: _link(x, base, video_hosts)), lambda x: x.isNotNull())
    title = clean_text(F.col("detail.clean_title"), normalised=True)
    url = _link(F.col("url"), base, hosts)
    rows = rows.withColumn("item_id", F.coalesce(item_id_of(F.col("url")), F.col("page_id")))
    return rows.select(
        "item_id", F.coalesce(url, F.concat(F.lit(f"{base}/movies/"), F.col("item_id").cast("string"))).alias("url"), title.alias("title"), F.try_element_at(videos, F.lit(1)).alias("video_url"),
        F.try_element_at(_entities("authors", base, hosts), F.lit(1)).alias("creator"), *(_entities(k, base, hosts).alias(k) for k in ("tags", "origins", "characters")),
        _link(F.col("detail.image"), base, hosts).alias("thumbnail_url"), F.when(date(1).rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat_ws(" ", date(1), date(2)).try_cast("timestamp_ntz")).alias("published_at"),
        _counter("remove_red_eye").alias("view_count"), _counter("favorite").alias("favorite_count"), F.nullif(clean_multiline(F.col("detail.comment")), F.lit("")).alias("comment"),
        F.when(is_placeholder(), "missing").when(title == "", "drift").otherwise("ok").alias("outcome"),
    )


def page_outcomes(pages: DataFrame, base: str, hosts: Sequence[str]) -> DataFrame:
    """(page_id, listing, detail): what each page would be as either kind."""
    title = F.trim(F.coalesce("detail.title", F.lit("")))
    return _read(pages, "listing", "detail").select(
        "page_id", F.when(F.col("listing.grid"), "ok").otherwise("drift").alias("listing"), F.when(is_placeholder(), "missing").when(title == "", "drift").otherwise("ok").alias("detail")
    )
