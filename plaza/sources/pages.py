"""Forum pages (HTML) to notes, comments, sub-comments and creators: one page at a time in a ``mapInArrow`` job.

The extractor reads elements by class tokens and ``data-field`` attributes that hold JSON; tokens, ids and field names are fixed values of the pages. Pages keep sections in HTML comments until a script
shows them; these are read like the rest. Times stay as they are written (``2024-8-6 22:11``), links become absolute. A page of replies does not say
whose replies they are: the caller knows, and gives ``parent_id``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.functions.batches import slices

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# What the pages of this forum call things.
HOME = "https://tieba.baidu.com"
_PLACE = re.compile(r"IP属地[:：]\s*([^\s<]+)")
_SENT = re.compile(r"发布于\s*(\S+)")
_SUFFIX = re.compile(r"_(?:百度贴吧|Baidu Tieba)$")
_TIME = re.compile(r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}(?::\d{2})?")
_THREAD = re.compile(r"/p/(\d+)")
_THREAD_ID = re.compile(r'"thread_id"\s*:\s*"?(\d+)"?')
_NUMBER = re.compile(r"\d+")
_MARK = re.compile("<!--|-->")
COLUMNS = "page_id bigint, kind string, native_id string, parent_id string, title string, content string, user_nickname string, user_link string, publish_time string, ip_location string, reply_count bigint, page_count bigint"


class Node:
    """An element. Nodes do not know their parents, so that a page is freed as soon as it has been read."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find(self, *tokens: str) -> list[Node]:
        """Descendants that have one of the class tokens."""
        want = set(tokens)
        return [n for n in self.walk() if "class" in n.attrs and want & n.classes()]

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                parts.append(n)
            else:
                todo += reversed(n.children)
        return " ".join("".join(parts).split())

    def field(self) -> dict:
        raw = self.attrs.get("data-field") or "{}"
        for text in (raw, raw.replace("'", '"')):
            try:
                got = json.loads(text)
            except ValueError:
                continue
            return got if isinstance(got, dict) else {}
        return {}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Node("html", {})
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(n)
        if tag not in _VOID:
            self.open.append(n)

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.top


def _first_text(node: Node | _Page, *tokens: str) -> str:
    found = node.find(*tokens)
    return found[0].text() if found else ""


def _first(pattern: re.Pattern, text: str, group: int = 0) -> str:
    m = pattern.search(text)
    return m[group] if m else ""


def _place(node: Node) -> str:
    """The place in the first text that names one; texts of neighbouring elements stand together without a space."""
    return next((m[1] for n in node.walk() for c in n.children if isinstance(c, str) and (m := _PLACE.search(c))), "")


def _absolute(href: str) -> str:
    return urljoin(HOME + "/", href) if href else ""


def _link(node: Node, *tokens: str) -> str:
    found = [n for n in node.find(*tokens) if n.attrs.get("href")]
    return _absolute(found[0].attrs["href"]) if found else ""


def _count(text: object) -> int:
    return int(_first(_NUMBER, str(text or "").replace(",", "")) or 0)


def _record(kind: str, native: str, parent: str | None = None, title: str | None = None, content: str | None = None, name: str | None = None, link: str | None = None, time: str | None = None, place: str | None = None, replies: int | None = None, pages: int | None = None) -> tuple:
    return kind, native, parent, title, content, name, link, time, place, replies, pages


class _Page:
    """The elements of a page by class token, so that a page is walked once for all kinds of records."""

    def __init__(self, top: Node):
        self.top, self.of = top, {}
        for at, n in enumerate(top.walk()):
            if "class" in n.attrs:
                for c in n.classes():
                    self.of.setdefault(c, []).append((at, n))

    def find(self, *tokens: str) -> list[Node]:
        found = {at: n for c in tokens for at, n in self.of.get(c, [])}
        return [found[at] for at in sorted(found)]


def _cards(top: _Page) -> Iterator[tuple]:
    """Threads in results of a search, of both layouts, each thread once."""
    seen = set()
    for n in top.find("s_post", "thread_item", "threadlist_lz", "threadcardclass"):
        link = next((a.attrs.get("href", "") for a in n.walk() if a.tag == "a" and _THREAD.search(a.attrs.get("href", ""))), "")
        native = _first(_THREAD, link, 1)
        if not native or native in seen or "j_thread_list" in n.classes():
            continue
        seen.add(native)
        head, content = _first_text(n, "top-title"), _first_text(n, "p_content", "threadlist_abs", "abstract-wrap")
        sent = _first(_SENT, head, 1)
        name = _first_text(n, "p_violet", "tb_icon_author", "forum-attention") or (head.split("发布于")[0].strip() if sent else "")
        replies = _count(_first_text(n, "comment-link-zone")) if n.find("comment-link-zone") else None
        yield _record("note", native, None, _first_text(n, "p_title", "threadlist_title", "title-wrap") or content[:80], content, name, _link(n, "p_violet", "frs-author-name"), sent or _first(_TIME, n.text()), _place(n), replies)


def _listed(top: _Page) -> Iterator[tuple]:
    """Threads in the list of a forum."""
    for n in top.find("j_thread_list"):
        field = n.field()
        if native := str(field.get("id") or ""):
            name = str(field.get("author_nickname") or field.get("author_name") or "") or _first_text(n, "frs-author-name")
            yield _record("note", native, None, _first_text(n, "j_th_tit") or _first_text(n, "threadlist_title"), _first_text(n, "threadlist_abs"), name, _link(n, "frs-author-name"), "", "", _count(field.get("reply_num")))


def _detail(top: _Page, html: str) -> Iterator[tuple]:
    """The thread of a page of posts, from its first post and the totals beside it."""
    posts, totals = top.find("l_post"), [x for n in top.find("l_reply_num") for x in n.find("red")]
    if not posts:
        return
    only = next((n.attrs.get("href", "") for n in top.top.walk() if n.attrs.get("id") == "lzonly_cntn"), "")
    native = only.split("?")[0].rsplit("/", 1)[-1] or (_first(_THREAD_ID, html, 1) if totals else "")
    if not native:
        return
    forum, title = _first_text(top, "card_title_fname").removesuffix("吧"), next((n.text() for n in top.top.walk() if n.tag == "title"), "")
    title = _SUFFIX.sub("", title).replace(f"【{forum}吧】", "").replace(f"【{forum}】", "").strip()
    told = next((n.attrs.get("content", "") for n in top.top.walk() if n.tag == "meta" and n.attrs.get("name") == "description"), "")
    author = posts[0].field().get("author") or {}
    name = _first_text(posts[0], "p_author_name") or str(author.get("user_nickname") or author.get("user_name") or "")
    replies, pages = [_count(x.text()) for x in totals[:2]] + [0] * (2 - len(totals[:2]))
    yield _record("detail", native, None, title, told.strip(), name, _link(posts[0], "p_author_face", "p_author_name"), _first(_TIME, posts[0].text()), _place(posts[0]), replies, pages)


def _posts(top: _Page) -> Iterator[tuple]:
    for n in top.find("l_post"):
        field = n.field()
        content, author = field.get("content") or {}, field.get("author") or {}
        if post := str(content.get("post_id") or n.attrs.get("data-pid") or ""):
            name = str(author.get("user_name") or "") or _first_text(n, "p_author_name")
            yield _record("comment", post, None, None, _first_text(n, "d_post_content", "j_d_post_content"), name, _link(n, "p_author_name"), _first(_TIME, n.text()), _place(n), _count(content.get("comment_num")))


def _replies(top: _Page, parent: str | None) -> Iterator[tuple]:
    for n in top.find("lzl_single_post"):
        field = n.field()
        if native := str(field.get("spid") or ""):
            name = str(field.get("showname") or field.get("user_name") or "")
            yield _record("sub_comment", native, str(field.get("pid") or "") or parent, None, _first_text(n, "lzl_content_main"), name, _link(n, "lzl_p_p", "at"), _first(_TIME, _first_text(n, "lzl_time")), _place(n))


def records(html: str | None, parent: str | None = None) -> list[tuple]:
    """(kind, native_id, parent_id, title, content, user_nickname, user_link, publish_time, ip_location, reply_count, page_count) of one page."""
    html = _MARK.sub("", html or "")
    top = _Page(parse(html))
    out = [*_cards(top), *_listed(top), *_detail(top, html), *_posts(top), *_replies(top, parent)]
    for n in top.find("userinfo_userdata", "userinfo_wrap"):
        if name := _first_text(n, "userinfo_username"):
            out.append(_record("creator", name, name=name, place=_place(n)))
            break
    return out


_FIELDS = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (c.split() for c in COLUMNS.split(", "))])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b):
            rows = [(page, *r) for page, html, parent in zip(*[c.to_pylist() for c in part.columns], strict=True) for r in records(html, parent)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FIELDS.types, strict=True)] if rows else [pa.array([], t) for t in _FIELDS.types], schema=_FIELDS)


def extract(pages: DataFrame) -> DataFrame:
    """Records of all kinds of the forum pages ``pages`` (page_id, html, and parent_id for pages of replies, if there is one)."""
    parent = F.col("parent_id").cast("string") if "parent_id" in pages.columns else F.lit(None).cast("string").alias("parent_id")
    return pages.select(F.col("page_id").cast("bigint"), "html", parent).mapInArrow(_extract, COLUMNS)
