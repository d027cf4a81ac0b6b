"""Items of listing pages, read in one pass over the tokens of a page, in Arrow batches.

The same tokens, blocks and texts as those of ``markup``: a block runs from its opening tag to the closing tag that
belongs to it; a closing tag without an opening one is passed over, and a block that is never closed reaches to the
end.  Patterns mean what they mean there: only ASCII letters lose their case, only ASCII whitespace is ``\\s``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

from .markup import ENTITIES

ITEM = "nth int, anchors array<string>, title string, info string, subject string"
_ASCII = re.I | re.S | re.A
# the tags of ``markup``, its loop unrolled: a split by them has texts at even places, each lone "<" among them, and tags at odd ones
_TAG = re.compile(r"""(<[/!a-zA-Z][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>|<[/!a-zA-Z][^>]*>)""", re.S)
_PIECES, _COMMENT = re.compile(r"[^<]+|<"), re.compile(r"(?s)<!--.*?-->")
_CLASS = re.compile(r"""\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", _ASCII)
_BLANKS, _CLOSED = re.compile(r"\s+", re.A), re.compile(r"/\s*>$", re.A)


def _classes(tag: str) -> str:
    found = _CLASS.search(tag)
    return f" {_BLANKS.sub(' ', found[found.lastindex] if found and found.lastindex else '')} "


#: Tags whose reading is kept, and the characters such a tag may have.
KEPT_TAGS, KEPT_LENGTH = 20_000, 200


def _tags(*names: str) -> Callable[[list[str]], tuple[list, ...]]:
    """For each name (place, classes where it opens) of its tags among the parts of a page; tags that close themselves
    are neither.  At last (place, tag) of those that begin like links."""
    tag = re.compile(rf"<(/?)({'|'.join(names)})(?=([\s/>]))", _ASCII).match
    letters = {c for name in names for c in (name[0].lower(), name[0].upper(), "/")}
    missing = object()
    kept: dict[str, tuple[str, str | None] | None] = {}

    def read(part: str) -> tuple[str, str | None] | None:
        own = tag(part)
        if not own:
            return None
        if own[1]:
            return None if own[3] == "/" else (own[2].lower(), None)
        return None if _CLOSED.search(part) else (own[2].lower(), _classes(part))

    def known(part: str) -> tuple[str, str | None] | None:
        if len(part) > KEPT_LENGTH:
            return read(part)
        if len(kept) >= KEPT_TAGS:
            kept.clear()
        return kept.setdefault(part, read(part))

    def found(parts: list[str]) -> tuple[list, ...]:
        out: dict[str, list[tuple[int, str | None]]] = {name.lower(): [] for name in names}
        anchors: list[tuple[int, str]] = []
        for at in range(1, len(parts), 2):
            part = parts[at]
            letter = part[1]
            if letter in letters:
                own = kept.get(part, missing)
                if own is missing:
                    own = known(part)
                if own:
                    out[own[0]].append((at, own[1]))
            if letter in "aA":
                anchors.append((at, part))
        return *(out[name.lower()] for name in names), anchors
    return found


def _text(parts: list[str], first: int, last: int) -> str:
    """Stripped texts behind a tag, one behind the other."""
    texts = parts[first + 1:last + 1:2]
    whole = "".join(texts)
    if "<" in whole:
        texts = [t for text in texts for t in _PIECES.findall(text)]
    if "&" in whole:
        for entity, char in ENTITIES:
            texts = [t.replace(entity, char) for t in texts]
    return "".join([t.strip() for t in texts])


def reader(page: dict) -> Callable[[str], list[tuple[list[str], str, str, str]]]:
    """A function of a page: (tokens that begin like links, title, info line, subject) of its items, in order."""
    dropped = [(f"<{tag.lower()}", re.compile(rf"<{tag}\b[^>]*>.*?</{tag}\s*>", _ASCII)) for tag in page["drop_tags"]]
    tagged, length = _tags("div", page["title_tag"]), page["subject_length"]
    wanted, info, subject = (f" {page[c]} " for c in ("item_class", "info_class", "subject_class"))

    def title(parts: list[str], tags: list[tuple[int, str | None]], first: int, last: int) -> str:
        start, depth = None, 0
        for at, own in tags:
            if not first <= at <= last or start is None and own is None:
                continue
            start, depth = at if start is None else start, depth + (-1 if own is None else 1)
            if not depth:
                return _text(parts, start, at)
        return "" if start is None else _text(parts, start, last)

    def items(html: str) -> list[tuple[list[str], str, str, str]]:
        lower = html.lower()
        for head, pattern in dropped:
            if head in lower:
                html = pattern.sub("", html)
                lower = html.lower()   # a tag may have come together
        if "<!--" in html:
            html = _COMMENT.sub("", html)
        parts = _TAG.split(html)
        opened: list[int] = []
        ends: dict[int, int] = {}
        divs, tags, anchors = tagged(parts)
        for at, own in divs:
            if own is not None:
                opened.append(at)
                ends[at] = len(parts) - 1
            elif opened:
                ends[opened.pop()] = at
        # blocks of the wanted classes, by their place
        named = [(at, own, ends[at]) for at, own in divs if own is not None and (wanted in own or info in own or subject in own)]

        def block(first: int, last: int, of: str) -> str:
            found = next(((at, end) for at, own, end in named if first <= at <= last and of in own), None)
            return _text(parts, *found) if found else ""

        return [([t for at, t in anchors if first <= at <= last], title(parts, tags, first, last), block(first, last, info), block(first, last, subject)[:length])
                for first, own, last in named if wanted in own]
    return items


def listed_items(page: dict):
    """Rows of ``page_id, html`` to one row per item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = reader(page)
        for batch in batches:
            found = [(row, nth, *item) for row, html in enumerate(batch.column("html").to_pylist()) if html is not None
                     for nth, item in enumerate(items(html))]
            rows, nth, anchors, *texts = zip(*found) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").take(pa.array(rows, pa.int64())), pa.array(nth, pa.int32()), pa.array(anchors, pa.list_(pa.string())), *(pa.array(t, pa.string()) for t in texts)],
                names=["page_id", "nth", "anchors", "title", "info", "subject"])
    return run
