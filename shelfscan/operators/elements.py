"""Markup to elements: the one place where pages pass through Python.

Each page becomes an array of elements in document order, interval-encoded:
``id`` is the position of the start tag, ``end`` the largest id in the subtree, so
``a`` contains ``b`` when ``a.id < b.id <= a.end``. Texts are not repeated per
level: the page text is stored once and every element points at its part of it.
``marks_*`` are bits that say which simple selectors of the rules the element matches.

Pages of plain markup whose tags are nested are read together, a batch at a time: tags are looked
up once for each different one, and places in the trees and texts are found by array operations.
Other pages are read one by one.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from contextlib import contextmanager
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .marks import BITS, NAMES, marks

ELEMENTS_TYPE = (
    "array<struct<id:int,end:int,depth:int,tag:string,classes:array<string>,"
    "attrs:map<string,string>,text_at:int,text_len:int,"
    + ",".join(f"{n}:bigint" for n in NAMES) + ">>"
)

# Elements without content, elements whose content is not page text.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
MUTE_TAGS = frozenset(["script", "style", "template"])

# Tags after which the standard parser reads text by other rules.
_PARSER_MODES = frozenset(
    "script style textarea title xmp iframe noembed noframes plaintext noscript".split()
)

# Plain markup, which needs no state of the standard parser: scripts and styles up to their own
# end, tags with quoted attributes, comments without a double hyphen, the document type.
_SPLIT = re.compile(
    r"(<script>(?:[^<]|<(?!!|/\s*(?i:script)))*</script>"
    r"|<style>(?:[^<]|<(?!!|/\s*(?i:style)))*</style>|<[^>]*>)"
)
_ATTRIBUTE = r"""\s+([a-zA-Z][\w:-]*)="([^"<>]*)\""""
_START = re.compile(rf"<([a-zA-Z][a-zA-Z0-9]*)((?:{_ATTRIBUTE})*)\s*(/?)>", re.ASCII)
_ATTRIBUTES = re.compile(_ATTRIBUTE, re.ASCII)
_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
_ASIDE = re.compile(r"<!--(?:[^<>-]|-(?!-))*-->|<!doctype(?: [\w ]*)?>", re.I | re.ASCII)
_PLAIN_END, _PLAIN_ASIDE, _PLAIN_START, _PLAIN_EMPTY = range(4)

# Result pages repeat most tags: what they mean is kept within a task, up to this many
# different ones of at most this length.
_PLAIN: dict[str, tuple] = {}
_KNOWN_TAGS: dict[str, tuple[str, dict, list]] = {}
_KNOWN_LIMIT = 20_000
_KNOWN_LENGTH = 160

# Tags of one page each (addresses, item ids) differ in attribute values only: what is outside
# the quotes is read once for all of them.
_SHAPES: dict[str, tuple | None] = {}

# Rows handed back per Arrow batch, so one batch of large pages stays small.
_ROWS_PER_BATCH = 64

_ELEMENT = pa.struct(
    [
        ("id", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
        ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
        ("text_at", pa.int32()), ("text_len", pa.int32()), *[(n, pa.int64()) for n in NAMES],
    ]
)


class _Elements(HTMLParser):
    """Collects the elements of one page.

    A row is ``[end, depth, tag, attrs, text_at, text_len, classes]``.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.open_count: dict[str, int] = {}
        self.muted = 0
        self.chars = 0
        self.stripped: list[str] = []
        self.raw: list[str] = []
        self.pending: list[str] = []

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def _flush(self) -> None:
        if not self.pending:
            return
        text = "".join(self.pending)
        self.pending.clear()
        if self.muted:
            return
        bare = text.strip()
        if bare:
            self.stripped.append(bare)
            self.chars += len(bare)
            self.raw.append(text)
        else:
            self.raw.append("\n" if "\n" in text else " ")

    def _close_last(self) -> None:
        number = self.open.pop()
        row = self.rows[number]
        row[0] = len(self.rows) - 1
        row[5] = self.chars - row[4]
        self.open_count[row[2]] -= 1
        self.muted -= row[2] in MUTE_TAGS

    def read_plain(self, html: str) -> bool:
        """Collect the elements of a page of plain markup; False, and nothing usable, for others.

        Gives what feeding the page to the standard parser gives.
        """
        rows, opened, count, muted, chars = self.rows, self.open, self.open_count, 0, 0
        pieces = _SPLIT.split(html)
        last = pieces.pop()
        if "<" in last or "&" in last:
            return False
        known = _PLAIN.get
        titled = False
        for text, tag in zip(pieces[::2], pieces[1::2]):
            if text:
                if "<" in text:
                    return False
                if "&" in text:
                    if titled:
                        return False
                    text = unescape(text)
                if not muted:
                    bare = text.strip()
                    if bare:
                        self.stripped.append(bare)
                        chars += len(bare)
                        self.raw.append(text)
                    else:
                        self.raw.append("\n" if "\n" in text else " ")
            found = known(tag) or _plain(tag)
            if found is None or titled and found[:2] != (_PLAIN_END, "title"):
                return False
            kind, name, values, classes, _ = found
            titled = False
            if kind == _PLAIN_START:
                number = len(rows)
                rows.append([number, len(opened), name, values, chars, 0, classes])
                opened.append(number)
                count[name] = count.get(name, 0) + 1
                if name == "template":
                    muted += 1
                titled = name == "title"
            elif kind == _PLAIN_END:
                if count.get(name):
                    while True:
                        row = rows[opened.pop()]
                        row[0] = len(rows) - 1
                        row[5] = chars - row[4]
                        count[row[2]] -= 1
                        if row[2] == "template":
                            muted -= 1
                        if row[2] == name:
                            break
            elif kind != _PLAIN_ASIDE:
                rows.append([len(rows), len(opened), name, values, chars, 0, classes])
        if titled:
            return False
        self.muted, self.chars = muted, chars
        if last:
            self.pending.append(last)
            self._flush()
        while self.open:
            self._close_last()
        return True

    def parse_starttag(self, i: int) -> int:
        end = self.check_for_whole_start_tag(i)
        source = self.rawdata[i:end] if 0 <= end - i <= _KNOWN_LENGTH else ""
        if source in _KNOWN_TAGS:
            self._open(*_KNOWN_TAGS[source])
            return end
        before = len(self.rows)
        end = super().parse_starttag(i)
        # only plain tags: not self-closed, and none that switch the parser's mode
        if source and len(self.rows) == before + 1 and not source.endswith("/>"):
            row = self.rows[before]
            if row[2] not in _PARSER_MODES:
                if len(_KNOWN_TAGS) >= _KNOWN_LIMIT:
                    _KNOWN_TAGS.clear()
                _KNOWN_TAGS[source] = (row[2], row[3], row[6])
        return end

    def handle_starttag(self, tag: str, attrs: list) -> None:
        # the last of repeated attributes wins; class names are separated by one space
        values = {k: v or "" for k, v in attrs}
        classes = values["class"].split() if "class" in values else []
        if classes:
            values["class"] = " ".join(classes)
        self._open(tag, values, classes)

    def _open(self, tag: str, values: dict, classes: list) -> None:
        self._flush()
        number = len(self.rows)
        self.rows.append([number, len(self.open), tag, values, self.chars, 0, classes])
        if tag not in VOID_TAGS:
            self.open.append(number)
            self.open_count[tag] = self.open_count.get(tag, 0) + 1
            self.muted += tag in MUTE_TAGS

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close_last()

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if self.open_count.get(tag):
            while self.rows[self.open[-1]][2] != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_decl(self, decl: str) -> None:
        self._flush()

    def handle_pi(self, data: str) -> None:
        self._flush()

    def unknown_decl(self, data: str) -> None:
        self._flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[len("CDATA["):])
            self._flush()

    def finish(self) -> None:
        self.close()
        self._flush()
        while self.open:
            self._close_last()


def _shape(outside: str) -> tuple | None:
    """(kind, name, attribute names) of start tags from what is outside their quotes.

    None where these are no plain start tags; the kind is None for tags that need the parser's modes.
    """
    if outside in _SHAPES:
        return _SHAPES[outside]
    start = _START.fullmatch(outside.replace('"', '""'))
    found = None
    if start:
        name = start[1].lower()
        empty = start[5] or name in VOID_TAGS
        kind = _PLAIN_EMPTY if empty else _PLAIN_START
        if name in _PARSER_MODES and (name != "title" or empty):
            kind = None
        found = (kind, name, [k.lower() for k, _ in _ATTRIBUTES.findall(start[2])])
    if len(outside) <= _KNOWN_LENGTH:
        if len(_SHAPES) >= _KNOWN_LIMIT:
            _SHAPES.clear()
        _SHAPES[outside] = found
    return found


def _plain(tag: str) -> tuple | None:
    """(kind, name, attributes, class names, marks) of a tag in plain markup, None for any other."""
    parts = tag.split('"')
    shape = _shape('"'.join(parts[::2])) if tag.find("<", 1) < 0 and len(parts) % 2 else None
    if shape:
        kind, name, keys = shape
        if kind is None:
            return None
        given = [unescape(v) if "&" in v else v for v in parts[1::2]] if "&" in tag else parts[1::2]
        values = dict(zip(keys, given))
        classes = values["class"].split() if "class" in values else []
        if classes:
            values["class"] = " ".join(classes)
        found = (kind, name, values, classes, marks(name, values, classes))
    elif end := _END.fullmatch(tag):
        found = (_PLAIN_END, end[1].lower(), {}, [], 0)
    elif tag.startswith(("<script>", "<style>")) and tag.endswith(("</script>", "</style>")):
        name = "script" if tag.endswith("</script>") else "style"
        found = (_PLAIN_EMPTY, name, {}, [], marks(name, {}, []))
    else:
        found = (_PLAIN_ASIDE, "", {}, [], 0) if _ASIDE.fullmatch(tag) else None
    if found and len(tag) <= _KNOWN_LENGTH:
        if len(_PLAIN) >= _KNOWN_LIMIT:
            _PLAIN.clear()  # mostly tags of one page each; the common ones are soon back
        _PLAIN[tag] = found
    return found


def _parse(html: str | None) -> tuple[_Elements, str | None]:
    page = _Elements()
    if page.read_plain(html or ""):
        return page, None
    page = _Elements()
    try:
        page.feed(html or "")
        page.finish()
    except (AssertionError, ValueError) as error:
        return _Elements(), f"{type(error).__name__}: {error}"
    return page, None


def parsed_elements(html: str | None) -> tuple[list, str]:
    """(end, depth, tag, attrs, text_at, text_len, classes) of every element, and the page's text."""
    page, _ = _parse(html)
    return page.rows, "".join(page.stripped)


def _offsets(lengths: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64)))), pa.int32())


def _words(found: np.ndarray | list[int]) -> list[np.ndarray]:
    """Marks as one array of 64-bit numbers for each of ``NAMES``."""
    low = (1 << BITS) - 1
    return [np.array([m >> BITS * i & low for m in found], np.int64) for i in range(len(NAMES))]


def _described(tags: list[str], classes: list[list[str]], attributes: list[dict]) -> list[pa.Array]:
    """Arrow arrays of the names, class names and attributes of tags."""
    return [
        pa.array(tags, pa.string()),
        pa.ListArray.from_arrays(
            _offsets([len(c) for c in classes]),
            pa.array([c for names in classes for c in names], pa.string()),
        ),
        pa.MapArray.from_arrays(
            _offsets([len(a) for a in attributes]),
            pa.array([k for a in attributes for k in a], pa.string()),
            pa.array([v for a in attributes for v in a.values()], pa.string()),
        ),
    ]


def _element_arrays(pages: list[_Elements]) -> pa.Array:
    """All elements of pages read one by one as one list array, built column by column."""
    rows = [row for page in pages for row in page.rows]
    ids = [i for page in pages for i in range(len(page.rows))]
    struct = pa.StructArray.from_arrays(
        [
            pa.array(ids, pa.int32()),
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.int32()),
            *_described([r[2] for r in rows], [r[6] for r in rows], [r[3] for r in rows]),
            pa.array([r[4] for r in rows], pa.int32()),
            pa.array([r[5] for r in rows], pa.int32()),
            *map(pa.array, _words([marks(r[2], r[3], r[6]) for r in rows])),
        ],
        fields=list(_ELEMENT),
    )
    return pa.ListArray.from_arrays(_offsets([len(p.rows) for p in pages]), struct)


class _Batch:
    """Tags and texts of many pages, in order; a page has one text more than tags.

    ``plain`` are the pages of plain markup; the others hold nothing.
    """

    def __init__(self, pages: list[str | None]) -> None:
        split, tags, texts, sizes = _SPLIT.split, [], [], []
        self.plain = np.ones(len(pages), bool)
        for number, html in enumerate(pages):
            pieces = split(html or "")
            if "<" in pieces[-1] or "&" in pieces[-1]:
                self.plain[number] = False
                pieces = [""]
            texts += pieces[::2]
            tags += pieces[1::2]
            sizes.append(len(pieces) // 2)
        distinct, known = dict.fromkeys(tags), _PLAIN.get
        entries = [known(t) or _plain(t) or (-1, "", {}, [], 0) for t in distinct]
        number_of = dict(zip(distinct, range(len(entries))))
        self.entries, self.texts = entries, texts
        self.codes = np.fromiter(map(number_of.__getitem__, tags), np.int64, len(tags))
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.page = np.repeat(np.arange(len(pages)), self.sizes)
        self.kinds = np.array([e[0] for e in entries], np.int64)[self.codes]
        names = dict.fromkeys(e[1] for e in entries)
        name_of = dict(zip(names, range(len(names))))
        self.names = np.array([name_of[e[1]] for e in entries], np.int64)[self.codes]
        self.plain[self.page[self.kinds < 0]] = False
        opens = self.kinds == _PLAIN_START
        if "title" in name_of:
            # a title holds nothing but its text, up to its end
            for at in np.nonzero(opens & (self.names == name_of["title"]))[0].tolist():
                page, after = self.page[at], at + 1
                if (
                    after == len(self.codes)
                    or self.page[after] != page
                    or entries[self.codes[after]][:2] != (_PLAIN_END, "title")
                    or "&" in texts[after + page]
                ):
                    self.plain[page] = False
        # content of a template is not page text: such pages are read one by one
        self.muted = np.zeros(len(pages), bool)
        if "template" in name_of:
            self.muted[self.page[opens & (self.names == name_of["template"])]] = True


def _read_nested(pages: list[str | None], raw_text: bool) -> tuple[np.ndarray, pa.Array, list[str], list[str]]:
    """Which pages are plain and nested, and the elements, text and raw text of these, in order.

    Gives what ``read_plain`` gives. ``raw_text`` off: the last is empty.
    """
    batch = _Batch(pages)
    page, kinds = batch.page, batch.kinds
    good = batch.plain & ~batch.muted
    opens, shuts = kinds == _PLAIN_START, kinds == _PLAIN_END
    is_row = opens | (kinds == _PLAIN_EMPTY)

    def within(steps: np.ndarray) -> np.ndarray:
        """Running sum of steps within each page, its own included."""
        sums = np.concatenate(([0], np.cumsum(steps)))
        return sums[1:] - sums[batch.starts[page]]

    step = opens.astype(np.int64) - shuts
    after = within(step)
    good[page[after < 0]] = False
    level = after - opens  # depth of an element, and of the one that a tag ends
    texts = [unescape(t) if "&" in t else t for t in batch.texts]
    bare = list(map(str.strip, texts))
    length = np.fromiter(map(len, bare), np.int64, len(bare))
    chars = np.concatenate(([0], np.cumsum(length)))
    first_text = batch.starts + np.arange(len(pages))
    end_text = first_text + batch.sizes + 1
    at = chars[np.arange(len(page)) + page + 1] - chars[first_text[page]]
    rows = within(is_row)
    counts = np.bincount(page[is_row], minlength=len(pages))

    # Tags of one level of a page begin and end by turns: the next one is the end.
    nested = np.nonzero(opens | shuts)[0]
    deepest = int(level.max(initial=0)) + 2
    nested = nested[np.argsort(page[nested] * deepest + np.maximum(level[nested], -1) + 1, kind="stable")]
    one, other = nested[:-1], nested[1:]
    pair = opens[one] & shuts[other] & (page[one] == page[other]) & (level[one] == level[other])
    one, other = one[pair], other[pair]
    good[page[one[batch.names[one] != batch.names[other]]]] = False
    end, text_end = counts[page] - 1, (chars[end_text] - chars[first_text])[page]
    end[one], text_end[one] = rows[other] - 1, at[other]

    kept = np.nonzero(is_row & good[page])[0]
    single = kinds[kept] == _PLAIN_EMPTY
    ids, codes = rows[kept] - 1, batch.codes[kept]
    used = np.unique(codes)
    codes = np.searchsorted(used, codes)
    entries = [batch.entries[i] for i in used.tolist()]
    names = _described([e[1] for e in entries], [e[3] for e in entries], [e[2] for e in entries])
    index = pa.array(codes)
    struct = pa.StructArray.from_arrays(
        [
            pa.array(ids, pa.int32()),
            pa.array(np.where(single, ids, end[kept]), pa.int32()),
            pa.array(level[kept], pa.int32()),
            *[column.take(index) for column in names],
            pa.array(at[kept], pa.int32()),
            pa.array(np.where(single, 0, text_end[kept] - at[kept]), pa.int32()),
            *[pa.array(word[codes]) for word in _words([e[4] for e in entries])],
        ],
        fields=list(_ELEMENT),
    )
    chosen = np.nonzero(good)[0].tolist()
    spans = [(int(first_text[p]), int(end_text[p])) for p in chosen]
    raw = [
        "".join(t if b else "\n" if "\n" in t else " " for t, b in zip(texts[i:j], bare[i:j]) if t)
        for i, j in (spans if raw_text else [])
    ]
    trees = pa.ListArray.from_arrays(_offsets(counts[good]), struct)
    return good, trees, ["".join(bare[i:j]) for i, j in spans], raw


def _read(pages: list[str | None], raw_text: bool = False) -> list[pa.Array]:
    """Elements, text, parse error and, if wanted, raw text of pages."""
    good, trees, texts, raw = _read_nested(pages, raw_text)
    errors: list[str | None] = [None] * len(texts)
    if not good.all():
        others = [_parse(pages[i]) for i in np.nonzero(~good)[0].tolist()]
        trees = pa.concat_arrays([trees, _element_arrays([p for p, _ in others])])
        texts += ["".join(p.stripped) for p, _ in others]
        errors += [e for _, e in others]
        raw += ["".join(p.raw) for p, _ in others]
    columns = [trees, pa.array(texts, pa.string()), pa.array(errors, pa.string())]
    if raw_text:
        columns.append(pa.array(raw, pa.string()))
    if good.all():
        return columns
    place = np.empty(len(pages), np.int64)
    place[np.concatenate((np.nonzero(good)[0], np.nonzero(~good)[0]))] = np.arange(len(pages))
    return [c.take(pa.array(place)) for c in columns]


def _errors(pages: list[str | None]) -> list[str | None]:
    """Parse error of each page; plain markup has none."""
    plain = _Batch(pages).plain
    return [None if fine else _parse(html)[1] for fine, html in zip(plain.tolist(), pages)]


@contextmanager
def _without_cycle_search() -> Iterator[None]:
    """Elements hold no cycles: looking for some while many are made finds nothing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def page_elements(pages: DataFrame, html: str = "html", raw_text: bool = False) -> DataFrame:
    """Replace the ``html`` column by ``elements``, ``text`` and ``parse_error``.

    ``raw_text`` adds the text with its white space. All other columns are passed
    through; select only what is needed before, whole rows travel to Python.
    """
    kept = [c for c in pages.columns if c != html]
    fields = [pages.schema[c] for c in kept] + [
        T.StructField("elements", T.DataType.fromDDL(ELEMENTS_TYPE)),
        T.StructField("text", T.StringType()),
        T.StructField("parse_error", T.StringType()),
    ]
    if raw_text:
        fields.append(T.StructField("raw_text", T.StringType()))

    def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS_PER_BATCH):
                batch = whole.slice(start, _ROWS_PER_BATCH)
                with _without_cycle_search():
                    found = _read(batch.column(html).to_pylist(), raw_text)
                columns = [*(batch.column(c) for c in kept), *found]
                names = [*kept, *["elements", "text", "parse_error", "raw_text"][: len(found)]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return pages.select(*kept, html).mapInArrow(parse_batches, T.StructType(fields))


def page_parse_errors(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the ``html`` column by ``parse_error``; the pages' elements stay in the task."""
    kept = [c for c in pages.columns if c != html]
    fields = [pages.schema[c] for c in kept] + [T.StructField("parse_error", T.StringType())]

    def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with _without_cycle_search():
                errors = _errors(batch.column(html).to_pylist())
            columns = [*(batch.column(c) for c in kept), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "parse_error"])

    return pages.select(*kept, html).mapInArrow(parse_batches, T.StructType(fields))
