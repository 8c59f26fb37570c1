"""Simple selectors that rules share, as bits of an element.

A simple selector is a tag, classes and attributes of one element, without its ancestors. Those of
the given rules are numbered once; the tokenizer notes which of them an element matches, so that a
rule tests a bit instead of comparing names. Other selectors are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from ..plans import rules as R

_PART = re.compile(
    r"""(?P<tag>^[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|:not\(\.(?P<without>[\w-]+)\)"""
    r"""|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)"(?P<value>[^"]*)")?\]"""
)
TOKEN = re.compile(r"""\s*>\s*|\s+|(?:\[[^\]]*\]|[^\s>\[])+""")

# Bits of one number; an element has as many numbers as it takes.
BITS = 62


def parts(compound: str) -> list[tuple[str, str, str | None, str | None]]:
    """(kind, name, operator, value) of the conditions of a simple selector."""
    found, at = [], 0
    while at < len(compound):
        part = _PART.match(compound[at:])
        if part is None or (at and part.group("tag")):
            raise ValueError(f"unsupported selector part: {compound!r}")
        kind = next(k for k in ("tag", "cls", "without", "attr") if part.group(k))
        name = part.group(kind)
        found.append((kind, name.lower() if kind == "tag" else name, part.group("op"), part.group("value")))
        at += part.end()
    return found


def _selectors(rules: object) -> Iterable[str]:
    if isinstance(rules, str):
        yield rules
    elif isinstance(rules, Mapping):
        for value in rules.values():
            yield from _selectors(value)
    else:
        for value in rules:
            yield from _selectors(value)


def _compounds() -> list[str]:
    given = [
        R.RICH_RULES, R.BASIC_RULES, R.ID_RULES, R.RICH_CARD, R.BASIC_CARD, R.ID_CONTAINER, R.ID_CARD,
        R.SAMPLE_CARDS, R.SAMPLE_TITLE, R.SAMPLE_LINK, [s for _, s in R.INSPECTION_RULES],
        [f"[{a}]" for a in R.IMAGE_ATTRIBUTES],
    ]
    tokens = (t for s in _selectors(given) for t in TOKEN.findall(s.strip()))
    return list(dict.fromkeys(t for t in tokens if t.strip() not in ("", ">")))


NUMBERS = {compound: i for i, compound in enumerate(_compounds())}
NAMES = [f"marks_{i}" for i in range(-(-len(NUMBERS) // BITS))]


def bit(compound: str) -> tuple[str, int] | None:
    """The number of an element and the bit in it that stand for a simple selector, if any do."""
    at = NUMBERS.get(compound)
    return None if at is None else (NAMES[at // BITS], 1 << at % BITS)


def _filed() -> tuple[dict, dict]:
    """Known simple selectors by a class, and the others by the tag they need."""
    by_class: dict[str, list] = {}
    by_tag: dict[str, list] = {}
    for compound, at in NUMBERS.items():
        found = parts(compound)
        tag = next((n for k, n, _, _ in found if k == "tag"), "")
        with_, without = ([n for k, n, _, _ in found if k == kind] for kind in ("cls", "without"))
        attributes = [(n, op, value) for k, n, op, value in found if k == "attr"]
        if with_:
            by_class.setdefault(with_[0], []).append((1 << at, tag, with_[1:], without, attributes))
        elif without or len(attributes) > 1:
            raise ValueError(f"neither a class nor one attribute or tag decides: {compound!r}")
        else:
            by_tag.setdefault(tag, []).append((1 << at, *(attributes[0] if attributes else ("", None, None))))
    return by_class, by_tag


_BY_CLASS, _BY_TAG = _filed()

# What the tag and the names of its attributes say, for up to this many different ones.
_SHAPES: dict[tuple, tuple] = {}
_SHAPES_LIMIT = 20_000


def _shape(tag: str, names: Sequence[str]) -> tuple[int, list]:
    """Marks of all tags with these attributes, and (bit, name, whole, value) that their values decide."""
    out, checks = 0, []
    for own, name, op, value in [*_BY_TAG.get(tag, ()), *_BY_TAG.get("", ())]:
        if not name or op is None and name in names:
            out |= own
        elif name in names:
            checks.append((own, name, op == "=", value))
    if len(_SHAPES) >= _SHAPES_LIMIT:
        _SHAPES.clear()
    _SHAPES[(tag, *names)] = out, checks
    return out, checks


def marks(tag: str, values: Mapping[str, str], classes: Sequence[str]) -> int:
    """One bit for each known simple selector that an element matches."""
    out, checks = _SHAPES.get((tag, *values)) or _shape(tag, list(values))
    for own, name, whole, value in checks:
        if values[name] == value if whole else value in values[name]:
            out |= own
    for c in classes:
        for own, needed, more, without, attributes in _BY_CLASS.get(c, ()):
            if needed and needed != tag:
                continue
            if more and not all(m in classes for m in more) or any(n in classes for n in without):
                continue
            for name, op, value in attributes:
                given = values.get(name)
                if given is None or op == "=" and given != value or op == "*=" and value not in given:
                    break
            else:
                out |= own
    return out
