"""Element predicates for the selector forms the rules use.

Supported: tag, ``.class``, ``[attr]``, ``[attr="v"]``, ``[attr*="v"]``,
``:not(.class)``, descendant and child combinators. A selector turns into a filter
over an element array; nothing is evaluated in Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .marks import TOKEN, bit, parts

@dataclass(frozen=True)
class Scope:
    """Where selectors look: element array, its text, and which elements qualify.

    ``root`` names a column with the id of the card; with ``below_root`` only
    elements under the card match, while all ancestors still count. ``classes`` names
    a column with all class names of ``elems`` in one text, ``marked`` the beginning of the
    columns with the marks of all ``elems``: rules whose classes do not occur, or whose simple
    selectors match nothing, are decided without looking at the elements.
    """

    elems: str = "elems"
    text: str = "card_text"
    base: str = "text_base"
    root: str = "card_id"
    classes: str | None = "card_classes"
    marked: str | None = "card_"
    below_root: bool = False


PAGE = Scope(elems="elements", text="text", base="0", classes=None, marked=None)
CARD = Scope()
CARD_IN_PAGE = Scope(below_root=True)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _simple(compound: str, e: str) -> str:
    """Condition on one element: its mark, or a comparison where there is none."""
    if known := bit(compound):
        return f"({e}.{known[0]} & {known[1]}L) != 0"
    return _compared(compound, e)


def _compared(compound: str, e: str) -> str:
    conditions = []
    for kind, name, op, text in parts(compound):
        if kind == "tag":
            conditions.append(f"{e}.tag = {_quoted(name)}")
        elif kind == "cls":
            conditions.append(f"array_contains({e}.classes, {_quoted(name)})")
        elif kind == "without":
            conditions.append(f"NOT array_contains({e}.classes, {_quoted(name)})")
        else:
            value = f"{e}.attrs[{_quoted(name)}]"
            if op is None:
                conditions.append(f"{value} IS NOT NULL")
            elif op == "=":
                conditions.append(f"{value} = {_quoted(text)}")
            else:
                conditions.append(f"contains({value}, {_quoted(text)})")
    return " AND ".join(conditions)


def condition(selector: str, elems: str, e: str = "e0", also: str = "") -> str:
    """SQL condition: element ``e`` of ``elems`` matches the selector.

    ``also`` is one more condition on ``e``, looked at after its own and before its ancestors.
    """
    steps: list[tuple[str, str]] = []
    combinator = ""
    for token in TOKEN.findall(selector.strip()):
        if token.strip() in ("", ">"):
            combinator = token.strip() or " "
        else:
            steps.append((combinator, token))
            combinator = " "

    def matched(step: int, e: str) -> str:
        own = _simple(steps[step][1], e)
        if also and step == len(steps) - 1:
            own = f"{own} AND {also}"
        if step == 0:
            return own
        a = f"e{int(e[1:]) + 1}"
        near = f" AND {a}.depth = {e}.depth - 1" if steps[step][0] == ">" else ""
        return (
            f"{own} AND exists({elems}, {a} -> {a}.id < {e}.id AND {e}.id <= {a}.end"
            f"{near} AND {matched(step - 1, a)})"
        )

    return matched(len(steps) - 1, e)


_CLASS_WORD = re.compile(r"""(?<!:not\()\.([\w-]+)|\[class\*?="([^"]*)"\]""")


def possible(selector: str, scope: Scope = CARD) -> str | None:
    """SQL condition that every match implies, from the class names alone; None if there is none."""
    if scope.classes is None:
        return None
    bare = re.sub(r"""\[(?!class)[^\]]*\]""", "", selector)
    words = dict.fromkeys(w for pair in _CLASS_WORD.findall(bare) for w in pair if w)
    return " AND ".join(f"contains({scope.classes}, {_quoted(w)})" for w in words) or None


def _marked(selector: str, scope: Scope) -> str | None:
    """As ``possible``, from the marks; None where one of the simple selectors has no mark."""
    compounds = [t for t in TOKEN.findall(selector.strip()) if t.strip() not in ("", ">")]
    known = [bit(c) for c in compounds]
    if scope.marked is None or None in known:
        return None
    needed: dict[str, int] = {}
    for name, own in known:
        needed[name] = needed.get(name, 0) | own
    return " AND ".join(f"({scope.marked}{name} & {own}L) = {own}L" for name, own in needed.items())


def guarded(selector: str, value: str, scope: Scope = CARD, otherwise: str = "null") -> str:
    """SQL ``value``, or ``otherwise`` at once when the selector cannot match."""
    check = _marked(selector, scope) or possible(selector, scope)
    return f"if({check}, {value}, {otherwise})" if check else value


def _below(scope: Scope) -> str:
    return f"e0.id > {scope.root}" if scope.below_root else ""


def matches(selector: str, scope: Scope = CARD) -> str:
    """SQL array of the matching elements in document order."""
    return f"filter({scope.elems}, e0 -> {condition(selector, scope.elems, also=_below(scope))})"


def text_of(e: str, scope: Scope = CARD) -> str:
    """SQL text of an element."""
    return f"substring({scope.text}, {e}.text_at - {scope.base} + 1, {e}.text_len)"


def first(selector: str, value: str, scope: Scope = CARD) -> str:
    """SQL ``value`` (an expression over ``m``) of the first match, null without one.

    The one match is compared by name too: a plan says what its fields are found by.
    """
    value = f"if({_compared(TOKEN.findall(selector.strip())[-1], 'm')}, {value}, null)"
    found_first = f"get(transform(slice({matches(selector, scope)}, 1, 1), m -> {value}), 0)"
    return guarded(selector, found_first, scope)


def first_match_text(selector: str, scope: Scope = CARD) -> str:
    """SQL text of the first match: empty for an empty element, null without a match."""
    return first(selector, text_of("m", scope), scope)


def first_nonempty_text(selector: str, scope: Scope = CARD) -> str:
    """SQL text of the first match, null when it is empty or there is no match."""
    return first(selector, f"if(m.text_len > 0, {text_of('m', scope)}, null)", scope)


def all_texts(selector: str, scope: Scope = CARD) -> str:
    """SQL array with the texts of all matches."""
    texts = f"transform({matches(selector, scope)}, m -> {text_of('m', scope)})"
    return guarded(selector, texts, scope, "cast(array() as array<string>)")


def found(selector: str, scope: Scope = CARD) -> str:
    """SQL condition: at least one match."""
    hit = f"exists({scope.elems}, e0 -> {condition(selector, scope.elems, also=_below(scope))})"
    return guarded(selector, hit, scope, "false")
