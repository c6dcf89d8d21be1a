"""Card extraction from HTML pages: the one operator that runs in Python workers."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The parser travels with the task, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements that have no end tag.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

_STEP = re.compile(
    r"\s*(?P<next>\+)?\s*(?P<tag>[\w-]+|\*)?(?P<marks>(?:[.#][\w-]+)*)"
    r"(?P<attrs>(?:\[[\w-]+(?:\*?=(?:'[^']*'|\"[^\"]*\"|[^\]]*))?\])*)"
    r"(?P<has>(?::contains\((?:'[^']*'|\"[^\"]*\")\))*)"
)
_ATTR = re.compile(r"\[([\w-]+)(?:(\*?=)['\"]?([^\]'\"]*)['\"]?)?\]")
_HAS = re.compile(r":contains\(['\"]([^'\"]*)['\"]\)")
_ALTERNATIVES = re.compile(r",(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)")
_RESULT = re.compile(r"::(?:text|attr\(([\w-]+)\))$")


class _Element:
    """start and end: its text pieces; index and stop: itself and its inner elements."""

    __slots__ = (
        "tag", "attrs", "parent", "before", "own", "last_child", "start", "end", "index", "stop",
    )

    def __init__(self, tag, attrs, parent, start, index):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.start, self.index = start, index
        self.before = parent.last_child if parent else None
        self.own, self.last_child = [], None
        if parent:
            parent.last_child = self


class _Tree(HTMLParser):
    """Elements in document order; an element's text is a slice of all text pieces."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[_Element] = []
        self.texts: list[str] = []
        self.open: list[_Element] = []

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else None
        element = _Element(tag, dict(attrs), parent, len(self.texts), len(self.elements))
        self.elements.append(element)
        self.open.append(element)
        if tag in _VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return

    def _close(self, index):
        for element in self.open[index:]:
            element.end, element.stop = len(self.texts), len(self.elements)
        del self.open[index:]

    def handle_data(self, data):
        self.texts.append(data)
        if self.open:
            self.open[-1].own.append(data)

    def finish(self, html: str) -> _Tree:
        self.feed(html)
        self.close()
        self._close(0)
        return self


class _Step:
    """tag, .class, #id, [attribute], [attribute='x'], [attribute*='x'] and :contains('x')."""

    def __init__(self, found: re.Match):
        self.adjacent = bool(found["next"])
        self.tag = "" if found["tag"] in (None, "*") else found["tag"].lower()
        marks = re.findall(r"[.#][\w-]+", found["marks"])
        self.classes = {m[1:] for m in marks if m[0] == "."}
        self.ids = {m[1:] for m in marks if m[0] == "#"}
        self.attrs = _ATTR.findall(found["attrs"])
        self.has = _HAS.findall(found["has"])

    def fits(self, e: _Element) -> bool:
        if self.tag and self.tag != e.tag:
            return False
        if self.classes and not self.classes <= set((e.attrs.get("class") or "").split()):
            return False
        if self.ids and e.attrs.get("id") not in self.ids:
            return False
        for name, test, wanted in self.attrs:
            value = e.attrs.get(name)
            if name not in e.attrs or (test == "=" and value != wanted):
                return False
            if test == "*=" and wanted not in (value or ""):
                return False
        return not self.has or all(h in "".join(e.own) for h in self.has)


class _Selector:
    """One alternative: steps joined by 'inside' (a space) or 'right after' (+)."""

    def __init__(self, text: str):
        result = _RESULT.search(text)
        steps = text[: result.start()] if result else text
        self.steps = [_Step(m) for m in _STEP.finditer(steps) if m.group().strip()]
        plain = [name for name, test, _ in self.steps[-1].attrs if not test] if self.steps else []
        self.attribute = result[1] if result else (plain[0] if plain else None)

    def fits(self, e: _Element, i: int = -1) -> bool:
        step = self.steps[i]
        if not step.fits(e):
            return False
        if -i == len(self.steps):
            return True
        if step.adjacent:
            return e.before is not None and self.fits(e.before, i - 1)
        above = e.parent
        while above is not None:
            if self.fits(above, i - 1):
                return True
            above = above.parent
        return False


def _selectors(text: str) -> list[_Selector]:
    return [_Selector(part.strip()) for part in _ALTERNATIVES.split(text)]


def cards_of(html: str | None, card: str, fields: Mapping[str, str]) -> list[dict]:
    """The fields of every card element, each from its first match in the card."""
    tree = _Tree().finish(html or "")
    cards, wanted = _selectors(card), {n: _selectors(s) for n, s in fields.items()}
    found = []
    for top in tree.elements:
        if not any(s.fits(top) for s in cards):
            continue
        record: dict = {}
        for e in tree.elements[top.index : top.stop]:
            for name, alternatives in wanted.items():
                hit = next((s for s in alternatives if s.fits(e)), None) if name not in record else None
                if hit is not None:
                    text = "".join(tree.texts[e.start : e.end])
                    record[name] = e.attrs.get(hit.attribute) if hit.attribute else text
        found.append(record)
    return found


def extract_cards(
    pages: DataFrame,
    card: str,
    fields: Mapping[str, str],
    html: str = "html",
    keep: Sequence[str] = ("page_id", "url"),
) -> DataFrame:
    """One row per card of every page: (keep..., card_no, fields...).

    A selector is a list of alternatives separated by commas; see _Step for
    what a step may hold. A field gives the trimmed text of its element, or an
    attribute for ::attr(name) and for a last step with a bare [name]. A field
    without a match is NULL. Pages stay in the partition they are read in.
    """
    names = list(fields)
    kept = pages.select(*keep, html)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != html]
        + ["card_no int"]
        + [f"`{n}` string" for n in names]
    )
    specs = dict(fields)
    columns = [*keep, "card_no", *names]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *kept_values, source in batch[[*keep, html]].itertuples(index=False):
                for i, record in enumerate(cards_of(source, card, specs), 1):
                    values = [record.get(n) for n in names]
                    rows.append([*kept_values, i, *[v if v is None else v.strip() for v in values]])
            yield pd.DataFrame(rows, columns=columns)

    return kept.mapInPandas(extract, schema)
