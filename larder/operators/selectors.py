"""CSS selectors as bit sets over the stack of open elements: any number of them in one pass."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from larder.functions.markup import VOID, Open, TotalParser

SIMPLE = re.compile(r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<name>[\w-]+)|\[\s*(?P<attribute>[\w:-]+)\s*(?:(?P<how>[~|^$*]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s\]'"]+))\s*)?\]""")
BETWEEN = re.compile(r"\s*([>,])\s*|\s+(?=\S)")
HOLDS = {
    "": lambda value, wanted: True,
    "=": lambda value, wanted: value == wanted,
    "~=": lambda value, wanted: wanted in value.split(),
    "|=": lambda value, wanted: value == wanted or value.startswith(wanted + "-"),
    "^=": lambda value, wanted: wanted != "" and value.startswith(wanted),
    "$=": lambda value, wanted: wanted != "" and value.endswith(wanted),
    "*=": lambda value, wanted: wanted != "" and wanted in value,
}
#: Elements that end an open paragraph, and those beyond which they do not.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
P_SCOPE = ("button", "table", "td", "th", "caption", "object", "template")
#: Elements that end open ones of these names, unless one of the last tuple is open in between.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",))}
#: Kinds of elements whose compounds are remembered.
REMEMBERED = 4096


class Selectors:
    """Selector lists with tags, ids, classes, attributes, descendants and children.

    Every compound of every selector is a bit, to the left of the compound before it. An
    element's bits are those compounds that fit it and may follow what its parent (child) or
    any ancestor (descendant) has met, so an element costs a few operations on integers
    whatever the depth. Anything else of CSS is refused.
    """

    def __init__(self, lists: Sequence[str]):
        self.lists = tuple(lists)
        self.first = self.child = self.below = 0
        self.compounds: list[tuple[str, tuple[tuple[str, str, str], ...]]] = []
        self.ends: dict[int, list[int]] = {}
        for number, text in enumerate(self.lists):
            self._add(text.strip(), number)
        self.names = sorted({name for _, tests in self.compounds for name, _, _ in tests})
        self.any_end = sum(1 << bit for bit in self.ends)
        self.known: dict[tuple, int] = {}

    def _add(self, text: str, number: int) -> None:
        at, how = 0, "first"
        while True:
            tag, tests, start = "*", [], at
            while m := SIMPLE.match(text, at):
                if m["tag"] and at > start:
                    break
                tag = (m["tag"] or tag).lower()
                if m["id"]:
                    tests.append(("id", "=", m["id"]))
                elif m["name"]:
                    tests.append(("class", "~=", m["name"]))
                elif m["attribute"]:
                    tests.append((m["attribute"].lower(), m["how"] or "", m["a"] or m["b"] or m["c"] or ""))
                at = m.end()
            if at == start:
                raise ValueError(f"selector {text!r} is not understood at {at}")
            bit = len(self.compounds)
            self.compounds.append((tag, tuple(tests)))
            setattr(self, how, getattr(self, how) | 1 << bit)
            m = BETWEEN.match(text, at)
            if m is None or m[1] == ",":
                self.ends.setdefault(bit, []).append(number)
            if m is None:
                if at < len(text):
                    raise ValueError(f"selector {text!r} is not understood at {at}")
                return
            at, how = m.end(), {">": "child", ",": "first", None: "below"}[m[1]]

    def _fitting(self, tag: str, attributes: dict[str, str]) -> int:
        key = (tag, *(attributes.get(n) for n in self.names))
        found = self.known.get(key)
        if found is None:
            fits = lambda test: test[0] in attributes and HOLDS[test[1]](attributes[test[0]], test[2])
            found = sum(1 << bit for bit, (name, tests) in enumerate(self.compounds) if name in ("*", tag) and all(map(fits, tests)))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = found
        return found

    def enter(self, state: tuple[int, int], tag: str, attributes: dict[str, str]) -> tuple[tuple[int, int], list[int]]:
        """The state of an element within one of the given state, and the lists it meets."""
        parent, above = state
        here = self._fitting(tag, attributes) & (self.first | parent << 1 & self.child | above << 1 & self.below)
        met = here & self.any_end
        return (here, above | here), sorted({n for bit, lists in self.ends.items() if met >> bit & 1 for n in lists}) if met else []


class Picker(TotalParser):
    """One pass over a page that picks the text of every element a selector list meets.

    The text of an element is a run of the page's data. Elements nest as browsers nest them
    in the usual cases: block elements end an open paragraph, list items and cells those
    before them; formatting elements are not opened anew after that.
    """

    def __init__(self, selectors: Selectors):
        super().__init__()
        self.selectors = selectors
        self.open = Open()
        self.states: list[tuple[int, int]] = [(0, 0)]
        self.runs: list[list[list[int]]] = []
        self.picked: list[list[list[int]]] = [[] for _ in selectors.lists]
        self.data: list[str] = []
        self.length = 0

    def met(self, lists: list[int], tag: str, attributes: dict[str, str]) -> None:
        """Hook for an element that meets selector lists."""

    def handle_starttag(self, tag, attrs):
        self.element(tag, {k: x or "" for k, x in reversed(attrs)})

    def element(self, tag: str, attributes: dict[str, str]) -> None:
        depth = -1
        if tag in ENDS_P and (p := self.open.last("p")) > max(map(self.open.last, P_SCOPE)):
            depth = p
        elif tag in ENDS:
            ended, scope = ENDS[tag]
            depth = max(map(self.open.last, ended))
            depth = depth if depth > max(map(self.open.last, scope)) else -1
        elif tag == "a" and self.open.names and self.open.names[-1] == "a":
            depth = len(self.open.names) - 1
        if depth >= 0:
            self._close(depth)
        state, lists = self.selectors.enter(self.states[-1], tag, attributes)
        runs = [[self.length, self.length] for _ in lists]
        for n, run in zip(lists, runs, strict=True):
            self.picked[n].append(run)
        if lists:
            self.met(lists, tag, attributes)
        if tag in VOID:
            return
        self.open.push(tag)
        self.states.append(state)
        self.runs.append(runs)

    def _close(self, depth: int) -> None:
        while len(self.open.names) > depth:
            self.open.pop()
            self.states.pop()
            for run in self.runs.pop():
                run[1] = self.length

    def handle_endtag(self, tag):
        depth = self.open.last(tag)
        if depth >= 0:
            self._close(depth)

    def handle_data(self, data):
        self.data.append(data)
        self.length += len(data)

    def close(self):
        rest = self.rawdata if self.cdata_elem else ""  # a script that the page's end closes
        super().close()
        if rest:
            self.handle_data(rest)

    def texts(self) -> list[list[str]]:
        """Texts of all elements met, by list, in page order."""
        self._close(0)
        whole = "".join(self.data)
        return [[whole[a:b] for a, b in runs] for runs in self.picked]


def pick(html: str | None, selectors: Selectors) -> list[list[str]]:
    p = Picker(selectors)
    p.read(html)
    return p.texts()


def extract_by_selectors(pages: DataFrame, lists: Sequence[str], html: str = "html", into: str = "texts") -> DataFrame:
    """Pages with a column of texts: for each selector list those of the elements it meets.

    Null or broken html is read as far as it goes; a page without hits has empty lists. A
    list that is not understood is refused before anything runs.
    """
    selectors = Selectors(lists)

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def picked(found: pd.Series) -> pd.Series:
        return pd.Series([pick(x, selectors) for x in found])

    return pages.withColumn(into, picked.asNondeterministic()(F.coalesce(F.col(html), F.lit(""))))
