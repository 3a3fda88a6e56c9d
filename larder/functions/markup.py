"""A streaming HTML parser that never raises, and open elements with cheap look-ups."""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class TotalParser(HTMLParser):
    """The standard library's parser, which reads any text to its end in one feed.

    Markup that the page's end cuts off (a tag, comment or declaration without its end) is
    dropped, as in browsers; the standard library tries each ``<`` in it anew. A marked
    section (``<![x[``) is a bogus comment up to the next ``>``, where the standard library
    raises. A start tag it cannot take apart has no attributes.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def parse_marked_section(self, i, report=1):
        return self.rawdata.find(">", i + 3) + 1 or len(self.rawdata)

    def parse_html_declaration(self, i):
        end = super().parse_html_declaration(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_comment(self, i, report=1):
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def parse_pi(self, i):
        end = super().parse_pi(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_endtag(self, i):
        end = super().parse_endtag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_starttag(self, i):
        end = super().parse_starttag(i)
        if end >= 0:
            return end
        end = self.rawdata.find(">", i + 1) + 1
        if end:
            self.handle_starttag(re.match(r"[a-zA-Z][^\t\n\r\f />]*", self.rawdata[i + 1 : end])[0].lower(), [])
        return end or len(self.rawdata)

    def read(self, html: str | None) -> None:
        """Feed a whole page and close it."""
        self.feed(html or "")
        self.close()


class Open:
    """Names of open elements by depth; the nearest one of a name is found without a walk."""

    def __init__(self):
        self.names: list[str | None] = []
        self.at: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def last(self, name: str) -> int:
        """Depth of the innermost element of a name, -1 if none is open."""
        found = self.at.get(name)
        return found[-1] if found else -1

    def first_after(self, name: str, depth: int) -> int | None:
        """The outermost element of a name that lies deeper than depth."""
        found = self.at.get(name, [])
        k = bisect_right(found, depth)
        return found[k] if k < len(found) else None

    def pop(self) -> None:
        name = self.names.pop()
        if name is not None:
            self.at[name].pop()

    def blank(self, name: str) -> int:
        """Close the innermost element of a name and leave those within it open."""
        depth = self.at[name].pop()
        self.names[depth] = None
        return depth
