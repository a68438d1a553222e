"""HTML stripping by document structure, for where the regular-expression form is too coarse.

Python through Arrow batches; ``text.strip_html`` is the form that stays in the JVM.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Pages that Python holds at a time.
ONCE = 100
DROPPED = frozenset({"script", "style", "nav", "footer", "header"})


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            del self.inside[self.inside.index(tag) :]

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)


def visible_text(page: str | None) -> str:
    """Text nodes outside of scripts, styles, menus, headers and footers, joined by line feeds."""
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    return "\n".join(parser.parts)


def strip_html_dom(page: Column) -> Column:
    @F.arrow_udf(StringType())
    def convert(pages: pa.Array) -> pa.Array:
        return stripped(pages)

    return convert(page)


def stripped(pages: pa.Array) -> pa.Array:
    """Visible text of all pages; Python holds ``ONCE`` of a batch's pages at a time, the rest stays in Arrow."""
    parts = [pa.array([visible_text(x) for x in pages[i : i + ONCE].to_pylist()], pa.string()) for i in range(0, len(pages), ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())
