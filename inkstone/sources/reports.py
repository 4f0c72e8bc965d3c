"""Reports as HTML: a small safe subset of Markdown, and a proof that no visible character was lost or added.

A page layout (PDF) takes the HTML from here; what it shows can be held against the same source text.
"""

import html
import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of a report, and the marks that format text within a line.
MOST_BYTES, MOST_PAGES = 5_000_000, 250
MARKS = re.compile(
    r"(?P<fence>`+)(?P<code>.+?)(?P=fence)|\[(?P<label>[^\]\n]+)\]\((?P<url>[^\s()]+(?:\([^\s()]*\)[^\s()]*)*)\)"
    r"|\*\*(?P<bold>[^*\n]+)\*\*|(?<!\*)\*(?P<italic>[^*\n]+)\*(?!\*)|\\(?P<literal>[\\`*{}\[\]()#+.!|>_-])"
)
_RULE = re.compile(r":?-{3,}:?")


def _safe(url: str) -> bool:
    try:
        return urlsplit(url).scheme in ("http", "https") and bool(urlsplit(url).netloc)
    except ValueError:
        return False


def _shown(text: str) -> str:
    """Escaped, with places to break long words at, which show nothing."""
    return html.escape(re.sub(r"\S{28,}", lambda m: "\u200b".join(re.findall(".{1,24}", m[0])), text), quote=True)


def _marked(m: re.Match[str]) -> str:
    if m["code"] is not None:
        return f"<code>{_shown(m['code'])}</code>"
    if m["label"] is not None:
        if not _safe(m["url"]):
            return _shown(m[0])
        beside = "" if m["label"] == m["url"] else f" ({_shown(m['url'])})"
        return f'<a href="{html.escape(m["url"], quote=True)}">{_shown(m["label"])}</a>{beside}'
    tag = "b" if m["bold"] is not None else "i" if m["italic"] is not None else None
    return f"<{tag}>{_shown(m['bold'] or m['italic'])}</{tag}>" if tag else _shown(m["literal"])


def inline(text: str) -> str:
    """A line's text with its marks as tags; addresses stay visible, and what is no sound mark is shown as it is."""
    ends = [0, *(m.end() for m in MARKS.finditer(text))]
    parts = [_shown(text[a : m.start()]) + _marked(m) for a, m in zip(ends, MARKS.finditer(text), strict=False)]
    return "".join(parts) + _shown(text[ends[-1] :])


def cells(line: str) -> list[str]:
    """Cells of a table's line; pipes that are escaped or within code part none."""
    line = re.sub(r"(?<!\\)\|$", "", re.sub(r"^\|", "", line.strip()))
    out, fence = [""], ""
    for piece in re.findall(r"\\.|`+|[^\\`|]+|\||\\$", line):
        if piece[0] == "`":
            fence = "" if piece == fence else fence or piece
        if piece == "|" and not fence:
            out.append("")
        else:
            out[-1] += piece
    return [x.strip() for x in out]


def blocks(lines: list[str]) -> list[str]:
    """Headings, rules, items, tables by labelled cells, code and paragraphs of Markdown lines, as HTML, in order."""
    out, held = [], []

    def put(*tags: str) -> None:
        if held:
            out.append(f"<p>{inline(' '.join(held))}</p>")
            held.clear()
        out.extend(tags)

    at = 0
    while at < len(lines):
        line = lines[at].strip()
        at += 1
        after = cells(lines[at]) if at < len(lines) else []
        if not line:
            put()
        elif fence := re.match(r"`{3,}|~{3,}", line):
            close = re.compile(re.escape(fence[0][0]) + "{" + str(len(fence[0])) + r",}\s*")
            put()
            while at < len(lines) and not close.fullmatch(lines[at].strip()):
                out.append(f'<p class="literal">{_shown(lines[at])}</p>')
                at += 1
            at += 1
        elif "|" in line and len(after) > 1 and all(map(_RULE.fullmatch, after)):
            heads, rows = cells(line), []
            at += 1
            while at < len(lines) and "|" in lines[at] and lines[at].strip():
                rows.append(lines[at])
                at += 1
            put(*([] if rows else [f"<p>{inline(line)}</p>"]))
            for row in rows:
                pairs = list(zip(heads, cells(row), strict=False)) if len(cells(row)) == len(heads) else []
                out.extend(f'<p class="cell{" row-start" * (not k)}"><b>{inline(h)}:</b> {inline(x)}</p>' for k, (h, x) in enumerate(pairs))
                out.extend([] if pairs else [f"<p>{inline(row)}</p>"])
        elif heading := re.match(r"(#{1,6})\s+(.+)$", line):
            put(f"<h{len(heading[1])}>{inline(heading[2])}</h{len(heading[1])}>")
        elif re.fullmatch(r"[-*_]{3,}", line):
            put("<hr>")
        elif re.match(r"(?:[-+*]|\d+[.)])\s+", line):
            put(f'<p class="item">{inline(line)}</p>')
        else:
            held.append(line)
    put()
    return out


def to_html(markdown: str) -> str:
    return "<html><body>" + "\n".join(blocks(markdown.splitlines())) + "</body></html>"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def visible(page: str) -> str:
    """The characters that an HTML text shows, in normal form, without white space and marks that show nothing."""
    parser = _Text()
    parser.feed(page)
    parser.close()
    return plain("".join(parser.parts))


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text) if not c.isspace() and c not in "\u200b\u00ad")


def rendered(reports: DataFrame, report: str = "report") -> DataFrame:
    """reports with html, visible_text and error: too large where a report is over the bound in bytes, null for null reports.
    The text of an HTML page or of a layout made from it must equal visible_text."""
    text = F.col(report)
    fits = F.coalesce(F.octet_length(text) <= MOST_BYTES, F.lit(False))

    @F.pandas_udf("html string, visible_text string")
    def page(texts: pd.Series) -> pd.DataFrame:
        pages = [None if x is None else to_html(x) for x in texts]
        return pd.DataFrame({"html": pages, "visible_text": [None if p is None else visible(p) for p in pages]})

    out = reports.withColumn("_p", page(F.when(fits, text))).select(*reports.columns, "_p.*")
    return out.withColumn("error", F.when(text.isNotNull() & ~fits, "too large"))


def same_text(shown: Column, visible_text: Column, pages: Column) -> Column:
    """The error of a laid-out report: its shown text differs from the HTML's, or it has too many pages; else null."""

    @F.pandas_udf("string")
    def bare(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else plain(x) for x in texts], dtype=object)

    return F.when(~bare(shown).eqNullSafe(visible_text), "text differs").when(pages > MOST_PAGES, "too many pages")
