"""HTML text functions: native expressions where regular ones do, pandas UDFs for the two parsers."""

from __future__ import annotations

import json
import re
import sys
from string import hexdigits
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values
SAFE_TAGS = {"p", "br", "em", "i", "strong", "b", "a", "ul", "ol", "li", "blockquote", "hr", "sup", "sub", "span"}
DROPPED_TAGS = {
    "script", "style", "iframe", "object", "embed", "form", "input", "textarea", "select", "button", "link", "meta", "base", "applet", "math", "svg", "template", "noscript", "xmp", "listing", "plaintext",
    "noembed", "noframes",
}
LINK_ATTRIBUTES, COMMON_ATTRIBUTES = frozenset({"href", "title"}), frozenset({"class", "style"})
SAFE_STYLES = {
    "text-decoration": frozenset({"underline", "overline", "line-through", "none"}),
    "text-align": frozenset({"left", "right", "center", "justify", "end", "start"}),
}
SAFE_SCHEMES = frozenset({"http", "https", "mailto"})
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
UNDERLINE, LINE_THROUGH = '<span style="text-decoration: underline">', '<span style="text-decoration: line-through">'
REWRITES = (
    ("u", UNDERLINE, "</span>"),
    ("s", LINE_THROUGH, "</span>"),
    ("strike", LINE_THROUGH, "</span>"),
    *((f"h{n}", "<p><strong>", "</strong></p>") for n in range(1, 7)),
    ("code", "", ""),
    ("pre", "<p>", "</p>"),
    ("div", "<p>", "</p>"),
)
#: The word that opens the markers of synchronised notes.
MARK = "overlay"


def escape_html(s: Column) -> Column:
    for plain, escaped in ESCAPES:
        s = F.replace(s, F.lit(plain), F.lit(escaped))
    return s


def strip_tags(s: Column) -> Column:
    return F.regexp_replace(s, "<[^>]*>", "")


def normalize_html(s: Column) -> Column:
    """Wrappers that the note editor does not know become those that it does, in a fixed order."""
    for tag, before, after in REWRITES:
        s = F.regexp_replace(s, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", before + "$1" + after)
    return s


def strike_through(s: Column) -> Column:
    s = F.regexp_replace(s, "(?i)(<(?:p|li|h[1-6])>)", "$1" + LINE_THROUGH)
    return F.regexp_replace(s, "(?i)(</(?:p|li|h[1-6])>)", "</span>$1")


def footer(key: Column, author: Column) -> Column:
    return F.concat(F.lit(f"<p><sub>[{MARK}:"), escape_html(key), F.lit(" from "), author, F.lit(" — safe to delete, do not edit]</sub></p>"))


def footer_key(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, rf"\[{MARK}:([\w:-]+)\s", 1), F.lit(""))


def without_footer(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, rf"<p><sub>\[{MARK}:[^\]]*\]</sub></p>\s*$", ""))


def _marks(word: str) -> dict[str, tuple[str, ...]]:
    """The forms that markers have had in a note's text and in its HTML, as patterns at its begin or end."""
    # fixed values
    return {
        "text": (rf"^{word}:\s*[^\n]*\n?", rf"^\[(?:{word}:)?[^\]]{{1,80}}\]\s*", rf"\n?\[{word}:[^\]]*\]\s*$"),
        "html": (rf"^<blockquote><p><em>{word}:[^<]*</em></p></blockquote>", r"^<p><strong>\[[^\]]*\]</strong></p>", rf"<p><sub>\[{word}:[^\]]*\]</sub></p>\s*$"),
    }


def without_marks(note: Column, form: str) -> Column:
    """A note's ``text`` or ``html`` without the markers of older and newer forms."""
    for pattern in _marks(MARK)[form]:
        note = F.regexp_replace(note, pattern, "")
    return F.trim(note)


def without_text_marks(text: Column) -> Column:
    return without_marks(text, "text")


def is_synchronised(text: Column, html: Column) -> Column:
    """Whether a note carries one of our markers, of newer or older form, so that it is an echo."""
    marks = [html.contains(f"[{MARK}:"), text.contains(f"[{MARK}:"), html.contains(f"<blockquote><p><em>{MARK}:"), html.contains(f"<p><strong>[{MARK}:")]
    found = [F.coalesce(m, F.lit(False)) for m in marks]
    return found[0] | found[1] | found[2] | found[3]


#: No character has a number of more digits, leading zeros aside.
DIGITS = 7
SURROGATES = range(0xD800, 0xE000)


def _referred(name: str) -> str | None:
    """What stands between ``&`` and ``;`` as a character; '' for a number out of range, U+FFFD for half of a surrogate
    pair, which no text can hold, None if it is none."""
    if name in ENTITIES:
        return ENTITIES[name]
    base = 16 if name[:2] == "#x" else 10
    digits = name[2:] if base == 16 else name[1:]
    if name[:1] != "#" or not digits or not set(digits) <= set(hexdigits if base == 16 else "0123456789"):
        return None
    digits = digits.lstrip("0")
    number = int(digits, base) if 0 < len(digits) <= DIGITS else 0
    if number in SURROGATES:
        return "\ufffd"
    return chr(number) if 0 < number < sys.maxunicode else ""


def decode_entities(s: str) -> str:
    """References of one pass; code points out of range vanish."""
    first, *rest = s.split("&")
    out = [first]
    for part in rest:
        name, end, after = part.partition(";")
        found = _referred(name) if end else None
        out.append("&" + part if found is None else found + after)
    return "".join(out)


def _attribute(s: str) -> str:
    for plain, escaped in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#x27;"), ("<", "&lt;"), (">", "&gt;")):
        s = s.replace(plain, escaped)
    return s


def safe_style(style: str) -> str:
    pairs = (part.split(":", 1) for part in style.split(";") if ":" in part)
    named = ((name.strip().lower(), value.strip().lower()) for name, value in pairs)
    return "; ".join(f"{name}: {value}" for name, value in named if value in SAFE_STYLES.get(name, ()))


def safe_url(url: str) -> str:
    """The URL without white space and control characters, if it is relative to the page's host or of a safe scheme,
    else ''. What looks like a scheme is one."""
    plain = "".join(c for c in url if c > " " and c != "\x7f" and not c.isspace())
    scheme, colon, _ = re.split("[/?#]", plain, maxsplit=1)[0].partition(":")
    if colon and re.fullmatch(r"[a-zA-Z][a-zA-Z0-9+.-]*", scheme):
        return plain if scheme.lower() in SAFE_SCHEMES and _parses(plain) else ""
    return "" if plain.startswith("//") else plain


def _parses(url: str) -> bool:
    try:
        urlsplit(url)
    except ValueError:
        return False
    return True


_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z0-9_:-]+)\s*(?:=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")


class _Cursor:
    """Where the sanitiser is in its input; each ``take_*`` moves past what it returns."""

    def __init__(self, html: str):
        self.html, self.at = html, 0

    def take_text(self) -> str:
        stop = self.html.find("<", self.at)
        stop = len(self.html) if stop < 0 else stop
        text, self.at = self.html[self.at : stop], stop
        return text

    def skip_past(self, what: str, start: int) -> None:
        found = self.html.find(what, start)
        self.at = len(self.html) if found < 0 else found + len(what)

    def take_attributes(self, start: int) -> tuple[list[tuple[str, str]], bool]:
        """(name, value) pairs up to the end of a tag, and whether it closes itself."""
        found, at, html = [], start, self.html
        while at < len(html) and html[at] != ">" and not html.startswith("/>", at):
            m = _ATTRIBUTE.match(html, at)
            if m:
                found.append((m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")))
            at = m.end() if m and m.end() > at else at + 1
        closes = html.startswith("/", at)
        self.skip_past(">", at)
        return found, closes


def _kept(name: str, attributes: list[tuple[str, str]]) -> str:
    allowed = COMMON_ATTRIBUTES | (LINK_ATTRIBUTES if name == "a" else frozenset())
    out = []
    for key, raw in attributes:
        if key not in allowed:
            continue
        value = decode_entities(raw)
        if key in ("href", "style"):
            value = safe_url(value) if key == "href" else safe_style(value)
            if not value:
                continue
        out.append(f' {key}="{_attribute(value)}"')
    return "".join(out)


def sanitize(html: str | None) -> str:
    """Only safe tags and attributes stay; of dangerous elements nothing does, of other tags their text.

    An unclosed dangerous element takes the rest with it; a '<' that opens no tag is escaped.
    """
    if not html:
        return ""
    cursor, out = _Cursor(html), []
    while True:
        out.append(cursor.take_text())
        if cursor.at >= len(html):
            return "".join(out)
        if html.startswith("<!--", cursor.at):
            cursor.skip_past("-->", cursor.at + 4)
            continue
        m = _NAME.match(html, cursor.at + 1)
        if not m or len(m[1]) > 32:
            out.append("&lt;")
            cursor.at += 1
            continue
        name = m[1].lower()
        if m[0][0] == "/":
            cursor.skip_past(">", m.end())
            out.append(f"</{name}>" if name in SAFE_TAGS else "")
            continue
        attributes, closes = cursor.take_attributes(m.end())
        if name in DROPPED_TAGS:
            end = re.compile(rf"</{name}[>\s]", re.I).search(html, cursor.at)
            cursor.skip_past(">", end.start() if end else len(html))
        elif name in SAFE_TAGS:
            out.append(f"<{name}{_kept(name, attributes)}{' /' if closes else ''}>")


@F.pandas_udf(StringType())
def sanitize_html(html: pd.Series) -> pd.Series:
    return html.map(sanitize, na_action=None)


# fixed values: elements of rich-text nodes and marks
_NODES = {
    "blockquote": ("<blockquote>", "</blockquote>"),
    "ordered_list": ("<ol>", "</ol>"),
    "bullet_list": ("<ul>", "</ul>"),
    "list_item": ("<li>", "</li>"),
    "code_block": ("<pre><code>", "</code></pre>"),
}
_LEAVES = {"horizontal_rule": "<hr>", "hard_break": '<span class="line-break"><br></span>'}
_MARKS = {
    "bold": ("<strong>", "</strong>"),
    "strong": ("<strong>", "</strong>"),
    "italic": ("<em>", "</em>"),
    "em": ("<em>", "</em>"),
    "superscript": ("<sup>", "</sup>"),
    "sup": ("<sup>", "</sup>"),
    "subscript": ("<sub>", "</sub>"),
    "sub": ("<sub>", "</sub>"),
    "strikethrough": (LINE_THROUGH, "</span>"),
    "underline": (UNDERLINE, "</span>"),
    "overline": ('<span style="text-decoration: overline">', "</span>"),
}


def _escape(s: str) -> str:
    for plain, escaped in ESCAPES:
        s = s.replace(plain, escaped)
    return s


def _render(node: dict) -> str:
    kind, attributes = node.get("type") or "", node.get("attrs") or {}
    if kind == "text":
        out = _escape(node.get("text") or "")
        for mark in node.get("marks") or []:
            if mark.get("type") == "link":
                out = f'<a href="{_escape(str((mark.get("attrs") or {}).get("href") or ""))}">{out}</a>'
            elif mark.get("type") in _MARKS:
                out = _MARKS[mark["type"]][0] + out + _MARKS[mark["type"]][1]
        return out
    if kind in _LEAVES:
        return _LEAVES[kind]
    inner = "".join(_render(child) for child in node.get("content") or [] if child)
    if kind == "paragraph":
        align = attributes.get("align")
        style = f' style="text-align: {"end" if align == "right" else align}"' if align and align != "left" else ""
        return f"<p{style}>{inner}</p>"
    if kind == "heading":
        return f"<h{attributes.get('level') or 1}>{inner}</h{attributes.get('level') or 1}>"
    before, after = _NODES.get(kind, ("", ""))
    return before + inner + after


def render(document: str | None) -> str:
    """A rich-text document (JSON) as HTML; '' for null, no JSON, or no content."""
    try:
        doc = json.loads(document) if document else None
    except ValueError:
        return ""
    return "".join(_render(n) for n in (doc or {}).get("content") or [] if n) if isinstance(doc, dict) else ""


@F.pandas_udf(StringType())
def render_note(document: pd.Series) -> pd.Series:
    return document.map(render, na_action=None)
