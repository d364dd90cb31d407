import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalar, text


@pytest.mark.parametrize(
    "html, clean",
    [
        (None, ""),
        ("plain", "plain"),
        ("<p>a <b>b</b></p>", "<p>a <b>b</b></p>"),
        ("<script>alert(1)</script>x", "x"),
        ("<SCRIPT >a</script\n>x", "x"),
        ("<style>p{}", ""),
        ("a<!-- c -->b", "ab"),
        ("a<!-- c", "a"),
        ("1 < 2", "1 &lt; 2"),
        ("<u>x</u>", "x"),
        ("<h1>t</h1>", "t"),
        ('<a href="javascript:alert(1)">x</a>', "<a>x</a>"),
        ('<a href="&#x6A;avascript:alert(1)">x</a>', "<a>x</a>"),
        ('<a href="java\nscript:x">x</a>', "<a>x</a>"),
        ('<a href="//evil.example">x</a>', "<a>x</a>"),
        ('<a href="/ok" onclick="x()">x</a>', '<a href="/ok">x</a>'),
        ('<a href="https://a.example/?a=1&b=2" title=\'t"\'>x</a>', '<a href="https://a.example/?a=1&amp;b=2" title="t&quot;">x</a>'),
        ('<p style="text-align: RIGHT; color: red">x</p>', '<p style="text-align: right">x</p>'),
        ('<p style="background: url(x)" data-x="1" class="c">x</p>', '<p class="c">x</p>'),
        ("<br/>", "<br />"),
        ("<p", "<p>"),
        ("</p>", "</p>"),
    ],
)
def test_sanitize(html, clean):
    assert text.sanitize(html) == clean


def test_sanitize_is_idempotent():
    for html in ("<p>a &amp; <b class='x'>b</b><script>x</script>", "<ul><li>1<li>2</ul>", "<div><p>x</p></div>"):
        once = text.sanitize(html)
        assert text.sanitize(once) == once


def test_every_reference_is_a_text(spark):
    """From none to beyond the last character, surrogates too: workers can hand over what comes out."""
    numbers = [0, 1, 38, 0xD7FF, 0xD800, 0xDBFF, 0xDC00, 0xDFFF, 0xE000, 0xFFFF, 0x10000, 0x10FFFE, 0x10FFFF, 0x110000, 10**12]
    for n in numbers:
        want = "" if not 0 < n < 0x10FFFF else "\ufffd" if 0xD800 <= n < 0xE000 else chr(n)
        assert text.decode_entities(f"a&#{n};b&#x{n:X};") == f"a{want}b{want}"
    d = spark.createDataFrame([(f'<a href="/p?&#x{n:x};&#{n};" title="&#{n};">x</a>',) for n in numbers], "h string")
    assert d.select(text.sanitize_html("h").alias("s")).filter("s LIKE '<a%>x</a>'").count() == len(numbers)
    for n in range(0, 0x110001, 257):
        text.decode_entities(f"&#{n};&#x{n:x};").encode()


def test_render():
    def t(s, *marks):
        return {"type": "text", "text": s, "marks": [{"type": m} for m in marks]}

    doc = {"content": [{"type": "paragraph", "attrs": {"align": "right"}, "content": [t("a<b", "bold", "italic")]}, {"type": "horizontal_rule"}, {"type": "heading", "attrs": {"level": 2}, "content": [t("h")]}]}
    assert text.render(json.dumps(doc)) == '<p style="text-align: end"><em><strong>a&lt;b</strong></em></p><hr><h2>h</h2>'
    assert text.render(None) == text.render("no json") == text.render("{}") == ""


def test_normalize_is_idempotent(spark):
    html = "<div><u>a</u> <S class=x>b</S><h3>c</h3><code>d</code><pre>e</pre><strike>f</strike></div>"
    d = spark.createDataFrame([(html,)], "h string").select(text.normalize_html(F.col("h")).alias("a"))
    r = d.select("a", text.normalize_html(F.col("a")).alias("b")).first()
    assert r.a == r.b and "<u>" not in r.a and "<h3>" not in r.a


def double_fnv(s, seed):
    h = seed
    units = s.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h ^= units[i] << 8 | units[i + 1]
        h = int(float(h - (1 << 32) if h >= 1 << 31 else h) * 16777619.0) % (1 << 32)
    return h


def test_fnv(spark):
    words = ["", "a", "sel:abc:1:2:3:4", "é日本😀", "x" * 300]
    got = spark.createDataFrame([(w,) for w in words], "s string").select(scalar.fnv1a(F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == ["".join(f"{double_fnv(w, seed):08x}" for seed in scalar.FNV_SEEDS) for w in words]


def test_scalars(spark):
    d = spark.range(1).select(
        scalar.round_half_up(F.lit(-2.5)).alias("r"),
        scalar.utf16_length(F.lit("😀")).alias("n"),
        scalar.identity_of(F.array().cast("array<string>")).alias("none"),
        scalar.mask_ip(F.lit("")).alias("ip0"),
        scalar.mask_ip(F.lit("1:2:3:4:5:6:7:8")).alias("ip6"),
        scalar.server_room_name(F.lit("***")).alias("room"),
        scalar.valid_rectangle(F.lit(0.0), F.lit(0.0), F.lit(float("nan")), F.lit(1.0)).alias("v"),
        scalar.author_color(F.lit("alice")).alias("c"),
    ).first()
    assert (d.r, d.n, d.none, d.ip0, d.ip6, d.room, d.v) == (-2, 2, None, "?", "1:2:3:4::x", "default", False)
    assert d.c in scalar.PALETTE
