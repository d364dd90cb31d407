"""Scalar expressions that keep the value semantics of a double-precision, UTF-16 host."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# fixed values
FNV_SEEDS = (0x811C9DC5, 0x01000193, 0x27D4EB2D)
FNV_PRIME = 16777619.0
PALETTE = (
    "#e6194b", "#3cb44b", "#4363d8", "#f58231", "#911eb4",
    "#42d4f4", "#f032e6", "#bfef45", "#fabed4", "#469990",
    "#dcbeff", "#9A6324", "#800000", "#aaffc3", "#808000",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_else(a: Column, b: Column) -> Column:
    """``a`` unless it is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def utf16_units(s: Column) -> Column:
    """The UTF-16 units of a string as an array of longs; none of null. One pass over the digits, so long texts take linear time."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(F.coalesce(s, F.lit("")), "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda unit: F.conv(unit, 16, 10).cast("long"))


def _lane(units: Column, seed: int) -> Column:
    signed = lambda x: F.when(x >= 2147483648, x - 4294967296).otherwise(x)
    step = lambda h, c: F.pmod((signed(h.bitwiseXOR(c)).cast("double") * F.lit(FNV_PRIME)).cast("long"), F.lit(4294967296))
    return F.aggregate(units, F.lit(seed).cast("long"), step)


def fnv1a(s: Column, hex_length: int = 24) -> Column:
    """A hash of three lanes whose products are rounded to doubles: not the textbook function."""
    seeds = FNV_SEEDS[: -(-hex_length // 8)]
    lanes = lambda units: F.concat(*[F.lpad(F.lower(F.hex(_lane(units, seed))), 8, "0") for seed in seeds])
    return F.substring(bound(utf16_units(s), lanes), 1, hex_length)


def fast_hash(s: Column) -> Column:
    """The first lane in base 36."""
    return F.lower(F.conv(_lane(utf16_units(s), FNV_SEEDS[0]).cast("string"), 10, 36))


def identity_of(checksums: Column) -> Column:
    """Identity of an item from its photos' checksums: null without any. Repeats count."""
    return F.when(F.size(checksums) > 0, F.substring(F.sha2(F.array_join(F.array_sort(checksums), ":"), 256), 1, 32))


def content_hash(*columns: str, **named: Column) -> Column:
    """16 hexadecimal digits over named values in the order of their names, however they are given. Values that
    are null do not count."""
    values = {c: F.col(c) for c in columns} | named
    return F.substring(F.sha2(F.to_json(F.struct(*[values[n].alias(n) for n in sorted(values)])), 256), 1, 16)


def author_color(name: Column) -> Column:
    wrap = lambda x: F.pmod(x + 2147483648, F.lit(4294967296)) - 2147483648
    h = F.aggregate(utf16_units(name), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.abs(h) % len(PALETTE) + 1).cast("int"))


def selection_fingerprint(checksum: Column, x: Column, y: Column, w: Column, h: Column, prefix: str = "selfp") -> Column:
    """A hash of a rectangle's place; ``prefix`` 'sel' gives the key of older formats."""
    rect = [round_half_up(F.coalesce(v, F.lit(0.0))).cast("string") for v in (x, y, w, h)]
    return fnv1a(F.concat_ws(":", F.lit(prefix), checksum, *rect))


def note_key(content: Column, parent: Column) -> Column:
    """A key of a note's content: its first 200 units, and a hash of all if it is longer."""
    whole = F.when(utf16_length(content) > 200, fnv1a(content, 8)).otherwise(F.lit(""))
    return fnv1a(F.concat(F.lit("note:"), F.coalesce(parent, F.lit("orphan")), F.lit(":"), F.left(content, F.lit(200)), F.lit(":"), whole))


def transcription_key(checksum: Column, index: Column, selection: Column) -> Column:
    return fnv1a(F.concat(F.lit("tx:"), F.concat_ws(":", checksum, selection), F.lit(":"), index))


def valid_rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (x, y, w, h)]
    return finite[0] & finite[1] & finite[2] & finite[3] & (w > 0) & (h > 0)


def format_age(seconds: Column) -> Column:
    """Whole seconds, minutes, or hours and minutes, by size."""
    s = F.floor(seconds)
    return F.when(s < 60, F.concat(s, F.lit("s ago"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m ago"))).otherwise(F.concat(F.floor(s / 3600), F.lit("h "), F.floor(s % 3600 / 60), F.lit("m ago")))


def skip_probability(failures: Column) -> Column:
    return 1 - 1 / F.least(F.pow(F.lit(2.0), failures), F.lit(16.0))


def retry_delay_ms(attempt: Column, first: float = 5000.0, most: float = 300_000.0) -> Column:
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt), F.lit(most)).cast("long")


def mask_ip(ip: Column) -> Column:
    """The half of an address that names a network; '?' without one."""
    four = F.concat(F.split_part(ip, F.lit("."), F.lit(1)), F.lit("."), F.split_part(ip, F.lit("."), F.lit(2)), F.lit(".x.x"))
    six = F.concat(F.substring_index(ip, ":", 4), F.lit("::x"))
    return F.when(F.coalesce(ip, F.lit("")) == "", "?").when(ip.contains("."), four).otherwise(six)


def room_name(s: Column) -> Column:
    """A room's name as a file name."""
    return F.left(F.regexp_replace(s, "[^a-zA-Z0-9_.-]", "_"), F.lit(128))


def server_room_name(s: Column) -> Column:
    """The form of a server: a name with bad characters loses them; an empty one is 'default'."""
    kept = F.left(F.regexp_replace(s, "[^a-zA-Z0-9_. -]", ""), F.lit(128))
    return F.when(s.rlike("^[a-zA-Z0-9][a-zA-Z0-9_. -]{0,127}$"), s).when(kept != "", kept).otherwise(F.lit("default"))


def register(spark: SparkSession) -> None:
    """The text functions as SQL functions of the session."""
    from palimpsest.functions import text

    spark.udf.register("sanitize_html", text.sanitize_html)
    spark.udf.register("render_note", text.render_note)
    normal = "html"
    for tag, before, after in text.REWRITES:
        normal = f"regexp_replace({normal}, r'(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', '{before}$1{after}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_html(html STRING) RETURNS STRING RETURN {normal}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION item_identity(c ARRAY<STRING>) RETURNS STRING RETURN CASE WHEN size(c) > 0 THEN substr(sha2(array_join(array_sort(c), ':'), 256), 1, 32) END")
