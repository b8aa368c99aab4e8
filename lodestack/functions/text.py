"""Text functions as Column expressions: JVM-side, no Python rows."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, symbols and section names.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
SECTIONS = ("Executive Summary", "Understanding", "Approach", "Proposed Team", "Risks", "Why Us")
SLUG_WORDS = (("+", " plus "), ("@", " at "), ("&", " and "), ("%", " percent "), ("$", " dollar "))
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d"))
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def is_text(column: Column | str) -> Column:
    """Text-likeness of the first 1,024 characters: under a tenth control characters; NUL counts twice."""
    head = F.substring(_c(column), 1, 1024)
    odd = F.length(head) - F.length(F.regexp_replace(head, CONTROL, "")) + F.length(head) - F.length(F.regexp_replace(head, r"\x00", ""))
    return (odd < F.length(head) * 0.1) | (F.length(head) == 0)


def word_counts(column: Column | str) -> list[Column]:
    """Three counts: by single blanks (empty words count), by white space, and of non-empty words."""
    c = _c(column)
    return [F.size(F.split(c, " ")), F.size(F.split(c, r"\s+")), F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))]


def token_estimate(column: Column | str) -> Column:
    """Long texts (5,120 characters and more) by an eighth of their length, shorter ones by a quarter."""
    n = F.length(_c(column))
    return F.when(n >= 5120, F.ceil(n / 8.0)).otherwise(F.ceil(n / 4.0)).cast("long")


@lru_cache
def plain_letters() -> tuple[str, str]:
    """Lower-case letters with marks of the Latin blocks, and the letters they are without them."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, (*range(0xDF, 0x250), *range(0x1E00, 0x1F00))) if c.islower() and unicodedata.normalize("NFD", c)[0] != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def slug(column: Column | str) -> Column:
    """Lower case, symbols as words, letters with marks as plain ones, everything else as one dash."""
    c = F.lower(_c(column))
    for symbol, word in SLUG_WORDS + LIGATURES:
        c = F.replace(c, F.lit(symbol), F.lit(word))
    c = F.translate(c, *plain_letters())
    c = F.regexp_replace(c, r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(c, r"[\s-]+", "-"), r"^-|-$", "")


def collection_name(column: Column | str) -> Column:
    """A name of 3 to 63 letters, digits, dots, dashes and underscores that begins and ends with a letter or digit."""
    c = F.regexp_replace(F.regexp_replace(_c(column), r"[^A-Za-z0-9._-]+", "-"), r"\.{2,}", ".")
    c = F.regexp_replace(F.substring(F.regexp_replace(c, r"^[^A-Za-z0-9]+", ""), 1, 63), r"[^A-Za-z0-9]+$", "")
    return F.when(F.length(c) >= 3, c).otherwise(F.concat(F.lit("ns-"), c, F.lit("0")))


def file_name(column: Column | str) -> Column:
    return F.regexp_replace(_c(column), r'[<>:"/\\|?*\x00-\x1F]', "")


def strip_thoughts(column: Column | str) -> Column:
    c = F.regexp_replace(_c(column), r"(?is)<(?:think|thinking|thought|thought_chain|reasoning)>.*?</(?:think|thinking|thought|thought_chain|reasoning)>", "")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def decode_entities(column: Column | str) -> Column:
    c = _c(column)
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def human_size(column: Column | str) -> Column:
    """Bytes as text with a unit of 1,024 and at most two decimals."""
    n = _c(column).cast("double")
    ladder = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        value = F.concat(F.round(n / 1024**power, 2).cast("string"), F.lit(f" {unit}"))
        ladder = ladder.when(n < 1024 ** (power + 1), value) if power < 3 else ladder.otherwise(value)
    return ladder


def missing_sections(column: Column | str, sections: tuple[str, ...] = SECTIONS) -> Column:
    low = F.lower(_c(column))
    return F.filter(F.array(*map(F.lit, sections)), lambda s: ~low.contains(F.lower(s)))


def canonical_url(column: Column | str) -> Column:
    c = F.trim(_c(column))
    c = F.when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), c).otherwise(F.concat(F.lit("https://"), c))
    return F.regexp_replace(c, "/$", "")


def is_public_url(column: Column | str) -> Column:
    """http or https, and no private address except 127.0.0.1 and 0.0.0.0."""
    host = F.regexp_extract(_c(column), r"^https?://(?:[^/@]*@)?([^:/?#]+)", 1)
    private = host.rlike(r"^(192|172|10|127|169)(\.[0-9]{1,3}){3}$") & ~host.isin("127.0.0.1", "0.0.0.0")
    return _c(column).rlike(r"^https?://[^/?#\s]+") & ~private


def video_id(column: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(column), r"(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|v/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def split_source(column: Column | str) -> list[Column]:
    """(type, source) of ``type://source``; the source loses its query for repositories and wikis."""
    kind = F.nullif(F.regexp_extract(_c(column), r"^([A-Za-z]+)://", 1), F.lit(""))
    rest = F.regexp_replace(_c(column), r"^[A-Za-z]+://", "")
    return [kind, F.when(kind.isin("confluence", "github"), F.regexp_replace(rest, r"\?.*$", "")).otherwise(rest)]


def can_watch(column: Column | str) -> Column:
    c = _c(column)
    return (c.startswith("link://") & c.endswith(".html")) | c.rlike("^(youtube|confluence|github|gitlab)://")


def source_key(title: Column | str, published: Column | str) -> Column:
    """Identity of a source; null (equal to nothing) where a part is missing."""
    return F.concat(F.lit("title:"), _c(title), F.lit("-timestamp:"), _c(published))


def metadata_header(title: Column | str, published: Column | str, source: Column | str) -> Column:
    """The header in front of a chunk; lines of missing parts and an empty header are left out."""
    source = F.when(_c(source).rlike("^(link|youtube)://"), F.regexp_replace(_c(source), "^(link|youtube)://", ""))
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), c) for name, c in (("sourceDocument", _c(title)), ("published", _c(published)), ("source", source))))
    return F.when(lines != "", F.concat(F.lit("<document_metadata>\n"), lines, F.lit("\n</document_metadata>\n\n"))).otherwise("")


def middle_out(tokens: Column, target: int, marker: str = "--prompt truncated--") -> Column:
    """An array of tokens cut to about ``target`` by removing its middle; unchanged when short enough."""
    half = F.round((F.size(tokens) - target) / 2.0).cast("int")
    middle = F.floor(F.size(tokens) / 2.0).cast("int")
    cut = F.concat(F.slice(tokens, F.lit(1), F.greatest(middle - half, F.lit(0))), F.array(F.lit(marker)), F.slice(tokens, middle + half + 1, F.size(tokens)))
    return F.when(F.size(tokens) <= target, tokens).otherwise(cut)


def clip_context(column: Column | str, limit: int) -> Column:
    """The first ``limit`` characters, back to the last line end where that keeps over four fifths of them."""
    head = F.substring(_c(column), 1, limit)
    last = F.length(head) - F.length(F.substring_index(head, "\n", -1))
    tidy = F.when((F.locate("\n", head) > 0) & (last > limit * 0.8), F.substring(head, F.lit(1), last - 1)).otherwise(head)
    return F.when(F.length(_c(column)) <= limit, _c(column)).otherwise(tidy)


def clip_words(column: Column | str, limit: int) -> Column:
    """The first ``limit`` characters, back to the last blank where that keeps over four fifths of them."""
    head = F.substring(_c(column), 1, limit)
    blank = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    return F.when(F.length(_c(column)) <= limit, _c(column)).when(blank > limit * 0.8, F.substring(head, F.lit(1), blank)).otherwise(head)


def array_chunks(array: Column, size: int) -> Column:
    """The array in consecutive pieces of ``size``; an empty array has none."""
    starts = F.sequence(F.lit(1), F.size(array), F.lit(size))
    return F.when(F.size(array) > 0, F.transform(starts, lambda i: F.slice(array, i, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def expand_template(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by its value (empty where null); an unknown ``{class.prop}`` becomes ``[Class prop]``, other names stay."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    out = F.regexp_replace(out, r"\{user\.([A-Za-z]+)\}", "[User $1]")
    return F.regexp_replace(out, r"\{workspace\.([A-Za-z]+)\}", "[Workspace $1]")


def expand_presets(column: Column, presets: DataFrame) -> Column:
    """Commands of (created, command, prompt) replaced where they stand between blanks, in the order they were created; settings, not data."""
    out = column
    for r in presets.orderBy("created").limit(10_000).collect():
        prompt = r.prompt.replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, rf"(^|\s){re.escape(r.command)}(\s|$)", f"$1{prompt}$2")
    return out


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by its value; a ``{class.prop}`` without one becomes ``[Class prop]``, other names stay."""
    out = template
    for name, value in values.items():
        kind, _, prop = name.partition(".")
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit(f"[{kind.capitalize()} {prop}]" if prop else "")))
    return F.regexp_replace(F.regexp_replace(out, r"\{user\.([A-Za-z]+)\}", "[User $1]"), r"\{workspace\.([A-Za-z]+)\}", "[Workspace $1]")


def delimiter(column: Column | str) -> Column:
    """The most frequent of , ; tab | in the first line; on equal counts the earlier of them, comma where none occurs."""
    line = F.substring_index(_c(column), "\n", 1)
    counted = F.array(*(F.struct(F.regexp_count(line, F.lit(pattern)).alias("n"), F.lit(-i).alias("i"), F.lit(sign).alias("sign")) for i, (sign, pattern) in enumerate(((",", ","), (";", ";"), ("\t", "\t"), ("|", r"\|")))))
    return F.array_max(counted)["sign"]


def cell_kind(column: Column | str) -> Column:
    """Kind of a table cell: empty, boolean, number, thousands, currency, percent, date or text."""
    c = F.trim(_c(column))
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(F.lower(c).isin("true", "false"), "boolean")
        .when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number")
        .when(c.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), "thousands")
        .when(c.rlike(r"^[$€£] ?-?[0-9][0-9,]*(\.[0-9]+)?$"), "currency")
        .when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?%$"), "percent")
        .when(c.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2})$"), "date")
        .otherwise("text")
    )


def matches_any(column: Column | str, listed: Column) -> Column:
    """Comma-separated values, any of which the text contains, without regard to case."""
    low = F.lower(_c(column))
    return F.exists(F.filter(F.transform(F.split(listed, ","), lambda v: F.lower(F.trim(v))), lambda v: v != ""), lambda v: low.contains(v))


def numeric_compare(column: Column | str, comparator: str, operand: str) -> Column:
    """gt, gte, lt, lte, eq, neq or between (two numbers, inclusive); what is no number compares false."""
    n = _c(column).try_cast("double") if hasattr(_c(column), "try_cast") else _c(column).cast("double")
    parts = [float(x) for x in operand.split(",")]
    tests = {"gt": lambda: n > parts[0], "gte": lambda: n >= parts[0], "lt": lambda: n < parts[0], "lte": lambda: n <= parts[0], "eq": lambda: n == parts[0], "neq": lambda: n != parts[0]}
    if comparator == "between":
        return F.coalesce(n.between(*parts), F.lit(False)) if len(parts) == 2 else F.lit(False)
    return F.coalesce(tests[comparator](), F.lit(False))
