"""Scalar functions on text, as Column expressions.

Offsets count code points. White space in patterns is spelled out, since classes differ between engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]"
#: Unicode white space, as the usual strip() of a string removes it.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
OPEN_TAG, CLOSE_TAG = "<mark-yellow>", "</mark-yellow>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_count(text: Column | str) -> Column:
    """Tokens by the default counter: runs of word characters and single other characters."""
    return F.coalesce(F.regexp_count(col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def universal_newlines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "\r\n?", "\n")


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^{SPACE}+|{SPACE}+$", "")


def anchor_preview(anchor: Column | str, limit: int = 140) -> Column:
    """One bounded line: control characters escaped, the middle of long anchors left out."""
    a = F.coalesce(col(anchor), F.lit(""))
    shown = a
    for raw, seen in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        shown = F.replace(shown, F.lit(raw), F.lit(seen))
    half = limit // 2
    short = F.when(F.length(shown) > limit, F.concat(F.left(shown, F.lit(half)), F.lit(" … "), F.right(shown, F.lit(half)))).otherwise(shown)
    return F.concat(F.lit("[BEGIN_ANCHOR len="), F.length(a).cast("string"), F.lit("]"), short, F.lit("[END_ANCHOR]"))


def embedded_json(text: Column | str) -> Column:
    """From the first opening to the last closing brace, if that is a JSON object; else null."""
    t = col(text)
    first, last = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1
    found = F.when((first > 0) & (F.locate("}", t) > 0) & (last >= first), F.substring(t, first, last - first + 1))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def code_block(text: Column | str, strict: bool = False) -> Column:
    """Inside of the first fenced text block; ``strict`` asks for the txt marker. Null if there is none."""
    pattern = "(?is)```txt\\n(.*?)\\n```" if strict else "(?is)```(?:txt)?\\n(.*?)\\n```"
    return F.when(F.regexp_like(col(text), F.lit(pattern)), F.regexp_extract(col(text), pattern, 1))


def code_blocks(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit("(?is)```txt\\n.*?\\n```"))


def thinking(text: Column | str, seed: bool = False) -> Column:
    """The stripped inside of the first think tag, or null."""
    tag = "seed:think" if seed else "think"
    pattern = f"(?is)<{tag}>(.*?)</{tag}>"
    return F.when(F.regexp_like(col(text), F.lit(pattern)), strip(F.regexp_extract(col(text), pattern, 1)))


def page_markdown(text: Column | str, page: Column | str) -> Column:
    """What stands between the one start and the one end marker of a page, stripped; null if they don't stand so, or it is too large or empty."""
    t, p = col(text), col(page)
    start, end = (F.concat(F.lit(f"<<<MD_{x}\\s+page="), p, F.lit(">>>")) for x in ("START", "END"))
    once = (F.regexp_count(t, start) == 1) & (F.regexp_count(t, end) == 1)
    inside = F.concat(F.lit("(?s)"), start, F.lit("(.*?)"), end)
    found = F.when(once & F.regexp_like(t, inside), strip(F.call_function("regexp_extract", t, inside, F.lit(1))))
    return F.when((F.length(found) > 0) & (F.length(found) <= 400_000), found)


def valid_tags(text: Column | str, require: bool = False) -> Column:
    """Highlight tags come in pairs, un-nested; ``require``: at least one pair."""
    tags = F.regexp_extract_all(col(text), F.lit("(</?mark-yellow>)"))
    # 0: outside, 1: inside, -1: broken
    state = F.aggregate(tags, F.lit(0), lambda s, t: F.when((s == 0) & (t == OPEN_TAG), 1).when((s == 1) & (t == CLOSE_TAG), 0).otherwise(-1))
    odd = F.regexp_like(col(text), F.lit("<mark-yellow[^>]*>")) & ~F.contains(col(text), F.lit(OPEN_TAG))
    ok = (state == 0) & ~odd
    return ok & (F.size(tags) > 0) if require else ok


def mark_runs(text: Column | str) -> Column:
    """array<struct<segment, marked>> of a text with valid tags: pieces between tags alternate."""
    pieces = F.split(col(text), "</?mark-yellow>")
    runs = F.transform(pieces, lambda x, i: F.struct(x.alias("segment"), (i % 2 == 1).alias("marked")))
    return F.filter(runs, lambda x: x["segment"] != "")


def truthy(value: Column | str) -> Column:
    """Truth of a JSON value as a boolean coercion has it: a non-empty string is true, whatever it says."""
    v = F.try_parse_json(col(value))
    kind = F.schema_of_variant(v)
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    return F.coalesce(
        F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", F.length(text) > 0).when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), number != 0).when(kind == "VOID", False).otherwise(~text.isin("[]", "{}")),
        F.lit(False),
    )


def strict_true(value: Column | str) -> Column:
    """True only for the JSON boolean."""
    return F.coalesce(strip(value) == "true", F.lit(False))


def lenient_true(value: Column | str) -> Column:
    """True for the JSON boolean, and for a string that says true whatever its case and surrounding space."""
    v = F.try_parse_json(col(value))
    said = F.lower(strip(F.try_variant_get(v, "$", "string")))
    return F.coalesce(F.schema_of_variant(v).isin("BOOLEAN", "STRING") & (said == "true"), F.lit(False))


def visible(path: Column | str) -> Column:
    """No segment of the relative path starts with a dot."""
    return ~F.regexp_like(col(path), F.lit(r"(^|/)\."))


def filename_parts(name: Column | str) -> Column:
    """struct<stem, num, width, ext> of a name that ends with digits and .txt; null for any other.

    Names of digits alone have an empty stem; in others it is what stands before the digits.
    """
    digits = F.regexp_extract(col(name), r"(\d+)\.txt$", 1)
    stem = F.substring(col(name), F.lit(1), F.length(col(name)) - F.length(digits) - 4)
    found = F.struct(stem.alias("stem"), digits.cast("long").alias("num"), F.length(digits).alias("width"), F.lit(".txt").alias("ext"))
    return F.when(digits != "", found)


def folded_path(path: Column | str) -> Column:
    """The key that paths are sorted by: case-folded. Lower-casing after upper-casing folds what has several small forms."""
    return F.lower(F.upper(col(path)))


def header_line(chunk: Column | str) -> Column:
    return F.substring_index(col(chunk), "\n", 1)


def body(chunk: Column | str) -> Column:
    """The chunk without its header line; nothing if there is only a header."""
    at = F.locate("\n", col(chunk))
    return F.when(at > 0, F.substring(col(chunk), at + 1, F.length(col(chunk)))).otherwise("")


def html_to_text(html: Column | str) -> Column:
    """Text of a page by rules: comments, scripts and styles out, tags to blanks, common entities decoded, blanks merged."""
    t = F.regexp_replace(col(html), "(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, "[ \\t\\n\\r]+", " "))


def unique_join(values: Column | str, separator: str = " | ") -> Column:
    return F.array_join(F.array_distinct(col(values)), separator)


def long_enough(returned: Column, given: Column, fence: int = 11) -> Column:
    """A repetition of a fenced text, by lengths without the fence, is at least 98 % of it."""
    return 50 * (returned + fence) >= 49 * (given + fence)
