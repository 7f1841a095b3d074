"""String functions as column expressions; code points throughout, Unicode white space where Python has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split() and str.strip() take for white space.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Phrases that models put before a caption, taken off in this order.
PREFIXES = ("Here is the caption:", "Here is the rewritten caption:", "Here is a rewritten caption:", "Here is an image caption:", "e is the caption:")
WINDOW_CHARS = 6400
PLACEHOLDER_CAPTION = "This is an image caption."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def without_prefixes(c: Column | str) -> Column:
    """Takes the fixed phrases off the beginning, each at most once, letters in either case."""
    out = _col(c)
    for phrase in PREFIXES:
        out = F.regexp_replace(out, rf"(?iU)^{phrase}[\s\x1c-\x1f]*", "")
    return out


def clean_caption(c: Column | str) -> Column:
    """Null becomes empty; phrases go, then white space collapses to single spaces."""
    return strip(F.regexp_replace(without_prefixes(strip(F.coalesce(_col(c), F.lit("")))), SPACE + "+", " "))


def without_urls(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), r"(?U)https?://[^\s\x1c-\x1f]+", ""))


def stem(c: Column | str) -> Column:
    """A file name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(_col(c), r"(?<=[^/.])\.[^./]*$", "")


def extension(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"[^/.](\.[^./]*)$", 1)


def drop_all(c: Column | str, part: str) -> Column:
    """Every occurrence goes, not only one at the end."""
    return F.replace(_col(c), F.lit(part), F.lit(""))


def before_first(c: Column | str, mark: str) -> Column:
    return F.substring_index(_col(c), mark, 1)


def before_last(c: Column | str, mark: str) -> Column:
    """The text before the last mark; without a mark the whole text."""
    own = _col(c)
    tail = F.length(F.substring_index(own, mark, -1))
    return F.when(F.instr(own, mark) > 0, F.substring(own, F.lit(1), F.length(own) - tail - len(mark))).otherwise(own)


def lines(c: Column | str) -> Column:
    return F.split(_col(c), "\n", -1)


def joined(parts: Column | str) -> Column:
    return F.array_join(_col(parts), "\n")


def last_chars(c: Column | str, n: int = WINDOW_CHARS) -> Column:
    return F.right(_col(c), F.lit(n))


def first_chars(c: Column | str, n: int = WINDOW_CHARS) -> Column:
    return F.left(_col(c), F.lit(n))


def find(text: Column | str, part: Column | str) -> Column:
    """Place of the first occurrence, from 0; -1 if there is none."""
    return F.call_function("locate", _col(part), _col(text)) - 1


def is_marker(c: Column | str) -> Column:
    """Whether the text, stripped, is one <...>."""
    return strip(c).rlike("^<[^>]+>$")


def absolute_url(c: Column | str) -> Column:
    own = _col(c)
    return F.when(own.startswith("//"), F.concat(F.lit("https:"), own)).otherwise(own)


def original_image_url(c: Column | str) -> Column:
    """Protocol-relative addresses get https; of addresses that contain cnn, query and fragment go."""
    own = absolute_url(c)
    return F.when(F.contains(own, F.lit("cnn")), F.regexp_replace(own, r"[?#].*$", "")).otherwise(own)


def url_suffix(c: Column | str, default: str = ".jpg") -> Column:
    """Extension of the address's path."""
    path = F.regexp_replace(F.regexp_replace(_col(c), r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")
    found = extension(F.substring_index(path, "/", -1))
    return F.when(found.isin("", "."), F.lit(default)).otherwise(found)


def image_key(article: Column | str, n: Column, ext: Column) -> Column:
    return F.concat(_col(article), F.lit("_"), n.cast("string"), ext)


def marker(key: Column) -> Column:
    return F.concat(F.lit("<"), key, F.lit(">"))


def title(html: Column | str) -> Column:
    """What stands between the first <title> and </title>, '' if nothing does; a reference counts only with its semicolon, and &lt; &gt; &quot; &amp; are known."""
    own = F.regexp_replace(F.regexp_extract(_col(html), r"(?s)<title>(.*?)</title>", 1), r"^\p{Zs}+|\p{Zs}+$(?!\n)", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        own = F.replace(own, F.lit(name), F.lit(mark))
    return own


def keywords(c: Column | str) -> Column:
    return F.transform(F.split(_col(c), ",", -1), strip)


def with_task(c: Column | str, task: str = "summarize:") -> Column:
    return F.concat(F.lit(task), _col(c))


def preview(c: Column | str, n: int = 80) -> Column:
    own = _col(c)
    return F.when(F.length(own) > n, F.concat(F.left(own, F.lit(n)), F.lit("..."))).otherwise(own)


def after_prompt(output: Column | str, prompt: Column | str) -> Column:
    """What a model wrote after the prompt, which it repeats."""
    own = _col(output)
    return strip(F.substring(own, F.length(_col(prompt)) + 1, F.length(own)))


def before_separator(c: Column | str, separator: str) -> Column:
    return strip(F.substring_index(_col(c), separator, 1))


def replace_first(c: Column | str, part: str, by: Column) -> Column:
    own = _col(c)
    at = F.instr(own, part)
    rest = F.substring(own, at + len(part), F.length(own))
    return F.when(at > 0, F.concat(F.substring(own, F.lit(1), at - 1), by, rest)).otherwise(own)


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(_col(c), SPACE + "+"), lambda w: w != ""))


def reading_minutes(words: Column) -> Column:
    """words / 200 to two digits as Python rounds: by the exact value of the double, a half to the even digit.

    For odd numbers of words the decimal is a tie; the double may lie to either side of it. The side is
    the sign of 200 times the double less words, taken exactly from a high and a low part of the double.
    """
    n = words.cast("double")
    x = n / 200
    big = x * 134217729.0
    high = big - (big - x)
    side = (high * 200 - n) + (x - high) * 200
    half = F.floor(n / 2)
    up = (side > 0) | ((side == 0) & (half % 2 == 1))
    return F.when(n % 2 == 0, n / 2).otherwise(F.when(up, half + 1).otherwise(half)) / 100
