"""Normalisation and scalar string functions. Offsets are 0-based code points; null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelsieve.sources import fixed

CJK = "[㐀-鿿豈-﫿]"
HAN = f"[{chr(0x4E00)}-{chr(0x9FFF)}]"
#: White space as browsers have it; Java's \s lacks the last three.
SPACE = "[\\s" + chr(0xA0) + chr(0x3000) + chr(0xFEFF) + "]"
_TRIM = f"^{SPACE}+|{SPACE}+$"
_FULL = "".join(map(chr, [*range(0xFF01, 0xFF5F), 0x3000]))
_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
_WIDE_CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x3000, 0x303F), (0xFF00, 0xFFEF)))


def _text(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def trim(column: Column | str) -> Column:
    return F.regexp_replace(_text(column), _TRIM, "")


def half_width(column: Column | str) -> Column:
    return F.translate(_text(column), _FULL, _HALF)


def normalize_text(column: Column | str) -> Column:
    """Half width, plain quotes and line feeds; no white space beside Chinese characters."""
    near = "[㐀-鿿豈-﫿、，。：；（）]"
    s = F.regexp_replace(half_width(column), "\r\n?", "\n")
    s = F.translate(s, "‘’“”", "''\"\"")
    for pattern, to in (
        (f"({near})[ \t\n]+(?={near})", "$1"), (f"({CJK})[ \t]+", "$1"), (f"[ \t]+({CJK})", "$1"), ("[ \t]{2,}", " "), ("\n{3,}", "\n\n"),
    ):
        s = F.regexp_replace(s, pattern, to)
    return s


def ocr_post_process(column: Column | str) -> Column:
    """Half width; single spaces between Chinese characters go, inner ones of a run stay; ends trimmed.

    A character is judged as it stands after the change to half width, the one behind a space as the next raw one.
    """
    s = F.regexp_replace(half_width(column), f"(?<=[{_WIDE_CJK}]) (?=[{_WIDE_CJK}])", "")
    return trim(F.regexp_replace(s, "\n{3,}", "\n\n"))


def has_chinese(column: Column | str) -> Column:
    return _text(column).rlike(HAN)


def cjk_count(column: Column | str) -> Column:
    return F.regexp_count(_text(column), F.lit(HAN))


def snippet(text: Column, start: Column, length: Column, around: int = 14) -> Column:
    """Struct (text, offset, length): the match with its surroundings and where it stands in them."""
    size = F.length(text)
    a, b = F.greatest(start - around, F.lit(0)), F.least(start + length + around, size)
    body = F.replace(F.substring(text, a + 1, b - a), F.lit("\n"), F.lit(" "))
    shown = F.concat(F.when(a > 0, "…").otherwise(""), body, F.when(b < size, "…").otherwise(""))
    return F.struct(shown.alias("text"), (start - a + (a > 0).cast("int")).cast("int").alias("offset"), length.cast("int").alias("length"))


def mark_snippet(snip: Column, term: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The snippet with its span marked; where the span doesn't fit, the first occurrence of the term."""
    t, o, n = snip["text"], snip["offset"], snip["length"]

    def cut(at: Column, size: Column) -> Column:
        return F.concat(F.substring(t, F.lit(1), at), F.lit(before), F.substring(t, at + 1, size), F.lit(after), F.substring(t, at + size + 1, F.length(t)))

    first = F.position(term, t)
    fits = (n > 0) & (o >= 0) & (o + n <= F.length(t))
    return F.when(fits, cut(o, n)).when((F.length(term) > 0) & (first > 0), cut(first - 1, F.length(term))).otherwise(t)


def squash_ws(column: Column | str) -> Column:
    return F.regexp_replace(_text(column), f"{SPACE}+", "")


def strip_tones(column: Column | str) -> Column:
    """Lower-case romanisation without tone marks; ü in any tone is v."""
    return F.translate(F.lower(_text(column)), "āáǎàēéěèīíǐìōóǒòūúǔùüǖǘǚǜ", "aaaaeeeeiiiioooouuuuvvvvv")


def translate_url(column: Column | str) -> Column:
    """Array of two links that open the text in a translator, percent-encoded."""
    coded = F.replace(F.url_encode(_text(column)), F.lit("+"), F.lit("%20"))
    return F.array(F.concat(F.lit("https://fanyi.baidu.com/#zh/en/"), coded), F.concat(F.lit("https://translate.google.com/?sl=zh-CN&tl=en&text="), coded, F.lit("&op=translate")))


def lookup_name_guess(name: Column, text: Column, alias: Column) -> Column:
    """Name for a catalogue search: the declared one, a short text as it is, a Chinese run around the alias, or the longest run."""
    plain = trim(F.regexp_replace(_text(text), f"{SPACE}+", " "))
    around = F.filter(F.regexp_extract_all(plain, F.lit(HAN + "{2,14}"), F.lit(0)), lambda r: r.contains(alias))
    runs = F.regexp_extract_all(plain, F.lit(HAN + "{2,12}"), F.lit(0))
    longest = F.try_element_at(F.filter(runs, lambda r: F.length(r) == F.array_max(F.transform(runs, lambda x: F.length(x)))), F.lit(1))
    short = F.when((F.length(plain) >= 2) & (F.length(plain) <= 24), plain)
    return F.coalesce(F.when(F.length(name) > 0, name), short, F.when(alias.isNotNull(), F.coalesce(F.try_element_at(around, F.lit(1)), alias)), longest, F.lit(""))


def ai_text_usable(column: Column | str) -> Column:
    """Whether at least 6 Chinese characters are left without a leading list header and unreadable marks."""
    bare = F.regexp_replace(F.regexp_replace(_text(column), f"^{SPACE}*配料[:：]?", ""), r"(?i)\[?unreadable\]?", "")
    return cjk_count(bare) >= 6


def is_alcoholic(column: Column | str) -> Column:
    return _text(column).rlike(fixed.ALCOHOL_MARK)


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def severity(status: Column) -> Column:
    return F.coalesce(_lookup(fixed.SEVERITY, status), F.lit(0))


def status_label(status: Column) -> Column:
    return F.coalesce(_lookup(fixed.STATUS_LABELS, status), status)


def level_color(level: Column) -> Column:
    return F.coalesce(_lookup(fixed.LEVEL_COLORS, level), F.lit(fixed.LEVEL_COLORS["unknown"]))
