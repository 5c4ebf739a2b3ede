"""Text expressions: everything stays a Column, so Catalyst fuses a pipeline into one Project."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Section markers as scanned and as printed.
MARKER_FIXES = (("【検查】", "【检查】"), ("【含量測定】", "【含量测定】"), ("〔礎藏〕", "〔贮藏〕"), ("〔疋藏〕", "〔贮藏〕"), ("〔规格（l）〕", "〔规格（1）〕"), ("【性味与帰経】", "【性味与归经】"), ("【性味與歸經】", "【性味与归经】"))
#: Context rules, a Java pattern and its replacement, applied in this order. A
#: third value is a literal without which the pattern cannot match; it spares the search.
CONTEXT_FIXES = (
    ("(皂)昔", "$1苷"),
    ("(黄芩)昔", "$1苷"),
    ("(连翘)昔", "$1苷"),
    ("(芍药)昔", "$1苷"),
    ("(?U)(\\w+苷)\\s*昔", "$1", "昔"),
    ("照髙效液相色谱法", "照高效液相色谱法"),
    ("照高效液相色谱法（通则。512）", "照高效液相色谱法（通则0512）"),
    ("通则。832", "通则0832"),
    ("通则。502", "通则0502"),
    ("通则。512", "通则0512"),
)
#: Misread parts of names.
NAME_FIXES = (("黄茂", "黄芪"), ("黄苓", "黄芩"), ("黄苔", "黄芩"), ("川弯", "川芎"), ("川夸", "川芎"), ("川菖", "川芎"), ("川萼", "川芎"), ("主茯苓", "土茯苓"))
#: Section names as scanned and as printed.
SECTION_NAMES = {"検查": "检查", "检査": "检查", "含量測定": "含量测定", "含量则定": "含量测定", "性昧与归经": "性味与归经", "性味與歸經": "性味与归经", "St藏": "贮藏", "/藏": "贮藏", "巫藏": "贮藏", "旋藏": "贮藏", "疋藏": "贮藏", "礎藏": "贮藏", "触藏": "贮藏", "正藏": "贮藏", "浸岀物": "浸出物", "功能主治": "功能与主治", "用法": "用法与用量", "注意事项": "注意"}

_WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF41, 0xFF5B), *range(0xFF21, 0xFF3B)])
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


def strip(text: Column) -> Column:
    """Without white space of any script at both ends (``trim`` knows only U+0020)."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def contains_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def is_latin_name(text: Column) -> Column:
    """Nothing but ASCII letters, blanks and hyphens."""
    return strip(text).rlike("(?U)^[A-Za-z\\s\\-]+$")


def replace_literals(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Ordered literal replacements."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def replace_patterns(text: Column, rules: Sequence[tuple[str, ...]]) -> Column:
    """Ordered pattern replacements; ``\\w`` and ``\\s`` need ``(?U)`` to be of all scripts."""

    def apply(c: Column, rule: tuple[str, ...]) -> Column:
        replaced = F.regexp_replace(c, rule[0], rule[1])
        return F.when(F.contains(c, F.lit(rule[2])), replaced).otherwise(c) if len(rule) > 2 else replaced

    return reduce(apply, rules, text)


def half_width(text: Column) -> Column:
    """Full-width digits and letters as ASCII."""
    return F.translate(text, _WIDE, _NARROW)


def collapse_blanks(text: Column) -> Column:
    """Runs of blanks as one, lines stripped, at most one empty line in a row."""
    text = F.regexp_replace(text, "[ \\t]+", " ")
    text = F.regexp_replace(text, "(?Umd)^[\\s&&[^\\n]]+|[\\s&&[^\\n]]+$", "")
    return F.regexp_replace(text, "\\n{3,}", "\n\n")


def repair_references(text: Column) -> Column:
    """The block glyph as a full stop; four-digit method numbers without a leading zero too many."""
    return F.regexp_replace(F.replace(text, F.lit("■"), F.lit("。")), "通则0?\\.?([0-9]{4})", "通则$1")


def clean_text(text: Column, literals: Sequence[tuple[str, str]] = MARKER_FIXES, rules: Sequence[tuple[str, ...]] = CONTEXT_FIXES) -> Column:
    """Marker fixes, context rules, width, blanks, references, strip; NULL and '' pass."""
    return strip(repair_references(collapse_blanks(half_width(replace_patterns(replace_literals(text, literals), rules)))))


def clean_name(name: Column, fixes: Sequence[tuple[str, str]] = NAME_FIXES) -> Column:
    return clean_text(replace_literals(F.translate(name, " 　", ""), fixes))


def lookup(name: Column, mapping: Mapping[str, str] = SECTION_NAMES) -> Column:
    """The mapped name, or the name itself."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a literal, without overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)


def any_of(text: Column, words: Sequence[str], ignore_case: bool = False) -> Column:
    """Whether one of the words stands in the text."""
    return text.rlike(("(?iu)" if ignore_case else "") + "|".join("\\Q" + w + "\\E" for w in words))
