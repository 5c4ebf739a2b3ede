"""One form for texts that look the same.

``canonical`` levels full and half width, compatibility ideographs and radicals, combining
sequences, kinds of blanks, invisible characters and look-alike letters. What looks
different stays: raised, lowered and circled digits, fractions, case, traditional forms,
line ends. Look-alike letters of other scripts are always written with one code point, also
inside words of that script and below marks: the form serves comparison. Only kana that carry
a sound mark keep their script, for with the mark they look like no ideograph.

Normalisation works on unstable segments only: a quick check, a character class built from
the properties of every code point, finds runs that may change together with the character
before them (the boundary context). A segment is decomposed, its base letters are mapped, and
it is composed again, so canonically equivalent texts get one form; the segments are spliced
into the rest of the text, which stays as it is. In the DataFrame operator the most frequent
width forms are levelled in the JVM, and only texts that still fail the quick check reach Python.

Results for odd input: NULL stays NULL, an empty text stays empty; ``canonical`` of its own
result is that result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.session import broadcast_checked, cut

#: Letters and signs that look alike, in natural order.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Latin of other shapes
    "ı": "i", "ɑ": "a", "ɡ": "g", "ꞌ": "'",
    # Katakana and ideographs
    "エ": "工", "カ": "力", "タ": "夕", "ニ": "二", "ハ": "八", "ロ": "口", "ト": "卜", "ヘ": "へ",
    # Radicals without a compatibility mapping
    "⺀": "冫", "⺅": "亻", "⺌": "小", "⺗": "心", "⺟": "母", "⺠": "民", "⺡": "氵", "⺢": "水", "⺣": "灬", "⺦": "丬", "⺨": "犭", "⺩": "王", "⺬": "示", "⺮": "竹", "⺶": "羊", "⺷": "羊", "⺻": "聿", "⺼": "月", "⺾": "艹", "⻁": "虎", "⻂": "衤", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻏": "阝", "⻐": "钅", "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻳": "龟",
    # Signs
    "‐": "-", "‑": "-", "−": "-", "‒": "-", "–": "-", "’": "'", "‘": "'", "“": '"', "”": '"',
}
_KEPT_TAGS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")
#: Width forms that the JVM levels before the quick check, and what they become.
WIDE = "，：；（）！？％～［］｜／"
NARROW = ",:;()!?%~[]|/"
#: Code points with decompositions end below this one.
_LAST = 0x2FA20
#: Jamo compose with each other although none of them is a mark.
_JAMO = ((0x1100, 0x1200),)


def _target(ch: str) -> str:
    """What a single character becomes, decomposed."""
    category = unicodedata.category(ch)
    if category == "Cf" or ch in "͏ᅟᅠㅤﾠ឴឵" or 0xFE00 <= ord(ch) <= 0xFE0F or 0x180B <= ord(ch) <= 0x180F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    if category == "Zs":
        return " "
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    kind = unicodedata.decomposition(ch)
    if kind.startswith(_KEPT_TAGS):
        return ch
    if kind.startswith("<"):
        return "".join(map(_target, unicodedata.normalize("NFKD", ch)))
    parts = unicodedata.normalize("NFD", ch)
    return ch if parts == ch else "".join(map(_target, parts))


def _kana() -> re.Pattern:
    """Kana with a look-alike, also half-width, with the marks that follow them."""
    kana = "".join(chr(cp) for cp in [*range(0x30A1, 0x30FB), *range(0xFF66, 0xFF9E)] if chr(cp) in LOOKALIKES or unicodedata.normalize("NFKC", chr(cp)) in LOOKALIKES)
    return re.compile(f"[{kana}](?=[\u3099\u309a\uff9e\uff9f])")


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], re.Pattern, re.Pattern]:
    """The mapping of single characters after decomposition, the quick check for unstable runs,
    and kana that keep their script because a sound mark follows.

    All characters beyond the basic plane count as unstable, so that the class is a bitmap.
    """
    mapping, unstable = {}, []
    for cp in [*range(0x80, 0xD800), *range(0xE000, _LAST), *range(0xE0000, 0xE01F0)]:
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category == "Cn":
            continue
        target = _target(ch)
        if target != ch and not (len(parts := unicodedata.normalize("NFD", ch)) > 1 and parts[1] in "\u3099\u309a"):
            mapping[cp] = target
        if cp < 0x10000 and (unicodedata.normalize("NFC", mapping.get(cp, ch)) != ch or category in ("Mn", "Mc") or any(a <= cp < b for a, b in _JAMO)):
            unstable.append(re.escape(ch))
    return mapping, re.compile(f"[{''.join(unstable)}\U00010000-\U0010ffff]+"), _kana()


def _level(segment: str, mapping: dict[int, str], marked: re.Pattern) -> str:
    """A segment decomposed, mapped and composed."""
    if not marked.search(segment):
        return unicodedata.normalize("NFC", unicodedata.normalize("NFC", segment).translate(mapping))
    wide = marked.sub(lambda m: unicodedata.normalize("NFKC", m.group()), segment).translate(_MARKS)
    parts, done = [], 0
    wide = unicodedata.normalize("NFC", wide)
    for kana in marked.finditer(wide):
        parts += [wide[done : kana.start()].translate(mapping), kana.group()]
        done = kana.end()
    return unicodedata.normalize("NFC", "".join(parts) + wide[done:].translate(mapping))


#: Half-width sound marks as the marks they stand for.
_MARKS = {0xFF9E: "\u3099", 0xFF9F: "\u309a"}


def canonical(text: str | None) -> str | None:
    """The form of ``text`` that all equal-looking texts share."""
    if not text or text.isascii():
        return text
    mapping, unstable, marked = _tables()
    parts, done = [], 0
    for run in unstable.finditer(text):
        start = max(done, run.start() - 1)  # a mark composes with the character before it
        parts += [text[done:start], _level(text[start : run.end()], mapping, marked)]
        done = run.end()
    return "".join(parts) + text[done:] if parts else text


def aligned(text: str) -> tuple[str, list[int]]:
    """``canonical(text)`` and, for each of its characters and for its end, the place in
    ``text`` where its source begins."""
    mapping, unstable, marked = _tables()
    parts, places, done = [], [], 0
    for run in unstable.finditer(text):
        start, end = max(done, run.start() - 1), run.end()
        form = _level(text[start:end], mapping, marked)
        singles = [_level(ch, mapping, marked) for ch in text[start:end]]
        parts += [text[done:start], form]
        places += range(done, start)
        if "".join(singles) == form:
            places += [k for k, single in enumerate(singles, start) for _ in single]
        else:
            places += [start] * len(form)
        done = end
    return "".join(parts) + text[done:], [*places, *range(done, len(text) + 1)]


def _levelled(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("℃"), F.lit("°C")), WIDE, NARROW)


#: Quick check of the JVM: ASCII, precomposed Latin, Greek without look-alikes, ideographs
#: and CJK punctuation; a text with any other character is looked at in Python.
STABLE_CLASS = r"^[\x00-\x7e°±·À-İĴ-ľŁ-ňŊ-žα-θκ-μ—、。〈-】一-鿿]*$"


def canonical_forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, text, canonical``; a row per row of ``df``."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("level", _levelled(F.col("text")))
    stable = F.coalesce(F.col("level").rlike(STABLE_CLASS), F.lit(True))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array([canonical(t) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), forms], ["id", "text", "canonical"])

    done = source.filter(stable).select("id", "text", F.col("level").alias("canonical"))
    rest = source.filter(~stable).mapInArrow(run, f"id {kind}, text string, canonical string")
    return done.unionByName(rest).withColumnRenamed("id", id_col)


#: Rows of either side of a group that meet in one cell of the join.
CELL_ROWS = 2_000


def _keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``id, look, raw, changed``: digests of the form and of the text of every row, written once;
    and ``look, n, n_changed`` of the looks that more than one row and a changed row have."""
    forms = canonical_forms(df, id_col, text_col).filter(F.col("text").isNotNull())
    keyed = cut(forms.select(F.col(id_col).alias("id"), F.unhex(F.md5("canonical")).alias("look"), F.unhex(F.md5("text")).alias("raw"), (F.col("text") != F.col("canonical")).alias("changed")).distinct())
    sizes = keyed.groupBy("look").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed")).filter("n > 1 AND n_changed > 0")
    return keyed, sizes


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_a, id_b`` (``id_a < id_b``) of rows whose texts look the same but differ.

    Every pair has a side that is not in canonical form. So only such rows are joined with all
    rows of their look; a text that many rows share unchanged forms no pair by itself. A look
    that many rows have is cut into cells of at most ``CELL_ROWS`` rows a side, which go to
    tasks of their own. NULL texts form no pairs.
    """
    keyed, sizes = _keyed(df, id_col, text_col)
    rows = keyed.join(broadcast_checked(sizes), "look")
    down, across = F.ceil(F.col("n_changed") / CELL_ROWS), F.ceil(F.col("n") / CELL_ROWS)
    a = rows.filter("changed").select(F.col("id").alias("a"), "look", F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("id"), down).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), across - 1)).alias("j"))
    b = rows.select(F.col("id").alias("b"), "look", F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), down - 1)).alias("i"), F.pmod(F.xxhash64("id"), across).alias("j"))
    pairs = a.join(b, ["look", "i", "j"]).filter((F.col("raw_a") != F.col("raw_b")) & (F.col("a") != F.col("b")))
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def look_alike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, class_id, n_links``: every row whose text looks like a different one, with the
    smallest id of its look and the number of rows it looks like but differs from."""
    keyed, sizes = _keyed(df, id_col, text_col)
    rows = keyed.join(broadcast_checked(sizes.select("look")), "look")
    texts = rows.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    looks = texts.groupBy("look").agg(F.sum("n").alias("all"), F.min("first").alias("class_id"), F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    known = texts.join(looks, "look").select("look", "raw", "class_id", (F.col("all") - F.col("n")).alias("n_links"))
    return rows.join(known, ["look", "raw"]).select(F.col("id").alias(id_col), "class_id", "n_links")
