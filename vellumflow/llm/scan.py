"""Repair of text from scanned pages: broken lines, misread characters, headings, page numbers.

Two passes. The first counts, over all texts, neighbouring characters, triples of them, words
of letters and cited titles; what holds at least a fixed share of the corpus forms the
frequency lexicon, whose size is therefore bounded by the inverse of that share, whatever the
corpus; words that look like another word are kept besides, with their exact counts. The
second runs every text past the lexicon:

* lines that are nothing but a page number or a volume title (also elided or spaced, beside
  a part or a name) are taken out, and decorated page numbers and barred titles at the ends of
  a line; a title inside a citation stays;
* a line end is broken if it parts a hyphenated or plain word, or two ideographs that the
  lexicon knows as neighbours; rows of lists and tables end between characters it does not;
* misread characters: a symmetric-delete index over the lexicon gives the candidates. A pair of
  neighbours is found by what is left when one of its characters is deleted, a word by its look
  (letters and groups that are read for one another, rn and m, c and e, have one form on both
  sides) and by its look without one letter. A weighted edit distance, cheap for confusion
  pairs, the pair counts on both sides (for words those of neighbouring words) and the ratio of
  counts pick the repair. Letters inside numbers and digits inside words are told by their
  neighbours.

Confusion pairs of ideographs come from a fixed table and from the corpus: triples are joined
with the commonest triple of the same deletion (the outer characters), and a character that is
rare beside its counterpart, and of whose occurrences most are explained by it in different
neighbourhoods, is taken for a misreading of it.

Repairs are made on a view of the text in its canonical form, whose characters know their
places in the text; only the repaired spans are spliced in, the rest stays as it was stored.

Results for odd input: NULL stays NULL and has no noise; an empty text stays empty; a text
longer than any page is handled as a whole; equal texts get equal results; an empty table
gives an empty lexicon, with which only noise that needs no lexicon is found.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.session import broadcast_checked, cut

from .visual import aligned, canonical

NOISE = ("broken_line", "misread", "running_header", "page_number")
#: Least share of all pairs, words and citations that an entry of the lexicon holds.
PAIR_SHARE, WORD_SHARE, TITLE_SHARE = 5e-7, 5e-6, 5e-3
#: Keys that a task counts before it hands its partial counts on.
HELD_KEYS = 500_000
#: Least count besides the share.
LEAST = 3
#: The corrected reading must be so many times as likely by the pairs on its two sides.
FACTOR = 20.0
#: A character or word this rare beside its counterpart is wrong where the context is unknown.
RARE = 0.04
#: Cost of a substitution by a confusion pair, by a letter of similar shape, and of any other
#: edit, which is more than a misreading may cost: missing and doubled characters are none.
CONFUSED, SIMILAR, EDIT = 0.3, 0.6, 9.0
#: Least count of a triple that explains others; how much of a character's occurrences must be
#: explained, with how many different characters on either side.
TRIPLE_LEAST, EXPLAINED = 10, ((0.6, 2), (0.3, 3))

#: Characters taken for others of similar shape, each with what was printed.
CONFUSIONS = (
    "顶项 班斑 拄柱 蜂峰 浅残 拭试 童量 未末 眼服 昱显 纷粉 职取 虑滤 侧测 千干 煦照 洪供 柏相 操燥 蜜密 乞气 燕蒸 徽微 剪煎 榕溶 夜液 酞酸 若苦 昧味 申甲 牌脾 吹次 醉醇 臂肾 氷水 邑色 "
    "怯性 剌制 漫浸 签鉴 剐别 杳查 捡检 甪用 伏状 贯贮 洁法 葴藏 沅源 万方 恪格 圭主 采来 跑炮 轻经 现规 舍含 洼注 旧归 外处 竟意 冶治 熊能 唆酸 走定 切功 潜谱 囹图 怔征 持特 纺纹 拈指 "
    "滕藤 时莳 休沐 叮叶 宣萱 惠穗 苄芽 裳棠 萆草 瓴翎 叁参 技枝 很根 喃楠 芏芷 蔡葵 凌菱 徽薇 恋峦 尉蔚 茔茎 杲果 疲皮 擅檀 齐霁 岗岚 降绛 愉榆"
)
#: Letters and signs read for digits, and signs and letters read for letters.
DIGIT_MISREADS = {"O": "0", "o": "0", "l": "1", "I": "1", "Z": "2", "S": "5", "B": "8"}
LETTER_MISREADS = {"0": "o", "1": "l", "!": "i", "c": "e"}
#: Letters and groups of letters of one look, read for one another in words.
SINGLE_LOOKS = ("ce", "il", "Il", "1i", "1l", "!i", "!l", "0o")
GROUP_LOOKS = (("m", "rn"), ("h", "li"), ("d", "cl"), ("w", "vv"))
#: Other letters of similar shape.
SIMILAR_LETTERS = ("tl", "tf", "ft", "lt", "hb", "bh", "nu", "un", "ao", "oa", "vy", "yv", "gq", "qg", "ij", "ji", "rt", "tr", "nh", "hn")
#: Words from this length are looked up by deletions, too.
LONG_WORD = 6
#: All looks brought to one form: after the groups are written out, these letters for those.
_LOOK_FROM, _LOOK_TO = "01!iIe", "ollllc"
#: Words up to this length are repaired only where the words beside them speak for it.
SHORT_WORD = 4
#: Parts of a work that stand in headings.
PARTS = "正文|增补本|增订本|附录|索引|目录|凡例|[一二三四五六七八九十]部|卷[上中下一二三四五六七八九十]|[上中下]卷|[上中下]册|第[一二三四五六七八九十\\d]+[卷册部编章]"
#: Endings of numbers.
UNITS = "mg|ml|mm|cm|nm|kg|μ|g(?![a-z])|m(?![a-z])|l(?![a-z])|mol|%|℃|°|h(?![a-z])"

_TABLE = [(pair[0], pair[1]) for pair in CONFUSIONS.split()]
_SINGLES = frozenset(x for pair in SINGLE_LOOKS for x in (pair, pair[::-1]))
_SIMILAR = frozenset(SIMILAR_LETTERS)
_GROUPS = frozenset(x for one, two in GROUP_LOOKS for x in (one + two, two + one))
_LOOKS = str.maketrans(_LOOK_FROM, _LOOK_TO)
_UNSTABLE = re.compile(r"[^\x00-\x7e°±·À-İĴ-ľŁ-ňŊ-žα-θκ-μ—…、。〈-】一-鿿，：；（）！？％～［］℃]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9!]*[A-Za-zÀ-ɏ]|[01!][a-zà-ɏ]{4,}")
_NUMBER = re.compile(rf"(?<![A-Za-z0-9.\-μ素族型])(?=[OolIZSB.]*[0-9])(?=[0-9.]*[OolIZSB])[0-9OolIZSB][0-9OolIZSB.]*(?=[^A-Za-z0-9型]|$|{UNITS})|(?<=[0-9]-)[0-9]+[OolIZSB][0-9OolIZSB]*(?=[^A-Za-z0-9]|$)|(?<=-)(?=[OolIZSB]*[0-9]{{3}})(?=[0-9]*[OolIZSB])[0-9OolIZSB]{{5,}}(?=[^A-Za-z0-9]|$)")
_LONE = re.compile(r"(?<![A-Za-z0-9μ.])[OolIZSB](?=(?:mg|ml|mm|cm|nm|kg|g|μ[a-z]|%)(?![A-Za-z]))")
_IN_WORD = re.compile(r"(?<=[a-zà-ɏ])[01!]+(?=[a-zà-ɏ])|(?<![A-Za-zÀ-ɏ0-9.\-])[01!](?=[a-zà-ɏ]{4,})|(?<=[a-zà-ɏ]{4})[01](?![A-Za-z0-9])")
_D = "[0-9OolIZSB]"
_PAGE = re.compile(
    rf"{_D}{{2,4}}|/{{1,3}}\s*{_D}{{2,4}}\s*/{{0,3}}|[\[(（【]\s*{_D}{{2,4}}\s*[\])）】]|[·•]\s*{_D}{{1,4}}\s*[·•]|[—–\-~]+\s*{_D}{{1,4}}\s*[—–\-~]+|(?:p|pp|P|S)\.\s*{_D}{{1,4}}|(?:[Pp]age|Seite|PAGE)\s*{_D}{{1,4}}|第\s*(?:{_D}{{1,4}}|[一二三四五六七八九〇零十百千]{{1,6}})\s*[页頁]|[一二三四五六七八九〇零十百千]{{2,5}}|{_D}{{2,4}}\s*/\s*{_D}{{2,4}}"
)
_EDGE_PAGE = re.compile(r"^(?:\d{2,4}[\s|]+)(?=\S)|(?<=\S)(?:[\s|·•]+|\.{2,}|…+)\d{2,4}$")
_MARK = rf"(?:[—–]+\s*{_D}{{1,4}}\s*[—–]+|第\s*\d{{1,4}}\s*[页頁]|/{{1,3}}\s*{_D}{{2,4}}\s*/{{1,3}}|·\s*{_D}{{1,4}}\s*·)"
#: Page numbers at the ends of a line of sentences: decorated at one end, or plain at both.
_AT_ENDS = re.compile(rf"^\s*({_MARK}\s+)(?=[^\W\d])|(?<=[。！？])(\s+{_MARK})\s*$")
_BOTH_ENDS = re.compile(r"^\s*(\d{2,4}\s+)(?=[^\W\d_]).*[。！？](\s+\d{2,4})\s*$")
#: What a line begins or ends with that has a page number at an end.
_EDGES = frozenset("0123456789OolIZSB—–第页頁/·")
_HYPHEN = "-¬‐\xad"
_END = "。！？!?;；:："


def _wide(ch: str) -> bool:
    return "一" <= ch <= "鿿"


def _class_table() -> np.ndarray:
    """Ideographs as they are; digits, letters and punctuation as one sign each; blanks as 0."""
    table = np.full(0x10000, ord("."), dtype=np.uint32)
    table[0x4E00:0xA000] = np.arange(0x4E00, 0xA000)
    for first, last, sign in ((0x30, 0x39, "0"), (0xFF10, 0xFF19, "0"), (0x41, 0x5A, "a"), (0x61, 0x7A, "a"), (0xC0, 0x24F, "a"), (0xFF21, 0xFF5A, "a")):
        table[first : last + 1] = ord(sign)
    table[[0x20, 0x09, 0x0D, 0x3000, 0xA0]] = 0
    table[0x0A] = 1
    return table


_CLASSES = _class_table()


def _sign(ch: str) -> int:
    return int(_CLASSES[min(ord(ch), 0xFFFF)])


def pair_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours of which one is an ideograph (left << 16 | right) and their counts."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
    signs = _CLASSES[np.minimum(codes, 0xFFFF)]
    signs = signs[signs != 0].astype(np.int64)
    left, right = signs[:-1], signs[1:]
    kept = ((left >= 0x4E00) | (right >= 0x4E00)) & (left > 1) & (right > 1)
    return np.unique(left[kept] << 16 | right[kept], return_counts=True)


def triple_counts(texts: list[str]) -> Counter:
    """Triples of neighbours whose middle is an ideograph, as strings, and their counts."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
    signs = _CLASSES[np.minimum(codes, 0xFFFF)]
    signs = signs[signs != 0].astype(np.int64)
    kept = np.flatnonzero(signs[1:-1] >= 0x4E00)
    keys, n = np.unique(signs[kept] << 32 | signs[kept + 1] << 16 | signs[kept + 2], return_counts=True)
    flat = np.stack([keys >> 32, keys >> 16 & 0xFFFF, keys & 0xFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
    return Counter(dict(zip((flat[i : i + 3] for i in range(0, len(flat), 3)), n.tolist())))


def look(word: str) -> str:
    """The form that a word has in common with all its misreadings: the groups of letters that
    are read for one another are the same on both sides, in the lexicon and in the text."""
    for one, two in GROUP_LOOKS:
        word = word.replace(one, two)
    return word.translate(_LOOKS)


def look_column(word: Column) -> Column:
    for one, two in GROUP_LOOKS:
        word = F.replace(word, F.lit(one), F.lit(two))
    return F.translate(word, _LOOK_FROM, _LOOK_TO)


class Deletions:
    """Symmetric-delete index: entries found by what is left of them without one character.

    Pairs of neighbours with an ideograph: under the character that stays, by its side, stand
    the ideographs that complete a pair. Ideographs by themselves: nothing stays of them. Words of letters: under their look and, if they are
    long, under their look without one letter.
    """

    def __init__(self, pairs: Iterable[int], words: Iterable[str]):
        after, before, by_look = defaultdict(list), defaultdict(list), defaultdict(list)
        for pair in pairs:
            left, right = pair >> 16, pair & 0xFFFF
            if right >= 0x4E00:
                after[left].append(chr(right))
            if left >= 0x4E00:
                before[right].append(chr(left))
        for word in words:
            for key in self.keys(word):
                by_look[key].append(word)
        self.after = {k: frozenset(v) for k, v in after.items()}
        self.before = {k: frozenset(v) for k, v in before.items()}
        self.single = frozenset().union(*self.after.values(), *self.before.values())
        self.by_look = dict(by_look)

    @staticmethod
    def keys(word: str) -> set[str]:
        form = look(word)
        return {form, *(form[:i] + form[i + 1 :] for i in range(len(form)))} if len(word) >= LONG_WORD else {form}

    def completes(self, ch: str, left: int, rights: list[int]) -> bool:
        """Whether ``ch`` stands in a pair after ``left`` or before one of ``rights``."""
        return ch in self.after.get(left, ()) or any(ch in self.before.get(right, ()) for right in rights)

    def words(self, word: str) -> list[str]:
        return list(dict.fromkeys(x for key in self.keys(word) for x in self.by_look.get(key, ()) if x != word))


class Lexicon:
    """Frequent pairs, single ideographs, words and titles of a corpus; words that look alike,
    however rare, and the pairs of words that tell them apart; confusion pairs of ideographs.

    ``floor`` is the count below which a word may be missing."""

    def __init__(self, pairs: dict[int, int], words: dict[str, int], titles: list[str], phrases: dict[str, int] | None = None, learned: Iterable[tuple[str, str]] = (), floor: float = LEAST, table: Iterable[tuple[str, str]] = _TABLE):
        self.pairs, self.words, self.titles, self.phrases, self.floor = pairs, words, titles, phrases or {}, floor
        self.single: Counter = Counter()
        for pair, n in pairs.items():
            self.single[pair >> 16] += n
        self.index = Deletions(pairs, [w for w, n in words.items() if n >= LEAST])
        self.options: dict[str, list[str]] = defaultdict(list)
        for read, printed in dict.fromkeys([*table, *learned]):
            self.options[read].append(printed)
        self.suspect = re.compile(f"[{''.join(self.options)}]") if self.options else re.compile(r"(?!)")
        spaced = [r"\s*".join(map(re.escape, t)) for t in titles]
        elided = [f"{re.escape(t[:2])}(?:\\.{{2,}}|…+){re.escape(t[-2:])}" for t in titles if len(t) >= 5]
        self.title = re.compile("|".join(spaced + elided)) if titles else None
        if titles:
            name = f"(?:{self.title.pattern})(?:[ \t·]*(?:{PARTS}))?"
            self.barred = re.compile(rf"^\s*((?:(?:{PARTS})[ \t·]*)?{name}\s*[|｜]\s*)(?=[^\W\d])|(?<=[。！？])(\s*[|｜]\s*{name})\s*$")
        self.known: dict[str, tuple[str, ...]] = {}

    def pair(self, left: int, right: int) -> int:
        return self.pairs.get(left << 16 | right, 0)

    def misread(self, read: str, left: int, rights: list[int]) -> str | None:
        """The ideograph that was misread as ``read`` after ``left`` and before one of ``rights``
        (which may be misread themselves), or None. Candidates come from the index; if no pair
        is completed by any of them, the single characters tell."""
        code = ord(read)
        l0, r0 = self.pair(left, code), max(self.pair(code, x) for x in rights)
        best = (0.0, None)
        for printed in self.options[read]:
            other = ord(printed)
            if self.index.completes(printed, left, rights):
                l1, r1 = self.pair(left, other), max(self.pair(other, x) for x in rights)
                gain = (l1 + 0.5) * (r1 + 0.5) / ((l0 + 0.5) * (r0 + 0.5))
                wrong = gain >= FACTOR
            else:
                wrong = printed in self.index.single and not l0 and not r0 and self.single[code] < RARE * self.single[other]
                gain = 1.0
            if wrong:
                best = max(best, (gain, printed), key=lambda x: x[0])
        return best[1]

    def printed(self, word: str) -> tuple[str, ...]:
        """Words of the lexicon that may have been misread as ``word``."""
        known = self.known.get(word)
        if known is None:
            most = CONFUSED * max(3, len(word) // 2)
            known = tuple(x for x in self.index.words(word) if weighted_distance(word, x) <= most + 1e-9)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = known
        return known

    def word(self, word: str, left: str = "", right: str = "", least: int = LEAST) -> str:
        """The word of the lexicon that was misread as ``word`` between its neighbours, else
        ``word``. A misread form may be in the lexicon itself, so a word is told by the pairs
        with its neighbours and by its count beside the other's, unless it is below ``least``."""
        best = (0.0, 0.0, 0, word)
        if alike := self.printed(word):
            form = look(word)
            after = [right, *self.printed(right)] if right else []  # it may be misread too
            l0, r0 = self.phrase([left], [word]), self.phrase([word], after)
            for other in alike:
                same = look(other) == form
                n = self.words.get(word, 0 if same else int(self.floor))
                l1, r1 = self.phrase([left], [other]), self.phrase([other], after)
                gain = (l1 + 0.5) * (r1 + 0.5) / ((l0 + 0.5) * (r0 + 0.5))
                rare = len(word) > SHORT_WORD and n < max(least if same else 0, RARE * self.words[other])
                if (gain >= FACTOR and same or rare and n < self.words[other]) and l1 >= l0 and r1 >= r0:
                    best = max(best, (gain, -weighted_distance(word, other), self.words[other], other))
        return best[3]

    def phrase(self, left: list[str], right: list[str]) -> int:
        return max((self.phrases.get(f"{a} {b}", 0) for a in left for b in right if a and b), default=0)


def weighted_distance(read: str, printed: str) -> float:
    """Edit distance in which misreading a letter or a group of letters is cheap."""
    before: list[float] = []
    row = [j * EDIT for j in range(len(printed) + 1)]
    for i, a in enumerate(read, 1):
        above, row = row, [i * EDIT]
        for j, b in enumerate(printed, 1):
            cost = 0.0 if a == b else CONFUSED if a + b in _SINGLES else SIMILAR if a + b in _SIMILAR else EDIT
            least = min(above[j - 1] + cost, above[j] + EDIT, row[j - 1] + EDIT)
            if i > 1 and read[i - 2 : i] + b in _GROUPS:
                least = min(least, before[j - 1] + CONFUSED)
            if j > 1 and a + printed[j - 2 : j] in _GROUPS:
                least = min(least, above[j - 2] + CONFUSED)
            row.append(least)
        before = above
    return row[-1]


def words_of(text: str) -> Iterator[tuple[re.Match, str]]:
    """Words of letters, each with the word before it if only blanks part them, else ''."""
    end, before = -1, ""
    for m in _LATIN.finditer(text):
        yield m, before if end >= 0 and not text[end : m.start()].strip() else ""
        end, before = m.end(), m.group()


def count_texts(df: DataFrame, text_col: str) -> DataFrame:
    """``kind, key, n``: counts of pairs, triples, words, pairs of words and titles, pre-aggregated per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {"pair": Counter(), "triple": Counter(), "word": Counter(), "phrase": Counter(), "title": Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, counts in held.items():
                items = list(counts.items())
                for a in range(0, len(items), 50_000):
                    key, n = zip(*items[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(key)), pa.array(map(str, key), pa.string()), pa.array(n, pa.int64())], ["kind", "key", "n"])
                counts.clear()

        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            if not texts:
                continue
            for key, n in zip(*(a.tolist() for a in pair_counts(texts))):
                held["pair"][key] += n
            held["triple"].update(triple_counts(texts))
            for text in texts:
                for m, before in words_of(text):
                    held["word"][m.group()] += 1
                    if before:
                        held["phrase"][f"{before} {m.group()}"] += 1
                if "《" in text:
                    held["title"].update(re.findall(r"《([^《》\n]{4,20})》", text))
            if sum(map(len, held.values())) > HELD_KEYS:
                yield from flush()
        yield from flush()

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Held:
    """A lexicon on its way to the workers: its parts, sent to each executor once, and a key
    under which a worker process keeps what it has built of them."""

    parts: Broadcast
    key: str

    def lexicon(self) -> Lexicon:
        if _BUILT.get("key") != self.key:
            _BUILT.update(key=self.key, lexicon=Lexicon(**self.parts.value))
        return _BUILT["lexicon"]


_BUILT: dict = {}


def build_lexicon(df: DataFrame, text_col: str, table: Iterable[tuple[str, str]] = _TABLE) -> Held:
    """The lexicon of all texts: at most ``1 / share`` entries of each kind reach the driver, and
    besides them all words that look like another one, whatever their count, and the confusion
    pairs, of which a character has at most three."""
    counts = cut(count_texts(df, text_col))
    totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = {k: max(LEAST, share * totals.get(k, 0)) for k, share in (("pair", PAIR_SHARE), ("word", WORD_SHARE), ("title", TITLE_SHARE))}
    kept = counts.filter(" OR ".join(f"kind = '{k}' AND n >= {n}" for k, n in least.items()))
    by: dict[str, dict[str, int]] = defaultdict(dict)
    for kind, key, n in zip(*(c.to_pylist() for c in kept.unionByName(alike_words(counts)).toArrow().columns)):
        by[kind][key] = n
    learned = [(r["read"], r["printed"]) for r in confusions(counts).collect() if not _traditional(r["read"], r["printed"])]
    parts = {"pairs": {int(k): n for k, n in by["pair"].items()}, "words": by["word"], "titles": sorted(t for t in by["title"] if all(map(_wide, t))), "phrases": by["phrase"], "learned": sorted(learned), "floor": least["word"], "table": list(table)}
    return Held(df.sparkSession.sparkContext.broadcast(parts), uuid.uuid4().hex)


def _traditional(read: str, printed: str) -> bool:
    """Whether a character outside the simplified character set stands for one inside it; then
    it may be its traditional form, which is no misreading."""
    return bool(printed.encode("gb2312", "ignore")) and not read.encode("gb2312", "ignore")


def confusions(counts: DataFrame) -> DataFrame:
    """``read, printed, share, sides``: ideographs whose occurrences are mostly explained as
    misreadings of another one, with different characters on both sides: a misreading does not
    depend on what stands beside it, a rare word does. A triple is explained by the commonest triple that is the same
    without the middle character (one row per deletion, so no pairs are written out)."""
    triples = counts.filter("kind = 'triple'").select(F.substring("key", 1, 1).alias("l"), F.substring("key", 2, 1).alias("read"), F.substring("key", 3, 1).alias("r"), "n")
    lead = triples.filter(F.col("n") >= TRIPLE_LEAST).groupBy("l", "r").agg(F.max(F.struct("n", F.col("read").alias("printed"))).alias("lead"))
    explained = triples.join(lead, ["l", "r"]).filter((F.col("lead.printed") != F.col("read")) & (F.col("lead.n") >= FACTOR * F.col("n")))
    explained = explained.groupBy("read", F.col("lead.printed").alias("printed")).agg(F.sum("n").alias("n"), F.least(F.count_distinct("l"), F.count_distinct("r")).alias("sides"))
    single = triples.groupBy("read").agg(F.sum("n").alias("all"))  # one row per ideograph
    found = explained.join(single, "read").join(single.select(F.col("read").alias("printed"), F.col("all").alias("all_printed")), "printed")
    share = F.col("n") / F.col("all")
    enough = reduce(Column.__or__, [(share >= least) & (F.col("sides") >= sides) for least, sides in EXPLAINED])
    return found.filter((F.col("all") < RARE * F.col("all_printed")) & enough).select("read", "printed", share.alias("share"), "sides")


def alike_words(counts: DataFrame) -> DataFrame:
    """``kind, key, n``: words of which another one has the look, one of them not rare; and the
    pairs of words that are needed where two of them are not rare, or short."""
    words = counts.filter("kind = 'word'").groupBy(look_column(F.col("key")).alias("look")).agg(F.collect_list(F.struct("key", "n")).alias("w"))
    often = F.size(F.filter("w", lambda x: x["n"] >= LEAST))
    short = F.exists("w", lambda x: F.length(x["key"]) <= SHORT_WORD)
    alike = words.filter((F.size("w") > 1) & (often > 0)).select(F.explode("w").alias("w"), ((often > 1) | short).alias("open")).select("w.key", "w.n", "open")
    asked = broadcast_checked(alike.filter("open").select(F.col("key").alias("asked")))
    phrases = counts.filter(f"kind = 'phrase' AND n >= {LEAST}")
    sides = [phrases.join(asked, F.substring_index("key", " ", k) == F.col("asked"), "left_semi") for k in (1, -1)]
    return alike.select(F.lit("word").alias("kind"), "key", "n").unionByName(sides[0]).unionByName(sides[1])


def _is_page(line: str) -> bool:
    return _PAGE.fullmatch(line) is not None


_HEAD_REST = re.compile(rf"[\s|·•.\[\]【】()（）\-—]|{PARTS}")


def _is_header(line: str, lexicon: Lexicon) -> bool:
    if lexicon.title is None:
        return False
    found = lexicon.title.search(line)
    if not found or line[: found.start()].rstrip().endswith("《") or line[found.end() :].lstrip().startswith("》"):
        return False
    rest = _HEAD_REST.sub("", line[: found.start()] + " " + line[found.end() :])
    rest = re.sub(r"\d{1,4}", "", rest)
    return len(rest) <= 14 and not re.search(r"[。，,;；!！?？]", rest)


Edit = tuple[int, int, str]


class Draft:
    """A text under repair whose characters know their places in the text that it began as."""

    def __init__(self, text: str):
        self.text, self.places = text, None

    def apply(self, edits: list[Edit]) -> bool:
        """Replace spans, given from left to right, by texts."""
        if not edits:
            return False
        if self.places is None:
            self.places = list(range(len(self.text)))
        parts, places, end = [], [], 0
        for a, b, new in edits:
            parts += [self.text[end:a], new]
            places += self.places[end:a]
            places += [-1] * len(new)
            end = b
        self.text = "".join(parts) + self.text[end:]
        self.places = places + self.places[end:]
        return True

    def spliced(self, source: str, starts: list[int]) -> str:
        """``source`` with the repaired spans; ``starts`` are the places in it of the first text."""
        parts, k, n = [], 0, len(self.text)
        while k < n:
            first, to = self.places[k], k + 1
            while to < n and self.places[to] == (first + to - k if first >= 0 else -1):
                to += 1
            parts.append(source[starts[first] : starts[first + to - k]] if first >= 0 else self.text[k:to])
            k = to
        return "".join(parts)


def _correct(draft: Draft, lexicon: Lexicon) -> bool:
    """Replace misread characters; tells whether there were any."""
    text, edits = draft.text, []
    out = None
    for m in lexicon.suspect.finditer(text):
        at = m.start()
        a, c = at - 1, at + 1
        while a >= 0 and text[a] in " \t\r　":
            a -= 1
        while c < len(text) and text[c] in " \t\r　":
            c += 1
        left = 1 if a < 0 else _sign(out[a] if out else text[a])
        after = [1] if c >= len(text) else [_sign(text[c]), *map(ord, lexicon.options.get(text[c], ()))]  # it may be misread too
        printed = lexicon.misread(m.group(), left, after)
        if printed:
            out = out or list(text)
            out[at] = printed
            edits.append((at, at + 1, printed))
    changed = draft.apply(edits)
    for pattern, table in ((_NUMBER, DIGIT_MISREADS), (_LONE, DIGIT_MISREADS), (_IN_WORD, LETTER_MISREADS)):
        changed |= draft.apply([(k, k + 1, table[ch]) for m in pattern.finditer(draft.text) for k, ch in enumerate(m.group(), m.start()) if ch in table])
    return draft.apply(_word_edits(draft.text, lexicon)) or changed


def _word_edits(text: str, lexicon: Lexicon, least: int = LEAST) -> list[Edit]:
    """Misread words of letters, from left to right."""
    if not lexicon.index.by_look:
        return []
    found = list(words_of(text))
    edits, last = [], ""
    for k, (m, before) in enumerate(found):
        word = m.group()
        if lexicon.printed(word):
            follows = found[k + 1] if k + 1 < len(found) else None
            word = lexicon.word(word, last if before else "", follows[0].group() if follows and follows[1] else "", least)
            if word != m.group():
                edits.append((m.start(), m.end(), word))
        last = word
    return edits


def repair(text: str | None, lexicon: Lexicon) -> tuple[str | None, set[str]]:
    """The readable text and the kinds of noise that were in it."""
    if not text:
        return text, set()
    view, starts = text, None
    if _UNSTABLE.search(text):
        view, starts = aligned(text.replace("\xad\n", "-\n").replace("\xad\r\n", "-\r\n"))
    draft, noise = Draft(view), set()
    draft.apply(_line_edits(view, lexicon, noise))
    if _correct(draft, lexicon):
        noise.add("misread")
    if not noise:
        return text, noise
    return (draft.spliced(text, starts) if starts else draft.text).strip("\n"), noise


def _line_edits(view: str, lexicon: Lexicon, noise: set[str]) -> list[Edit]:
    """Edits that take out headings and page numbers and join broken lines; adds to ``noise``."""
    edits: list[Edit] = []

    def join(a: int, b: int, glue: str) -> None:
        while edits and edits[-1][0] >= a:
            edits.pop()
        edits.append((a, b, glue))

    current, end, removed, at = "", 0, False, 0
    for raw in view.split("\n"):
        start, at = at, at + len(raw) + 1
        raw = raw.rstrip("\r")
        line = raw.strip(" \t　\r")
        if line and _is_page(line):
            noise.add("page_number")
            removed = True
            edits.append((start, min(at, len(view)), ""))
            continue
        if line and _is_header(line, lexicon):
            noise.add("running_header")
            if re.search(r"(?:^|[\s|])\d{2,4}(?:$|[\s|])", line):
                noise.add("page_number")
            removed = True
            edits.append((start, min(at, len(view)), ""))
            continue
        edged = line and (line[0] in _EDGES or line[-1] in _EDGES or "|" in line or "｜" in line)
        inside = _edge_edits(raw, start, lexicon, noise) if edged else []
        begin = start + len(raw) - len(raw.lstrip(" \t　\r"))
        if current and line and not inside:
            how = _joint(current, raw, line, lexicon)
            if how is not None:
                if not removed:
                    noise.add("broken_line")
                base = current.rstrip(" \t")
                stop = end - (len(current) - len(base))
                if how == "-":
                    base, stop = base[:-1], stop - 1
                join(stop, begin, "")
                current, end, removed = base + line, begin + len(line), False
                continue
            if removed and current.rstrip()[-1] not in _END:
                glue = "" if _wide(line[0]) or current.endswith(" ") or not line[0].isalnum() else " "
                join(end, begin, glue)
                current, end, removed = current + glue + line, begin + len(line), False
                continue
        edits += inside
        current, end = raw if line else "", start + len(raw)
        removed = removed and not line
    return edits


def _edge_edits(raw: str, start: int, lexicon: Lexicon, noise: set[str]) -> list[Edit]:
    """Edits that take decorated page numbers and barred titles from the ends of a line."""
    spans = set()
    for pattern, kind in ((_AT_ENDS, "page_number"), (_BOTH_ENDS, "page_number"), (lexicon.title and lexicon.barred, "running_header")):
        for m in pattern.finditer(raw) if pattern else ():
            noise.add(kind)
            spans |= {m.span(g) for g in (1, 2) if m.group(g)}
    return [(start + a, start + b, "") for a, b in sorted(spans)]


def _joint(before: str, raw: str, line: str, lexicon: Lexicon) -> str | None:
    """How the line goes on from the one before: '-' over a hyphen, '' without; None if not."""
    end = before.rstrip(" \t")
    if not end:
        return None
    a, b = end[-1], line[0]
    if a in _HYPHEN and len(end) > 1 and end[-2].isalpha() and b.isalpha():
        if _wide(end[-2]) and _wide(b):
            return "-" if lexicon.pair(ord(end[-2]), ord(b)) else None
        return "-" if b.islower() and not _wide(end[-2]) else None
    if _wide(a) and _wide(b):
        if "：" in before and ("：" in line or ":" in line):
            return None
        pairs = lexicon.pair(ord(a), ord(b))
        if not pairs:
            pairs = max((lexicon.pair(ord(x), ord(y)) for x in [a, *lexicon.options.get(a, ())] for y in [b, *lexicon.options.get(b, ())]), default=0)
        return "" if pairs else None
    if before[-1] == a and raw[:1] == b and a.isalpha() and b.isalpha() and not _wide(a) and not _wide(b) and b.islower() and a.islower():
        return ""
    return None


def repair_name(value: str | None, lexicon: Lexicon) -> tuple[str | None, set[str]]:
    """Clean form of a short name or heading, and the kinds of noise that were in it."""
    if not value or not value.strip():
        return value, set()
    text, noise = canonical(value.replace("\xad\n", "-\n")).strip(), set()
    if lexicon.title is not None:
        found = lexicon.title.search(text)
        if found and not text[: found.start()].endswith("《") and len(found.group()) < len(text):
            head = re.compile(rf"(?:(?:{PARTS})\s*[|·\s]\s*)?\[?(?:{lexicon.title.pattern})\]?(?:[\s·]*(?:{PARTS}))?")
            rest = head.sub("\x00", text, count=1)
            rest = re.sub(r"[\s|·]*\x00[\s|·]*", "\x00", rest)
            if rest.strip("\x00"):
                noise.add("running_header")
                text = rest.replace("\x00", " ").strip()
    found = _EDGE_PAGE.search(text)
    if found and re.search(r"[^\W\d_]", text[: found.start()] + text[found.end() :]):
        noise.add("page_number")
        text = (text[: found.start()] + text[found.end() :]).strip()
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    whole = lines[0] if lines else ""
    for line in lines[1:]:
        if _is_page(line):
            noise.add("page_number")
            continue
        noise.add("broken_line")
        if whole[-1] in _HYPHEN and len(whole) > 1:
            whole = whole[:-1]
        latin = not _wide(whole[-1]) and whole[-1].isalnum() and not _wide(line[0]) and line[0].isalnum()
        whole += (" " if latin and line[0].isupper() else "") + line
    clean = _correct_name(whole, lexicon)
    if clean != whole:
        noise.add("misread")
    return (clean, noise) if noise else (value, noise)


def _correct_name(name: str, lexicon: Lexicon) -> str:
    """Names are made of few characters, so a rare character beside its counterpart is wrong
    unless the pairs around it are usual."""
    out = list(name)
    for m in lexicon.suspect.finditer(name):
        at, read = m.start(), ord(m.group())
        left = _sign(name[at - 1]) if at else 1
        right = _sign(name[at + 1]) if at + 1 < len(name) else 1
        l0, r0 = lexicon.pair(left, read), lexicon.pair(read, right)
        best = max(lexicon.options[m.group()], key=lambda p: lexicon.pair(left, ord(p)) + lexicon.pair(ord(p), right))
        known = lexicon.index.completes(best, left, [right])
        l1, r1 = lexicon.pair(left, ord(best)), lexicon.pair(ord(best), right)
        if known and (l1 + 0.5) * (r1 + 0.5) >= FACTOR * (l0 + 0.5) * (r0 + 0.5) or not l0 and not r0 and (known or best in lexicon.index.single and lexicon.single[read] < RARE * lexicon.single[ord(best)]):
            out[at] = best
    draft = Draft("".join(out))
    draft.apply(_word_edits(draft.text, lexicon, 0))  # typed names hold slips that recur and look alike
    return draft.text


def repair_texts(df: DataFrame, id_col: str, text_col: str, lexicon: Held, names: bool = False) -> DataFrame:
    """``id_col, clean, noise`` (array of kinds) of every row; ``names`` for short values."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mend = lexicon.lexicon(), repair_name if names else repair
        for batch in batches:
            clean, noise = [], []
            for text in batch.column(1).to_pylist():
                fixed, kinds = mend(text, known)
                clean.append(fixed)
                noise.append(sorted(kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(noise, pa.list_(pa.string()))], ["id", "clean", "noise"])

    return source.mapInArrow(run, f"id {kind}, clean string, noise array<string>").withColumnRenamed("id", id_col)
