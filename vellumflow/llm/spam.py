"""Pages made of keywords, links, menu or shop entries and tags instead of sentences.

Every line of a page is one of prose, links, menu, shop entry, tags or keywords, judged by
link-text ratio, separator density, missing function words, and top-word and n-gram shares of
the page. A page is spam

* if the lines that are no prose hold more than half of its characters and its share of
  function words is below half the median of its language;
* if it is that short of function words and two of four shares of the whole page are above
  their cuts: repeated lines, separators, the commonest word (of letters) or pair of
  ideographs, and n-grams that repeat others; the last suffices if nearly all do;
* or if nearly all of it is lines that repeat others and advertise.

All cuts come from medians over all pages, so that they are calibrated per language. Languages
are told by script and by votes of stop words over the whole page, not by a label; there is a
bounded number of them. For a script without a list of stop words only the other shares count.

Results for odd input: NULL, empty and blank texts are no spam; equal texts get equal
results; a table without any page gives no rows. Features are computed once, written through
a checkpoint in the shared folder, and read for the medians and for the decision.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.session import cut

#: More than this share of a page's characters, outside prose, makes it spam.
SHARE = 0.5
#: Function words must be rarer than this part of the language's median.
FUNCTION_PART = 0.5
#: The cut of a language is at least this, also where most of its pages are spam.
FUNCTION_FLOOR = 0.1
#: Cuts of the shares of a whole page: times the language's median, at least, at most.
PAGE_CUTS = {"duplicate_lines": (2.0, 0.3, 0.5), "separators": (2.0, 0.08, 0.25), "top_word": (3.0, 0.15, 0.4), "repeats": (2.0, 0.6, 0.8)}
#: Of a page short of function words, n-grams that repeat others may hold this share at most.
REPEATS = 0.9
#: A page of which repeated lines that advertise hold more than this share is spam, sentences or not.
ONE_LINE = 0.8
#: A word or line that occurs less often on a page is not repeated.
REPEATED = 8
#: Function share of a line from which it is prose without a closer look.
PROSE_LINE = 0.06
#: Characters of a line without a stop for each price or button, and of a segment for each keyword.
OFFER, KEYED = 120, 24
#: Without evidence of selling, stuffing needs so many segments.
MIN_SEGMENTS = 4

#: Words of shops and search-engine stuffing.
SELLING = "批发|哪里买|哪里有卖|供应|多少钱|报价|代理|图片|招商|行情|价格|直销|厂家|包邮|优惠|现货|特价|促销|折扣|正品|官网|热卖|加盟|品牌|下单|购买|团购|秒杀|货源|采购|旗舰店|客服|免费|低价|排行榜|怎么样|推荐"
MENU = "首页|登录|注册|返回|联系|更多|下一页|上一页|产品中心|关于我们|网站地图|购物车|Home|Login|Contact|Next|Back|Menu|Products|Startseite|Anmelden|Accueil|Connexion"
BUTTON = re.compile(r"加入购物车|立即购买|收藏|已售\s*\d+|月销\s*\d+|add to cart|buy now|in den Warenkorb|ajouter au panier|sold", re.I)
LATIN_SELLING = frozenset("buy cheap sale price prices order online wholesale best top free discount shop deal deals offer offers kaufen günstig billig preis bestellen angebot rabatt versand acheter prix cher vente soldes promo livraison gratuit commander comprar barato precio oferta купить цена дешево дёшево доставка заказать скидка скидки недорого магазин".split())
#: Characters and words that carry grammar.
FUNCTION_WIDE = frozenset("的了在为与及不等以取至可约含和或者置用经过后每本按起其此该这那是很都也就还而且但若如则并被把将从到对由使得会能要没无所之")
FUNCTION_WORDS = {
    "en": "the of and is are in to with for not be by at from this that it was which an a on as unless per than",
    "de": "der die das und ist sind den von mit wird werden für nicht zu bei auf dem des ein eine etwa vor",
    "fr": "le la les des est sont dans de du et une un ne pas pour à avec être en on doit pendant",
    "es": "el la los las es son del y que se para con una por su más como pero",
    "it": "il lo la gli le è sono di del della che e per con una non si nel",
    "pt": "o a os as é são do da dos das em um uma não para com que se ao",
    "nl": "de het een en van is zijn met wordt voor niet te bij op dat aan",
    "pl": "i w na z do się nie jest to że jak po od dla przez oraz",
    "tr": "ve bir bu için ile da de olarak olan gibi daha çok",
    "ru": "и в не на с что это как по из к для у от за о при же или так его она они был была все",
    "el": "και το της η ο του την τα με για στο στη από που είναι δεν",
}
FUNCTION_LATIN = frozenset(" ".join(FUNCTION_WORDS.values()).split())

_LINK = re.compile(r"\[[^\[\]\n]*\]\([^)\s]+\)|<a\s[^<>]*>[^<]*</a>|(?:https?:)?//[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+", re.I)
_TAGS = re.compile(r"#[^\s#]+")
_PRICE = re.compile(r"[$¢-¥₠-⃀￥￡]\s?\d|\d\s?(?:[$€£₽₴₺₹]|(?:元|円|원|USD|EUR|CHF|GBP|PLN|RUB|руб|грн|zł|kr|TL)(?!\w)|р\.)", re.I)
_SEPARATOR = re.compile(r"[_|/;；、，,·•\s。!！>»：:~\-]+")
_SELLING = re.compile(SELLING)
_MENU = re.compile(MENU)
_FUNCTION = re.compile(f"[{''.join(sorted(FUNCTION_WIDE))}]")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_SIGNS = "_|/;；、，,·•!！>»：:~-#\n"
_STOP = re.compile(r"[。！？]|[.!?](?:\s|$)")

KINDS = ("links", "menu", "shop", "tags", "keywords")
#: Counts of ideographs, function characters and blanks share an integer of 21 bits each.
_BITS, _MASK = 21, (1 << 21) - 1
_MARKS = re.compile(r"[#>￥￡$¢-¥₠-⃀]|//|www\.|\d\s?(?:руб|р\.|грн|zł|kr|TL|元|円|원)")


def _weight_table() -> np.ndarray:
    """What each code point of the basic plane adds to the counts; the last stands for all beyond."""
    table = np.zeros(0x10000, dtype=np.int64)
    table[0x4E00:0xA000] = 1
    for ch in FUNCTION_WIDE:
        table[ord(ch)] += 1 << _BITS
    for ch in " \t\r\u3000\u00a0\n":
        table[ord(ch)] += 1 << 2 * _BITS
    return table


_WEIGHTS = _weight_table()
_IS_SIGN = np.zeros(0x10000, dtype=bool)
_IS_SIGN[[ord(ch) for ch in _SIGNS]] = True


def _latin_shares(words: list[str]) -> tuple[int, int]:
    return sum(map(FUNCTION_LATIN.__contains__, words)), len(words)


def _top_pair(codes: np.ndarray, wide: int) -> float:
    """Share of the ideographs that the commonest pair of them holds, 0 if it is not repeated."""
    if wide < 2 * REPEATED:
        return 0.0
    weights = _WEIGHTS[np.minimum(codes, 0xFFFF)]
    plain = weights == 1
    at = np.flatnonzero(plain[:-1] & plain[1:])
    if len(at) < REPEATED:
        return 0.0
    pairs = np.sort(codes[at].astype(np.int64) << 16 | codes[at + 1])
    most = int(np.diff(np.flatnonzero(np.diff(pairs, prepend=-1, append=-1))).max())
    return min(1.0, 2 * most / wide) if most >= REPEATED else 0.0


def _top_word(words: Counter) -> float:
    """Share of the words that the commonest one without grammar holds, 0 if it is not repeated."""
    most = max((n for w, n in words.items() if len(w) > 1 and w not in FUNCTION_LATIN), default=0)
    return most / words.total() if most >= REPEATED else 0.0


def _repeats(codes: np.ndarray) -> tuple[int, int]:
    """Number of quadruples of ideographs that follow each other, whatever parts them, and of
    those that repeat another one."""
    wide = codes[(codes >= 0x4E00) & (codes < 0xA000)].astype(np.uint64)
    n = len(wide) - 3
    if n < 1:
        return 0, 0
    four = wide[:n] << np.uint64(48) | wide[1 : n + 1] << np.uint64(32) | wide[2 : n + 2] << np.uint64(16) | wide[3:]
    return n, n - len(np.unique(four))


#: The languages of a stop word.
_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _VOTES[_word] = (*_VOTES.get(_word, ()), _lang)
#: Scripts that are told by the first letter of a word, each with its first and last letter.
SCRIPTS = (("greek", "Ͱ", "Ͽ"), ("cyrillic", "Ѐ", "ԯ"), ("hebrew", "֐", "׿"), ("arabic", "؀", "ۿ"), ("devanagari", "ऀ", "ॿ"), ("thai", "฀", "๿"), ("kana", "぀", "ヿ"), ("hangul", "가", "힣"))


def language(low: Counter) -> str:
    """Vote of the stop words among all words of a page, else its commonest script."""
    if not low:
        return "other"
    votes = dict.fromkeys(FUNCTION_WORDS, 0)
    for word in _VOTES.keys() & low.keys():
        for lang in _VOTES[word]:
            votes[lang] += low[word]
    best = max(votes, key=votes.get)
    if votes[best]:
        return best
    scripts = Counter()
    for word, n in low.items():
        scripts[next((name for name, first, last in SCRIPTS if first <= word[0] <= last), "latin")] += n
    return scripts.most_common(1)[0][0]


def _line_kind(line: str, wide: int, share: float, stuffed: frozenset[str]) -> str | None:
    links = _LINK.findall(line)
    if links:
        rest = _LINK.sub(" ", line)
        if len(re.sub(r"[\W_]+", "", rest)) <= 14 * len(links) and not (len(links) == 1 and len(_STOP.findall(rest)) > 2):
            return "links"
    if line.count(">") >= 2 and not _STOP.search(line):
        return "menu"
    offers = max(len(_PRICE.findall(line)), len(BUTTON.findall(line)))
    if offers and len(line) <= OFFER * offers and not _STOP.search(line):
        return "shop"
    tags = _TAGS.findall(line)
    if len(tags) >= 3 and sum(map(len, tags)) * 2 > len(line):
        return "tags"
    if share >= PROSE_LINE:
        return None
    if wide * 3 >= len(line):
        segments = [s for s in _SEPARATOR.split(line) if s]
        if not segments:
            return None
        keyed = plain = 0
        for s in segments:
            if _DIGIT.search(s) or len(_FUNCTION.findall(s)) > 1:
                continue
            if len(_SELLING.findall(s)) * KEYED >= len(s) or _MENU.fullmatch(s):
                keyed += len(s)
            elif sum(s[i : i + 3] in stuffed for i in range(max(1, len(s) - 2))) * KEYED >= len(s):
                plain += len(s)
        total = sum(map(len, segments))
        if (keyed + plain) * 2 > total and (keyed or len(segments) >= MIN_SEGMENTS or len(stuffed) > 0):
            return "keywords"
        return None
    words = [w.lower() for w in _WORD.findall(line)]
    if len(words) >= 6 and sum(w in LATIN_SELLING for w in words) * 8 >= len(words):
        return "keywords"
    if len(words) >= 12 and Counter(words).most_common(1)[0][1] * 4 >= len(words):
        return "keywords"
    return None


def _advertises(line: str) -> bool:
    """Whether a line holds a word of selling, a price, a button or a link."""
    return any(p.search(line) for p in (_SELLING, _PRICE, BUTTON, _LINK)) or not LATIN_SELLING.isdisjoint(_WORD.findall(line.lower()))


def _stuffed(text: str) -> frozenset[str]:
    """Three-character words that begin or end a large part of the page's short segments."""
    segments = [s for s in _SEPARATOR.split(text) if len(s) >= 2 and "一" <= s[0] <= "鿿"]
    if len(segments) < 2 * MIN_SEGMENTS:
        return frozenset()
    grams = Counter()
    for s, times in Counter(segments).items():
        for gram in {s[i : i + 3] for i in range(len(s) - 2)}:
            grams[gram] += times
    least = max(MIN_SEGMENTS, len(segments) * 0.15)
    return frozenset(g for g, n in grams.items() if n >= least and not _FUNCTION.search(g))


def features(text: str | None) -> dict:
    """Shares by which a page is judged; all 0 for a page without text."""
    out = {"lang": "other", "n": 0, "function_share": 0.0, "duplicate_lines": 0.0, "separators": 0.0, "top_word": 0.0, "repeats": 0.0, "advertised": 0.0} | {k: 0.0 for k in KINDS}
    if not text or text.isspace():
        return out
    lines = text.split("\n")
    codes = np.frombuffer((text + "\n").encode("utf-32-le"), dtype=np.uint32)
    starts = np.zeros(len(lines), dtype=np.int64)
    np.cumsum([len(line) + 1 for line in lines[:-1]], out=starts[1:])
    weights = _WEIGHTS[np.minimum(codes, 0xFFFF)]
    if len(text) < _MASK:
        counts = np.add.reduceat(weights, starts)
        wide, function, spaces = counts & _MASK, counts >> _BITS & _MASK, counts >> 2 * _BITS
    else:
        wide, function, spaces = (np.add.reduceat(weights >> shift & _MASK, starts) for shift in (0, _BITS, 2 * _BITS))
    length = np.diff(starts, append=len(codes)) - spaces
    n = int(length.sum())
    ideographic = wide * 3 >= length
    marked = _MARKS.search(text) is not None
    look = (length > 0) & (~ideographic | (function < PROSE_LINE * wide) | marked)
    units, grammar = int((wide * ideographic).sum()), int((function * ideographic).sum())
    suspects, words, runs = [], Counter(), []
    for k in np.flatnonzero(look).tolist():
        line = lines[k].strip()
        if ideographic[k]:
            f, u = int(function[k]), int(wide[k])
        else:
            own = _WORD.findall(line.lower())
            words.update(own)
            runs += own
            f, u = _latin_shares(own)
            grammar, units = grammar + f, units + u
        share = f / max(u, 1)
        if share < PROSE_LINE or marked and _MARKS.search(line):
            suspects.append((line, int(wide[k]), share))
    kinds: Counter = Counter()
    if suspects:
        stuffed = _stuffed("\n".join(s[0] for s in suspects))
        for line, w, share in suspects:
            kind = _line_kind(line, w, share, stuffed)
            if kind:
                kinds[kind] += len(line) - len(re.findall(r"\s", line))
    repeated = advertised = 0
    if len(lines) > 2:
        for line, k in Counter(lines).items():
            if k > 1:
                size = len(line) - sum(map(str.isspace, line))
                repeated += size * (k - 1)
                advertised += size * k if _advertises(line) else 0
    ideographs, kana = int(wide.sum()), int(((codes >= 0x3040) & (codes < 0x3100)).sum())
    lang = "kana" if kana and kana * 2 >= ideographs and (kana + ideographs) * 3 >= n else "zh" if ideographs * 3 >= n else language(words)
    out |= {"lang": lang, "n": n, "function_share": grammar / max(units, 1)}
    quads, again = _repeats(codes)
    triples = max(0, len(runs) - 2)
    if quads + triples >= 3 * REPEATED:
        out["repeats"] = (again + triples - len(set(zip(runs, runs[1:], runs[2:])))) / (quads + triples)
    out |= {"duplicate_lines": repeated / max(n, 1), "advertised": advertised / max(n, 1), "top_word": _top_pair(codes, ideographs) if out["lang"] == "zh" else _top_word(words)}
    out |= {"separators": int(_IS_SIGN[np.minimum(codes, 0xFFFF)].sum() - 1) / max(n, 1)}
    return out | {k: kinds[k] / max(n, 1) for k in KINDS}


def page_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = list(features(None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[c] for r in rows], pa.string() if c == "lang" else pa.int64() if c == "n" else pa.float64()) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    schema = ", ".join(f"{c} {'string' if c == 'lang' else 'bigint' if c == 'n' else 'double'}" for c in names)
    return source.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def find_spam(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the features, the language's cuts and ``spam`` of every row."""
    pages = cut(page_features(df, id_col, text_col))
    other = sum(F.col(k) for k in KINDS)
    page_cuts = [F.least(F.greatest(F.percentile_approx(c, 0.5) * times, F.lit(least)), F.lit(most)).alias(f"{c}_cut") for c, (times, least, most) in PAGE_CUTS.items()]
    cuts = pages.filter("n > 0").groupBy("lang").agg(F.greatest(F.percentile_approx("function_share", 0.5) * FUNCTION_PART, F.lit(FUNCTION_FLOOR)).alias("function_cut"), *page_cuts)
    judged = pages.join(F.broadcast(cuts), "lang", "left").withColumn("other_share", other)  # a handful of languages
    short = F.col("function_share") <= F.col("function_cut")
    unlisted = ~F.col("lang").isin("zh", *FUNCTION_WORDS)
    spam = (F.col("other_share") > SHARE) & (short | unlisted | (F.col("links") + F.col("shop") + F.col("menu") > SHARE))
    above = sum((F.col(c) > F.col(f"{c}_cut")).cast("int") for c in PAGE_CUTS)
    stuffed = short & (F.greatest("top_word", "repeats") > 0) & ((above >= 2) | (F.col("repeats") > REPEATS))
    return judged.withColumn("spam", F.coalesce(spam | stuffed | (F.least("duplicate_lines", "advertised") > ONE_LINE), F.lit(False)))
