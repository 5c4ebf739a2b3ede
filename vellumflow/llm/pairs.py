"""Defects of prompt and response pairs.

One of ``empty``, ``copied_question``, ``refusal``, ``other_language``, ``truncated`` or
NULL, tested in this order, so that a pair has at most one:

* copied: the response is run through the suffix automaton of the prompt; what is covered by
  long enough matches, introductions and courtesies is taken away, and nothing may be left;
* refusal: trie automata find words of inability, of answering, of the speaker and of the
  request; a sentence refuses if it holds inability and an act of dialogue, or an act of giving
  together with the speaker or the request, or if the speaker is unable in one clause; besides
  refusing sentences and courtesies little may be left. Sentences about what a medicine or a
  patient cannot do are answers;
* other language: scripts (by Unicode block) and stop words vote, all equal winners
  counting; one of them must be the language of the prompt or one the prompt asks for;
* truncated: the answer proper (without source lines and disclaimers) ends in no terminal
  mark, in an open delimiter (a stack) or in a cut table row; complete values, lists, tables
  and blocks of lines that are alike do not.

Results for odd input: a NULL response is ``empty``; with a NULL or empty prompt nothing can
be copied and any one language is right; equal pairs get equal results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "copied_question", "refusal", "other_language", "truncated")
#: A match with the prompt counts from so many characters, for ideographs and for letters.
MATCH_WIDE, MATCH_NARROW = 3, 6
RESULT_CACHE = 50_000

_INVISIBLE = re.compile(r"[­᠎​-‏⁠﻿]")
_MARKUP = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|```\w*|&nbsp;", re.S)
#: What stands for no content, after marks are gone.
PLACEHOLDERS = {"", "na", "null", "none", "nil", "nan", "tbd", "todo", "答", "回答", "答案", "answer", "a", "无", "暂无", "略", "待补充", "无内容", "placeholder", "undefined", "empty", "response", "output", "空", "空白", "暂缺", "待定", "未填写", "无回答", "无答案", "没有内容", "内容为空", "noanswer", "nocontent", "blank", "nodata", "missing", "xxx", "如下", "答案如下", "回答如下", "pending"}
#: Lines after the answer proper.
_TAIL_LINE = re.compile(r"^\s*(?:(?:来源|出处|参考|参考来源|资料来源|引用|数据来源|Sources?|References?|Quelle|See)\s*[:：].*|\[\d+\].*|[*（(]?(?:以上内容|本回答|以上信息|免责声明|温馨提示|This information|For reference|Disclaimer).*)\s*$", re.I)
_OPENER = re.compile(r"^(?:您好|你好|亲|尊敬的用户|根据检索结果|根据资料|抱歉让您久等了|让您久等了|感谢您的提问|感谢提问|不好意思|抱歉|很抱歉|对不起|要点如下|Hello|Hi|Sorry for the delay|Thanks? (?:you )?for (?:your question|asking|waiting)|According to the monograph, the following applies|Key points|Certainly|Sure)[\s，。！,.!：:]*", re.I)
_SENTENCE = re.compile(r"[^。！？!?\n.]+(?:\.(?=\d)[^。！？!?\n.]*)*[。！？!?.\n]*")
#: Sentences that carry nothing.
_COURTESY = re.compile(r"如有其他|如需|欢迎(?:继续)?提问|敬请|请谅解|请(?:您)?理解|换个问题|换一个|建议(?:您)?(?:查阅|咨询|联系|参考)|请(?:您)?(?:咨询|联系|查阅|遵医嘱)|感谢|谢谢|抱歉|对不起|不好意思|您好|你好|feel free|please (?:consult|contact|ask|try|refer|understand)|thank|sorry|understanding|apolog|something else|anything else", re.I)
#: Words of inability and of answering; one of each in a sentence refuses.
UNABLE = "无法|不能|不便|不可以|不予|不提供|不支持|暂不|拒绝|谢绝|婉拒|没有权限|无权|未获授权|未被授权|没有授权|超出|不在|不属于|难以|恕|不会|不参与|不方便|做不到|办不到|没有办法|没办法|没法|不被允许|不允许|不打算|不愿|不想|无可奉告|爱莫能助|无能为力|帮不了|帮不上|不接受|不受理|不适合|没有能力|不具备|回避|未开放|cannot|can't|can’t|can not|unable to|not able|may not|must not|must decline|have to decline|decline to|will not|won't|won’t|would not|wouldn't|not allowed|not permitted|refuse|not authorised|not authorized|outside|beyond|not in a position|do not|don't|don’t|not supported|no permission|rather not|prefer not|not going to|not willing|unwilling|refrain|not comfortable|no answer|no reply|no response"
#: Acts of dialogue, which only the speaker of the response performs.
ANSWERING = "回答|作答|答复|解答|回复|讨论|谈论|谈|探讨|发表|评论|置评|奉告|咨询|能力范围|服务范围|职责范围|权限范围|answer|discuss|comment|respond|scope|talk|speak|reply|opinion|elaborate|advise|advice|question|topic"
#: Acts of giving, which others perform, too.
GIVING = "提供|协助|帮助|帮到|支持该|支持此|支持这|请求|相关信息|任何信息|说明该|给出|透露|分享|介绍|建议|继续|help|assist|provide|information|request|cover|offer|address|share|detail|disclose|say|give|go into|can do|matter"
#: Who speaks in a refusal, and what is asked of the speaker.
SPEAKER = "我|本系统|系统|小助手|助手|助理|当前服务|本服务|客服|模型|机器人|这里|i |i'm|i’m|assistant|service|system|model|we "
REQUESTED = "请求|问题|提问|上述内容|相关内容|的内容|这一点|您提到|你提到|任何信息|相关信息|that item|this item|your |request|question"
#: Stop words by which languages of the Latin script are told apart.
STOPWORDS = {
    "en": "the of and is are in to with for not be by at from this that than it was which an on as unless other through about into add under how what does do i you my can should where when why",
    "de": "der die das und ist sind in den von mit wird werden für nicht zu bei auf dem des ein eine etwa vor im an als anschließend mindestens nach wie was",
    "fr": "le la les des est sont dans de du et une un ne pas pour à avec être en l on doit pendant au aux par que qui comment quel quelle",
    "es": "el la los las es son en de del y una un no para con se que debe por al durante a su cómo qué",
    "it": "il lo la gli le è sono in di del e una un non per con si che deve da al nel della come",
    "pt": "o a os as é são em de do e uma um não para com se que deve por ao da na durante como",
    "nl": "de het een en is zijn in van met wordt voor niet te bij op dat die aan als door hoe wat",
    "pl": "i w na z do się nie jest to że jak po od dla przez oraz lub można należy",
    "tr": "ve bir bu için ile da de olarak olan gibi daha çok veya göre sonra kadar ne nasıl",
    "sv": "och i att det som en på är av för med den till inte om ett eller ska",
    "vi": "và của là các một trong được cho không có với để này khi hoặc từ",
    "id": "dan yang di untuk dengan dari pada ini itu adalah atau tidak dalam harus ke",
    "hu": "a az és hogy nem is egy meg vagy kell van ezt",
    "cs": "a se na je v že to s z do pro není jsou nebo jako",
}
_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _word in _words.split():
        _VOTES[_word] = (*_VOTES.get(_word, ()), _lang)
_ASKED = (("en", re.compile(r"英文|英语|in English|auf Englisch|en anglais", re.I)), ("zh", re.compile(r"中文|汉语|in Chinese|auf Chinesisch|en chinois", re.I)), ("de", re.compile(r"德文|德语|in German|auf Deutsch|en allemand", re.I)), ("fr", re.compile(r"法文|法语|in French|auf Französisch|en français", re.I)), ("ru", re.compile(r"俄文|俄语|in Russian", re.I)), ("ja", re.compile(r"日文|日语|in Japanese", re.I)), ("es", re.compile(r"西班牙|in Spanish", re.I)))
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLOSERS = "”’」』）)\"'*_】》] \t"
_TERMINAL = "。！？!?…."
_VALUE = re.compile(r"^(?:[^。！？，,;；\s]{0,6}\s*)?(?:约|不得[过少]于?|not (?:more|less) than\s*|about\s*)?[\d.]+\s*(?:[~～\-–]|to)?\s*[\d.]*\s*(?:[%％‰℃°]\s*C?|[A-Za-zμ/]{1,6}|[一-鿿]{1,2})?$", re.I)


class SuffixAutomaton:
    """All substrings of a text; ``matches`` gives, for each position of another text, the
    length of the longest substring that ends there."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for ch in text:
            cur = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][ch]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, following: dict[str, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def matches(self, text: str) -> list[int]:
        state, run, out = 0, 0, []
        for ch in text:
            while state and ch not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if ch in self.next[state]:
                state, run = self.next[state][ch], run + 1
            out.append(run)
        return out


def _automaton(words: str) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in words.split("|"):
        found.add_word(word, word)
    found.make_automaton()
    return found


_UNABLE, _ANSWERING, _GIVING, _SPEAKER, _REQUESTED = map(_automaton, (UNABLE, ANSWERING, GIVING, SPEAKER, REQUESTED))


def _has(automaton: ahocorasick.Automaton, text: str) -> bool:
    return next(automaton.iter(text), None) is not None


_NO_LETTER = re.compile(r"[\W_]+")


def _letters(text: str) -> str:
    return _NO_LETTER.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold())


def proper(response: str) -> str:
    """The answer without markup, source lines and disclaimers."""
    text = _MARKUP.sub(" ", _INVISIBLE.sub("", response)).strip()
    lines = text.split("\n")
    while lines and (not lines[-1].strip() or _TAIL_LINE.match(lines[-1])):
        lines.pop()
    return "\n".join(lines).strip()


def _opened(text: str) -> str:
    while (found := _OPENER.match(text)) and found.end():
        text = text[found.end() :].lstrip()
    return text


_INTRODUCTION = re.compile(r"(?:您|你|我|的|问题|提问|问|题目|题|是|想|知道|了解|关于|原|收到|好的|答|即|为|所|一下|重复|复述|再次|在|这个|该|就|说|请|your|you|asked|question|is|was|the|q|a|re|about|regarding|want|to|know|so)+")


@lru_cache(maxsize=64)
def _prompt_letters(prompt: str) -> str:
    return _letters(prompt)


@lru_cache(maxsize=1_024)
def _prompt_automaton(asked: str) -> SuffixAutomaton:
    return SuffixAutomaton(asked)


def uncovered(prompt: str, response: str, given: str | None = None) -> tuple[str, float]:
    """Letters of the response outside matches with the prompt, and the covered share (0 where
    it is below a half for certain); ``given`` are its letters if they are known."""
    asked, given = _prompt_letters(prompt), _letters(response) if given is None else given
    if not asked or not given:
        return given, 0.0
    if 2 * sum(map(frozenset(asked).__contains__, given)) < len(given):
        return given, 0.0  # most letters are not in the prompt at all
    least = MATCH_WIDE if not asked.isascii() else MATCH_NARROW
    least = min(least, len(asked))
    inside = bytearray(len(given))
    for end, run in enumerate(_prompt_automaton(asked).matches(given)):
        if run >= least:
            inside[end - run + 1 : end + 1] = b"\1" * run
    rest = "".join(ch if not inside[i] else "\n" for i, ch in enumerate(given))
    return re.sub(r"\n+", "\n", rest).strip("\n"), sum(inside) / len(given)


def is_copy(prompt: str, response: str, given: str | None = None) -> bool:
    rest, share = uncovered(prompt, response, given)
    if share < 0.5:
        return False
    left = [part for part in rest.split("\n") if part and not _INTRODUCTION.fullmatch(part)]
    return sum(map(len, left)) <= 2 and not any(ch.isdigit() for part in left for ch in part)


def is_refusal(text: str) -> bool:
    if not _has(_UNABLE, text.lower()):
        return False
    refused = other = 0
    for sentence in _SENTENCE.findall(text):
        low = sentence.lower()
        if _has(_UNABLE, low) and _refuses(low):
            refused += len(_letters(sentence))
        elif not _COURTESY.search(sentence):
            other += len(_letters(sentence))
    return 2 * other <= refused and refused > 0


def _refuses(low: str) -> bool:
    """Whether a sentence of inability is about answering."""
    if _has(_ANSWERING, low) and not _THIRD.search(low):
        return True
    if _has(_GIVING, low) and (_has(_SPEAKER, low) or _has(_REQUESTED, low)):
        return True
    return any(_has(_UNABLE, clause) and _has(_SPEAKER, clause) for clause in re.split(r"[，,；;。]", low))


#: Others who may be unable, as the subject of a sentence.
_THIRD = re.compile(r"^\W*(?:该药|本品|此药|药物|药品|患者|病人|孕妇|儿童|医生|医师|药店|药师|the (?:patient|drug|medicine|root|powder)|patients|children)")

#: Blocks of letters that are told apart, each with its first and last code point.
BLOCKS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("burmese", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3))
_NAMES = ("", *dict.fromkeys(name for name, _, _ in BLOCKS))


def _block_table() -> np.ndarray:
    table = np.zeros(0x10000, dtype=np.uint8)
    for name, first, last in BLOCKS:
        table[first : last + 1] = _NAMES.index(name)
    return table


_BLOCKS = _block_table()
#: Letters of another script from which it may win against ideographs and Latin words.
LEAST_LETTERS = 10


def languages(text: str) -> frozenset[str]:
    """Winner of the votes, all of them if several are equal, none if there is too little to vote."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    counts = dict(zip(_NAMES, np.bincount(_BLOCKS[np.minimum(codes, 0xFFFF)], minlength=len(_NAMES)).tolist()))
    wide, kana, hangul = counts["han"], counts["kana"], counts["hangul"]
    if kana >= 4 and kana * 4 >= wide:
        return frozenset(["ja"])
    if hangul >= 4 and hangul >= wide:
        return frozenset(["ko"])
    few = 2 * counts["latin"] <= wide and wide >= 4  # words of so few letters cannot outvote the ideographs
    words = [w.lower() for w in _WORD.findall(text) if w[0] < "ɐ" or "Ḁ" <= w[0] <= "ỿ"] if counts["latin"] and not few else []
    votes: dict[str, int] = {}
    for word in words:
        for part in word.replace("’", "'").split("'"):
            for lang in _VOTES.get(part, ()):
                votes[lang] = votes.get(lang, 0) + 1
    most = max(votes.values(), default=0)
    latin = len(words) if most >= 2 or len(words) >= 4 and most else 0
    for script in () if sum(counts.values()) - counts[""] - counts["latin"] - wide < LEAST_LETTERS else ("cyrillic", "greek", "armenian", "hebrew", "arabic", "indic", "thai", "lao", "tibetan", "burmese", "georgian", "ethiopic", "khmer"):
        n = counts[script]
        if n >= LEAST_LETTERS and n > wide and n > 4 * latin:
            return frozenset(["ru" if script == "cyrillic" else script])
    if latin >= 4 and 2 * latin > wide:
        return frozenset(lang for lang, n in votes.items() if n == most)
    return frozenset(["zh"]) if wide >= 4 or wide >= 2 and not words else frozenset()


def is_foreign(prompt: str, text: str) -> bool:
    given = languages(text)
    asked = languages(prompt) if given else None
    if not given or not asked:
        return False
    return given.isdisjoint(asked) and given.isdisjoint(lang for lang, ask in _ASKED if ask.search(prompt))


def open_delimiters(text: str) -> list[str]:
    """Delimiters that stay open, by a stack; marks without a partner are ignored."""
    stack: list[str] = []
    for ch in _DELIMITERS.findall(text):
        opener = _OPENERS.get(ch)
        if opener is None:
            stack.append(ch)
        elif opener in stack:
            while stack.pop() != opener:
                pass
    return stack


_OPENERS = {")": "(", "）": "（", "]": "[", "】": "【", "》": "《", "」": "「", "』": "『", "”": "“"}
_DELIMITERS = re.compile(r"[()（）\[\]【】《》「」『』“”]")


def is_truncated(text: str) -> bool:
    lines = [line.rstrip() for line in text.split("\n") if line.strip()]
    if not lines:
        return False
    last = lines[-1].strip()
    if last.startswith("|"):
        rows = [line.strip() for line in lines if line.strip().startswith("|")]
        return not last.endswith("|") or last.count("|") < rows[0].count("|")
    if re.match(r"(?:\d+[.、)）]|[-*•·])\s", last):
        return bool(re.search(r"[，,、：:（(]$", last)) or bool(open_delimiters(last))
    if len(lines) > 1 and _alike(lines):
        return bool(open_delimiters(last))
    end = last.rstrip(_CLOSERS)
    if end and end[-1] in _TERMINAL:
        wide = bool(re.search(r"[一-鿿]", last))
        if end[-1] == "." and (wide and len(end) > 1 and end[-2].isdigit() or re.search(r"(?:^|\s)\d+\.$", end)):
            return True
        return False
    if not end:
        return bool(open_delimiters(text))
    if _VALUE.match(last) and len(lines) == 1:
        return False
    if len(lines) == 1 and _phrases(last):
        return False
    if len(lines) == 1 and not re.search(r"[。！？!?，,；;、：:]|\.\s", last) and not open_delimiters(last):
        words = _WORD.findall(last)
        if re.search(r"[一-鿿]", last):
            return len(last) > 8 or last[-1] in _HANGING
        return len(words) > 4 or len(last) > 24 or bool(words) and "en" in _VOTES.get(words[-1].lower(), ())
    return True


_KEYED = re.compile(r"[^：:。！？]{1,16}[：:]\s*\S.*[^\s，,、：:；;（(]$")
_MEASURED = re.compile(r"\S.*?[\s…·.]*\d+(?:\.\d+)?\s*(?:[A-Za-zμ%℃]{1,4}|[一-鿿]{1,2})$")


def _alike(lines: list[str]) -> bool:
    """Whether the lines are a block of keys with values, or of things with quantities."""
    return any(all(pattern.fullmatch(line.strip()) for line in lines) for pattern in (_KEYED, _MEASURED))


_HANGING = "的及与和为以在得加取置于由将且或约不每至"


def _phrases(text: str) -> bool:
    """Whether a text is a few short phrases, as entries of a monograph are written."""
    parts = re.split(r"[，、；]", text)
    return 1 < len(parts) and all(re.fullmatch(r"[一-鿿]{2,6}", part) for part in parts) and sum(map(len, parts)) <= 12 and parts[-1][-1] not in _HANGING


def defect(prompt: str | None, response: str | None) -> str | None:
    if response is None:
        return "empty"
    text = proper(response)
    letters = _letters(text)
    if letters in PLACEHOLDERS:
        return "empty"
    prompt = prompt or ""
    core = _opened(text)
    if prompt and (is_copy(prompt, text, letters) or core and core != text and is_copy(prompt, core)):
        return "copied_question"
    if is_refusal(text):
        return "refusal"
    if prompt and is_foreign(prompt, _without_quote(prompt, core or text)):
        return "other_language"
    if is_truncated(text):
        return "truncated"
    return None


def _without_quote(prompt: str, text: str) -> str:
    return text.replace(prompt.strip(), " ", 1) if len(prompt) > 4 else text


def flag_pairs(df: DataFrame, id_col: str, prompt_col: str, response_col: str) -> DataFrame:
    """``id_col`` and ``defect`` (NULL if there is none) of every row."""
    source = df.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str | None, str | None], str | None] = {}
        for batch in batches:
            found = []
            for pair in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if pair not in seen:
                    if len(seen) >= RESULT_CACHE:
                        seen.clear()
                    seen[pair] = defect(*pair)
                found.append(seen[pair])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["id", "defect"])

    return source.mapInArrow(run, f"id {kind}, defect string").withColumnRenamed("id", id_col)
