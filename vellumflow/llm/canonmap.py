"""Mapping of freely typed values to the closest entry of a reference list.

The forms of the reference list (names, aliases, translations, transcriptions) are kept in a
BK-tree under the unrestricted Damerau-Levenshtein distance, which is a true metric, so the
triangle inequality prunes subtrees without losing an entry within the threshold. A value is
first brought to a key (width, case, traditional characters, brackets, numbering, blanks);
all entries within the threshold of the key are found, and the best one wins by distance,
then kind of form, then id. If the whole key has none, parts between separators are tried,
so that a heading that stands beside the value does not hide it.

The list is collected and sent to the workers only if a count shows at most ``max_forms``
forms. A longer list is cut into shards: every distinct value meets every shard once, each
shard has its own tree, and the shards' winners are merged by the same order.

Results for odd input: NULL and empty values map to NULL (they are no values), blank values
and values without an entry within the threshold map to ``UNMATCHED`` (-1); equal values map
alike; an empty reference list leaves all values unmatched.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import CONFUSIONS

UNMATCHED = -1
#: Reference forms that may be broadcast; beyond, the list is sharded.
MAX_FORMS = 50_000
SHARD_FORMS = 20_000
#: Distinct values that meet a shard in one task.
BUCKET_VALUES = 50_000
VALUE_CACHE = 200_000

#: Traditional characters, each with its simplified form.
TRADITIONAL = "來来 狀状 鑒鉴 鑑鉴 別别 檢检 測测 與与 歸归 經经 製制 處处 貯贮 規规 徵征 圖图 譜谱 紋纹 鹼碱 對对 時时 農农 藥药 殘残 屬属 應应 臨临 條条 實实 驗验 劑剂 質质 標标 準准 備备 氣气 號号 診诊 療疗 說说 現现 雜杂 試试 組组 裝装 溫温 葉叶 種种 類类 據据 後后 滿满 產产 發发 體体 無无 個个 為为 術术 驟骤 選选 項项 續续 壓压 濕湿 熱热 濃浓 縮缩 過过 濾滤 簡简 稱称 純纯 淨净 漿浆 學学 監监 線线 長长 寬宽 樣样 計计 數数 結结 論论 內内 餘余 碼码 門门 貨货 價价 醫医 總总 則则 範范 節节 錄录 編编 註注 釋释 劃划 覽览 詳详 細细 動动 風风 黃黄 龍龙 馬马 開开 關关 間间 區区 單单 雙双 層层 點点 積积 極极 構构 營营 養养 衛卫 護护 複复 變变"
_ALIKE = frozenset((pair[0], pair[1]) for pair in CONFUSIONS.split())
_FOLD = str.maketrans({pair[0]: pair[1] for pair in TRADITIONAL.split()})

_INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_TAG = re.compile(r"</?[a-z][^<>]*>")
_BREAK = re.compile(r"-[ \t]*\r?\n\s*")
_HEAD = re.compile(r"^(?:[\W_]|\d+|[一二三四五六七八九十]+(?=[、.．]))+")
_TAIL = re.compile(r"(?:\(续\)|(?<=..)项|[\W_]|(?<![a-z])\d+)+$")
_SEPARATOR = re.compile(r"[\s|]+")
_ALONE = re.compile(r"[a-z0-9 ]*")


def fold(value: str) -> str:
    """Width, case, invisible characters and traditional characters levelled."""
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", value)).casefold().translate(_FOLD)


def _trim(text: str) -> str:
    return _TAIL.sub("", _HEAD.sub("", text))


def keys(value: str) -> list[str]:
    """The key of the whole value, then those of its parts between separators."""
    text = _BREAK.sub("", _TAG.sub(" ", fold(value)))
    whole = _key(text)
    parts = [k for k in (_key(p) for p in _SEPARATOR.split(text)) if k and k != whole]
    return [whole, *dict.fromkeys(parts)]


def _key(text: str) -> str:
    text = _trim(text)
    return re.sub(r"\s+", " ", text) if _ALONE.fullmatch(text) else re.sub(r"\s+", "", text)


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions: a metric."""
    last: dict[str, int] = {}
    n, m = len(a), len(b)
    far = n + m
    d = [[far] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        seen = 0
        for j in range(1, m + 1):
            k, l = last.get(b[j - 1], 0), seen
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, seen = 0, j
            swap = d[k][l] + (i - k - 1) + 1 + (j - l - 1)
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, swap)
        last[a[i - 1]] = i
    return d[n + 1][m + 1]


class BkTree:
    """Strings under a metric; ``within`` returns every stored one in reach."""

    def __init__(self, words: Iterable[str] = (), metric: Callable[[str, str], int] = distance):
        self.metric, self.root, self.compared = metric, None, 0
        for word in words:
            self.add(word)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while d := self.metric(word, node[0]):
            if d not in node[1]:
                node[1][d] = (word, {})
                return
            node = node[1][d]

    def within(self, word: str, reach: int) -> list[tuple[int, str]]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            entry, children = todo.pop()
            self.compared += 1
            d = self.metric(word, entry)
            if d <= reach:
                found.append((d, entry))
            todo += [child for edge, child in children.items() if d - reach <= edge <= d + reach]
        return found


def reach_of(key: str) -> int:
    """Edits allowed for a key: one, for Latin words one more per six letters beyond six."""
    if len(key) < 2:
        return 0
    return max(1, len(key) // 6) if key.isascii() else max(1, len(key) // 5)


def other_word(key: str, form: str) -> bool:
    """Whether two words of two ideographs differ in one that is no misreading of the other: so
    short, most of what is one edit away is another word."""
    if len(key) != 2 or len(form) != 2 or key.isascii() or form.isascii() or key == form[::-1]:
        return False
    return any(a != b and (a, b) not in _ALIKE for a, b in zip(key, form))


class Matcher:
    """Reference forms ``(id, tier, form)``; a lower tier wins among equal distances."""

    def __init__(self, forms: Iterable[tuple[int, int, str]]):
        self.owners: dict[str, tuple[int, int]] = {}
        for owner, tier, form in forms:
            if form is None:
                continue
            key = keys(form)[0]
            if key:
                self.owners[key] = min(self.owners.get(key, (tier, owner)), (tier, owner))
        self.tree = BkTree(self.owners)
        self.cache: dict[str, tuple[bool, int, int, int] | None] = {}

    def best(self, value: str) -> tuple[int, int, int] | None:
        """Distance, tier and id of the winner; for a part of the value, one edit is added."""
        ranked = self.ranked(value)
        return ranked[1:] if ranked else None

    def ranked(self, value: str) -> tuple[bool, int, int, int] | None:
        """The winner after whether it matches only a part, by which winners of shards are ordered first."""
        if value in self.cache:
            return self.cache[value]
        winner = None
        for no, key in enumerate(keys(value)):
            if not key:
                continue
            if key in self.owners:
                found = [(0, *self.owners[key])]
            else:
                found = [(d, *self.owners[form]) for d, form in self.tree.within(key, reach_of(key)) if d < max(len(key), 2) and not other_word(key, form)]
            if found:
                d, tier, owner = min(found)
                winner = min(filter(None, [winner, (no > 0, d + (no > 0), tier, owner)]))
            if no == 0 and winner:
                break
        if len(self.cache) >= VALUE_CACHE:
            self.cache.clear()
        self.cache[value] = winner
        return winner


def map_values(df: DataFrame, id_col: str, value_col: str, reference: DataFrame, max_forms: int = MAX_FORMS, shard_forms: int = SHARD_FORMS) -> DataFrame:
    """``id_col, value, canon_id, distance`` of every row of ``df``.

    ``reference`` has ``canon_id bigint, tier int, form string``.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(value_col).alias("value"))
    n_forms = reference.limit(max_forms + 1).count()
    if n_forms <= max_forms:
        forms = [tuple(r) for r in reference.select("canon_id", "tier", "form").collect()]
        return _map_narrow(source, forms).withColumnRenamed("id", id_col)
    return _map_sharded(source, reference, shard_forms).withColumnRenamed("id", id_col)


#: The matcher of a worker process under the key of its list: one tree for all its tasks, with
#: the values that it has met.
_BUILT: dict = {}


def _map_narrow(source: DataFrame, forms: list[tuple[int, int, str]]) -> DataFrame:
    kind = source.schema["id"].dataType.simpleString()
    sent, name = source.sparkSession.sparkContext.broadcast(forms), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _BUILT.get("name") != name:
            _BUILT.update(name=name, matcher=Matcher(sent.value))
        matcher = _BUILT["matcher"]
        for batch in batches:
            canon, far = [], []
            for value in batch.column(1).to_pylist():
                best = matcher.best(value) if value else None
                canon.append(None if not value else best[2] if best else UNMATCHED)
                far.append(best[0] if best else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(canon, pa.int64()), pa.array(far, pa.int32())], ["id", "value", "canon_id", "distance"])

    return source.mapInArrow(run, f"id {kind}, value string, canon_id bigint, distance int")


def _map_sharded(source: DataFrame, reference: DataFrame, shard_forms: int) -> DataFrame:
    shards = max(1, -(-reference.count() // shard_forms))
    values = source.filter("value <> ''").select("value").distinct()
    buckets = max(1, -(-values.count() // BUCKET_VALUES))
    forms = reference.select(F.pmod(F.xxhash64("form"), F.lit(shards)).alias("shard"), "canon_id", "tier", "form").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    asked = values.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))).withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        matcher = Matcher(right[["canon_id", "tier", "form"]].itertuples(index=False, name=None))
        found = [(v, *best) for v in left["value"] if (best := matcher.ranked(v))]
        return pd.DataFrame(found, columns=["value", "part", "distance", "tier", "canon_id"])

    winners = asked.groupBy("shard", "bucket").cogroup(forms.groupBy("shard", "bucket")).applyInPandas(run, "value string, part boolean, distance int, tier int, canon_id bigint")
    best = winners.groupBy("value").agg(F.min(F.struct("part", "distance", "tier", "canon_id")).alias("best")).withColumnRenamed("value", "_value")
    joined = source.join(best, F.col("value") == F.col("_value"), "left")
    canon = F.when(F.col("value").isNull() | (F.col("value") == ""), F.lit(None)).otherwise(F.coalesce("best.canon_id", F.lit(UNMATCHED)))
    return joined.select("id", "value", canon.cast("bigint").alias("canon_id"), F.col("best.distance").alias("distance"))
