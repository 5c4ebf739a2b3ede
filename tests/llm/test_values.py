import random

import pytest

from vellumflow.llm import canonmap as c

FORMS = [(1, 0, "性状"), (1, 1, "外观"), (1, 2, "Description"), (2, 0, "含量测定"), (2, 2, "Assay"), (3, 0, "处方"), (3, 1, "组方"), (4, 0, "制法"), (5, 1, "服法"), (6, 0, "性味与归经")]


@pytest.mark.parametrize(
    ("value", "canon"),
    [
        ("性状", 1), ("【性 状】", 1), ("3.含量測定：", 2), ("含测量定", 2), ("ＡＳＳＡＹ", 2), ("<b>descrption</b>", 1), ("外方", 3), ("剌法", 4), ("服法", 5), ("功能", -1), ("批注 3", -1), ("???", -1), ("  ", -1),
        ("某某药材标准 二部｜性状", 1), ("性味与\r\n归经", 6), ("性-\n状", 1), ("含量测定……302", 2), ("1021 性状", 1), ("", None), (None, None), ("x" * 100_000, -1),
    ],
)
def test_mapping(value, canon):
    best = c.Matcher(FORMS).best(value) if value else None
    assert (None if not value else best[2] if best else c.UNMATCHED) == canon


def osa(a, b):
    """Unrestricted Damerau-Levenshtein by breadth-first search over edits, for short strings."""
    letters, seen, level, n = set(a + b), {a}, {a}, 0
    while b not in seen:
        n += 1
        new = set()
        for s in level:
            for i in range(len(s) + 1):
                new |= {s[:i] + x + s[i:] for x in letters}
                if i < len(s):
                    new.add(s[:i] + s[i + 1 :])
                    new |= {s[:i] + x + s[i + 1 :] for x in letters}
                if i + 1 < len(s):
                    new.add(s[:i] + s[i + 1] + s[i] + s[i + 2 :])
        level = {s for s in new - seen if abs(len(s) - len(b)) <= 4}
        seen |= level
    return n


def test_distance_is_the_metric():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(14)]
    for a in words[:7]:
        for b in words[7:]:
            assert c.distance(a, b) == osa(a, b) == c.distance(b, a)
    for a in words:
        for b in words:
            for x in words:
                assert c.distance(a, x) <= c.distance(a, b) + c.distance(b, x)


def test_tree_finds_all_within_reach_and_prunes():
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 8))) for _ in range(400)})
    tree = c.BkTree(words)
    for asked in words[:20] + ["zzzz", "abcdabcd"]:
        want = sorted((d, w) for w in words if (d := c.distance(asked, w)) <= 1)
        tree.compared = 0
        assert sorted(tree.within(asked, 1)) == want
        assert tree.compared < len(words)


def test_operator_broadcast_and_sharded_agree(spark):
    values = ["性状", "外方", None, "", " ", "剌法", "含测量定", "批注", "性状", "Asay"] * 3
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in enumerate(values)], "id int, value string, canon_id string, distance int")
    ref = spark.createDataFrame(FORMS, "canon_id bigint, tier int, form string")
    near = {(r["id"], r["value"], r["canon_id"]) for r in c.map_values(df, "id", "value", ref).collect()}
    far = {(r["id"], r["value"], r["canon_id"]) for r in c.map_values(df, "id", "value", ref, max_forms=3, shard_forms=4).collect()}
    assert near == far and len(near) == len(values)
    assert c.map_values(df.filter("false"), "id", "value", ref).count() == 0
    assert {r["canon_id"] for r in c.map_values(df, "id", "value", ref.filter("false")).collect()} == {None, -1}


def test_whole_match_of_one_shard_beats_part_match_of_another(spark):
    forms = [(20, 1, "abcdefghijklmnopqr|stuvwxyz"), (10, 0, "stuvwxyz")] + [(30 + i, 2, f"{i}{i}人参{i}") for i in range(8)]
    value = "abcdefghijklmnxxqr|stuvwxyz"
    ref = spark.createDataFrame(forms, "canon_id bigint, tier int, form string")
    df = spark.createDataFrame([(1, value)], "id int, value string")
    near = c.map_values(df, "id", "value", ref).collect()
    assert near[0]["canon_id"] == 20
    for shard_forms in (1, 2, 3, 4):
        assert c.map_values(df, "id", "value", ref, max_forms=3, shard_forms=shard_forms).collect() == near


def test_two_ideographs_match_another_word_only_by_shape():
    matcher = c.Matcher([(k, 0, form) for k, form in enumerate(["性状", "处方", "规格", "来源", "注意", "检查", "制法", "用途", "贮藏"])])
    for word in ("性别", "处理", "规则", "来信", "注射", "检修", "制度", "用品"):
        assert matcher.best(word) is None
    for word, canon in (("性伏", 0), ("状性", 0), ("来沅", 3), ("捡查", 5), ("杳检", None), ("贮葴", 8)):
        assert (matcher.best(word) or (None,) * 3)[2] == canon


def test_shards_agree_on_random_forms(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef|药材 ") for _ in range(rng.randint(1, 14))) for _ in range(160)]
    forms = [(k % 25, k % 3, w) for k, w in enumerate(words[:80])]
    values = [(k, w if k % 2 else words[k % 80][:-1] + "b | " + w) for k, w in enumerate(words)]
    df, ref = spark.createDataFrame(values, "id int, value string"), spark.createDataFrame(forms, "canon_id bigint, tier int, form string")
    near = sorted(c.map_values(df, "id", "value", ref).collect())
    for shard_forms in (7, 30):
        assert sorted(c.map_values(df, "id", "value", ref, max_forms=3, shard_forms=shard_forms).collect()) == near
