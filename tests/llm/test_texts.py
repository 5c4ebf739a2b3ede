import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumflow.llm import pairs, scan, spam, visual


# --- look-alike text


@pytest.mark.parametrize(
    ("raw", "form"),
    [("ＡＢ１２（％）", "AB12(%)"), ("véra", "véra"), ("人​参﻿", "人参"), ("a b　c", "a b c"), ("⽊理枝⻩", "木理枝黄"), ("еsраnа", "espana"), ("ロ角", "口角"), ("10²①½", "10²①½"), ("檢查", "檢查"), ("a\nb\r\n", "a\nb\r\n"), ("e​́", "é"), ("", ""), (None, None), ("各︀", "各")],
)
def test_canonical(raw, form):
    assert visual.canonical(raw) == form


ALPHABET = "aeеﬁé́̈​각ᄀ각人⽊ロ①²：1１ 　̧ÅカガﾊﾞﾟエёИй"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(ALPHABET), max_size=12))
def test_splicing_equals_whole_text_normalisation(text):
    mapping, _, marked = visual._tables()
    assert visual.canonical(text) == visual._level(text, mapping, marked)
    assert visual.canonical(visual.canonical(text)) == visual.canonical(text)
    for form in ("NFC", "NFD"):
        assert visual.canonical(unicodedata.normalize(form, text)) == visual.canonical(text)


def test_equivalent_code_points_have_one_form():
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x2FA20)]:
        ch = chr(cp)
        if unicodedata.category(ch) != "Cn":
            form = visual.canonical(ch)
            assert form == visual.canonical(unicodedata.normalize("NFD", ch)) == visual.canonical(unicodedata.normalize("NFC", ch)) == visual.canonical(form)


@pytest.mark.parametrize(("a", "b"), [("ｶﾞ", "ガ"), ("ﾊﾟ", "パ"), ("ё", "ë"), ("ό", "ó"), ("3–5", "3-5"), ("ｶ", "力")])
def test_widths_marks_and_dashes(a, b):
    assert visual.canonical(a) == visual.canonical(b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(ALPHABET), max_size=12))
def test_alignment(text):
    view, places = visual.aligned(text)
    assert view == visual.canonical(text) and len(places) == len(view) + 1
    assert places == sorted(places) and places[-1] == len(text)


def test_jvm_quick_check_agrees_with_python():
    import re

    stable = re.compile(visual.STABLE_CLASS)
    for cp in [*range(0x20, 0xD800), *range(0xE000, 0x11000)]:
        if stable.match(chr(cp)):
            assert visual.canonical(chr(cp)) == chr(cp)


def test_pairs_against_brute_force(spark):
    texts = ["人参：1", "人参:１", "人参:1", "人参:1", None, None, "", "​", "甲" * 70_000, "甲" * 69_999 + "甲﻿", "别的", "é", "é"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id int, text string, canonical string, level int")
    df = df.unionByName(df.filter("id < 3"))
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and visual.canonical(a) == visual.canonical(b)}
    assert {tuple(r) for r in visual.look_alike_pairs(df, "id", "text").collect()} == want and want
    forms = {r["id"]: r["canonical"] for r in visual.canonical_forms(df, "id", "text").collect()}
    assert forms == {i: visual.canonical(t) for i, t in enumerate(texts)}
    assert visual.look_alike_pairs(df.filter("false"), "id", "text").count() == 0
    links = {i: sum(i in pair for pair in want) for i in range(len(texts))}
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in visual.look_alike_classes(df, "id", "text").collect()}
    first = {i: min(j for j, b in enumerate(texts) if b is not None and visual.canonical(b) == visual.canonical(texts[i])) for i in links if links[i]}
    assert got == {i: (first[i], links[i]) for i in first}


def test_a_look_of_many_rows_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(visual, "CELL_ROWS", 3)
    df = spark.range(40).selectExpr("id", "CASE WHEN id % 4 = 0 THEN '人参：' WHEN id % 10 = 1 THEN NULL ELSE '人参:' END AS text")
    rows = [(r["id"], r["text"]) for r in df.collect() if r["text"]]
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a != b}
    assert {tuple(r) for r in visual.look_alike_pairs(df, "id", "text").collect()} == want


# --- prompts and responses

Q = "请说明人参的性状。"
OK = "主根呈纺锤形，长3~15cm，表面灰黄色。"


@pytest.mark.parametrize(
    ("prompt", "response", "defect"),
    [
        (Q, None, "empty"), (Q, "", "empty"), (Q, " ​\n", "empty"), (Q, "<p></p>", "empty"), (Q, "N/A", "empty"), (Q, "答：", "empty"), (Q, "**  **", "empty"), (Q, "\n\n来源：药典-人参-性状", "empty"),
        (Q, Q, "copied_question"), (Q, "您的问题是：" + Q, "copied_question"), (Q, Q + "\n" + Q, "copied_question"), (Q, "“请说明人参的性状”", "copied_question"), (Q, Q + "\n" + OK, None),
        (Q, "抱歉，我无法回答这个问题。", "refusal"), (Q, "您好！这里不便就上述内容提供任何信息，敬请理解！\n\n来源：x", "refusal"), (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "抱歉让您久等了。" + OK, None), (Q, OK + "孕妇不能服用，也无法与甘草同用。", None),
        (Q, "Die getrocknete Wurzel wird in Scheiben von 5 cm Dicke geschnitten und ist hart.", "other_language"), (Q, "Хранить в плотно закрытой упаковке в защищённом от света месте.", "other_language"), (Q, "この薬は涼しいところに保存しなければなりません。", "other_language"),
        ("请用英文回答：" + Q, "Store in closed vessels, protected from the light and from moisture.", None), ("What is the storage?", "密封，置阴凉干燥处，防蛀，避光保存。", "other_language"), (Q, "malepiester残留 照气相色谱法测定，不得过2mg。", None),
        (Q, "主根呈纺锤形，长3~15cm，表面灰", "truncated"), (Q, "主根呈纺锤形。表面\n\n来源：药典-人参-性状", "truncated"), (Q, "| a | b |\n| --- | --- |\n| 1 |", "truncated"), ("What is it?", "The residue is dissolved in 5 ml of", "truncated"),
        (Q, OK, None), (Q, "3~9g", None), (Q, "25℃", None), (Q, "不得过12.7%", None), (Q, "要点如下：\n1. 清热\n2. 利湿", None), (Q, "如下。\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", None), (None, OK, None), ("", OK * 3000, None),
    ],
)
def test_defects(prompt, response, defect):
    assert pairs.defect(prompt, response) == defect


ENGLISH = "What is the storage of the root?"


@pytest.mark.parametrize(
    ("prompt", "response", "defect"),
    [
        (Q, "该药不能提供给儿童使用。", None), (Q, "本品不能与含相同成分的药物同时使用，医生会提供建议。", None), (Q, "不能给出处方的药店无法提供该药。", None), (Q, "患者不能自行讨论用量，应遵医嘱。", None), (Q, "我不便对此发表看法。", "refusal"), (Q, "很抱歉，" + "人参" * 60 + "的内容我不便提供。", "refusal"),
        (Q, "性味：甘，温\n归经：肺、脾经", None), (Q, "性味：甘，温\n归经：肺、", "truncated"), (Q, "黄芪 30g\n当归 15g\n甘草 6g", None), (Q, "黄芪 30g\n当归 15g\n甘草", "truncated"), (Q, "置通风干燥处，防蛀", None), (Q, "置通风干燥处，防", "truncated"), (Q, "密闭，避光，有效期62", "truncated"),
        (Q, "هذا الدواء يحفظ في مكان بارد وجاف بعيدا عن الضوء.", "other_language"), (Q, "Το φάρμακο φυλάσσεται σε δροσερό και ξηρό μέρος.", "other_language"), (Q, "Bu ilaç serin ve kuru bir yerde saklanır ve ışıktan korunur.", "other_language"), (Q, "ยานี้ควรเก็บในที่แห้งและเย็น", "other_language"), (Q, "यह दवा ठंडी और सूखी जगह पर रखी जानी चाहिए।", "other_language"),
        (ENGLISH, "Consérvese en un envase cerrado, protegido de la luz.", "other_language"), ("How do I restart?", "Press the button and hold it for five seconds.", None), ("请用希腊文或英文回答：" + Q, "Keep it in a dry place, away from the light and from the heat.", None),
    ],
)
def test_defects_of_other_kinds(prompt, response, defect):
    assert pairs.defect(prompt, response) == defect


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab甲", max_size=9), st.text(alphabet="ab甲", max_size=12))
def test_suffix_automaton_against_brute_force(a, b):
    got = pairs.SuffixAutomaton(a).matches(b)
    for i in range(len(b)):
        assert got[i] == max(n for n in range(i + 2) if b[i + 1 - n : i + 1] in a)


def test_flag_pairs(spark):
    df = spark.createDataFrame([(1, Q, None, "c"), (2, None, OK, "c"), (2, None, OK, "c"), (None, Q, Q, "c")], "id int, prompt string, response string, defect string")
    got = [(r["id"], r["defect"]) for r in pairs.flag_pairs(df, "id", "prompt", "response").collect()]
    assert sorted(got, key=str) == sorted([(1, "empty"), (2, None), (2, None), (None, "copied_question")], key=str)
    assert pairs.flag_pairs(df.filter("false"), "id", "prompt", "response").count() == 0


# --- scanned text

CLEAN = ["取本品粉末，加水煎煮，滤过，滤液浓缩至干燥，残渣加水溶解。图样参见《汀南药材标准》第3页。", "照气相色谱法测定，重量不得过，性味与归经，干燥，纺锤形。The residue is dissolved in methanol and filtered through."] * 30


@pytest.fixture(scope="module")
def held(spark):
    df = spark.createDataFrame([(t,) for t in [*CLEAN, None, ""]], "t string")
    return scan.build_lexicon(df, "t")


@pytest.fixture(scope="module")
def lexicon(held):
    return held.lexicon()


@pytest.mark.parametrize(
    ("raw", "clean", "noise"),
    [
        ("取本品粉末，加水煎\n煮，滤过。", "取本品粉末，加水煎煮，滤过。", {"broken_line"}), ("The resi-\r\ndue is dissolved.", "The residue is dissolved.", {"broken_line"}), ("浅渣加水榕解。", "残渣加水溶解。", {"misread"}),
        ("滤液，\n汀南药材标准 二部\n浓缩至干燥。", "滤液，浓缩至干燥。", {"running_header"}), ("滤过。\n— 123 —\n残渣。", "滤过。\n残渣。", {"page_number"}), ("加水6Oml。", "加水60ml。", {"misread"}), ("128 取本品粉末，加水煎煮，滤过，滤液浓缩至干燥，残渣加水溶解，照气相色谱法测定，重量不得过，性味与归经，干燥，纺锤形，滤液浓缩至干燥。 129", "取本品粉末，加水煎煮，滤过，滤液浓缩至干燥，残渣加水溶解，照气相色谱法测定，重量不得过，性味与归经，干燥，纺锤形，滤液浓缩至干燥。", {"page_number"}), ("— 128 — 取本品粉末。", "取本品粉末。", {"page_number"}), ("取本品粉末。 第12页", "取本品粉末。", {"page_number"}), ("汀南药材标准 二部 | 取本品粉末。", "取本品粉末。", {"running_header"}), ("汀南药材标准" + " " * 80 + "二部\n取本品粉末。", "取本品粉末。", {"running_header"}), ("12 g", "12 g", set()), ("图样参见《汀南药材标准》| 第3页。", "图样参见《汀南药材标准》| 第3页。", set()), ("取本品\xa0粉末；“甲”（乙），加水榕解。", "取本品\xa0粉末；“甲”（乙），加水溶解。", {"misread"}), ("加水煎\n煮\u200b，滤过；“甲”。", "加水煎煮\u200b，滤过；“甲”。", {"broken_line"}), ("The residue is d!sso1ved.", "The residue is dissolved.", {"misread"}),
        ("参见《汀南药材标准》第3页。", "参见《汀南药材标准》第3页。", set()), ("甲 1.2 红\n乙 2.3 白", "甲 1.2 红\n乙 2.3 白", set()), ("1\n取本品。", "1\n取本品。", set()), ("名称：人参\n分类：药", "名称：人参\n分类：药", set()), ("", "", set()), (None, None, set()),
    ],
)
def test_repair(lexicon, raw, clean, noise):
    got = scan.repair(raw, lexicon)
    assert got == (clean, noise)


@pytest.mark.parametrize(("raw", "clean", "noise"), [("人\n参", "人参", {"broken_line"}), ("人参 1247", "人参", {"page_number"}), ("人参2", "人参2", set()), ("汀南药材标准 卷上｜人参", "人参", {"running_header"}), ("人参(B6型)", "人参(B6型)", set()), ("", "", set()), (None, None, set())])
def test_repair_name(lexicon, raw, clean, noise):
    assert scan.repair_name(raw, lexicon) == (clean, noise)


def test_lexicon_counts_and_bounds(spark, lexicon):
    import collections

    want = collections.Counter()
    for t in CLEAN:
        signs = [s for ch in t if (s := int(scan._CLASSES[ord(ch)]))]
        want.update((a, b) for a, b in zip(signs, signs[1:]) if a >= 0x4E00 or b >= 0x4E00)
    assert lexicon.pairs == {a << 16 | b: n for (a, b), n in want.items()}
    assert lexicon.titles == ["汀南药材标准"] and lexicon.words["residue"] == 30
    empty = scan.build_lexicon(spark.createDataFrame([], "t string"), "t").lexicon()
    assert scan.repair("取本\n品", empty) == ("取本\n品", set()) and empty.title is None


def test_repair_texts(spark, held):
    df = spark.createDataFrame([(1, "加水煎\n煮", "x"), (2, None, "x"), (2, None, "x")], "id int, text string, noise string")
    got = sorted((r["id"], r["clean"], r["noise"]) for r in scan.repair_texts(df, "id", "text", held).collect() if r["id"] == 1)
    assert got == [(1, "加水煎煮", ["broken_line"])]


def test_recurring_misread_word_is_repaired():
    lexicon = scan.Lexicon({}, {"acetate": 679, "acctate": 6, "erect": 40, "crect": 30}, [])
    assert scan.repair("The acctate is erect.", lexicon) == ("The acetate is erect.", {"misread"})
    assert scan.repair("The acetate is crect.", lexicon) == ("The acetate is crect.", set())


def test_misread_words_of_all_kinds(spark):
    texts = ["It is determined through the column in methanol, otherwise tightly closed. The modern way of the acid."] * 40
    texts += ["It is deterrnined tlirough the colurnn in metlianol, otlierwise tiglitly closed. The modem way of thc acid, dctcrrnincd."]
    texts += ["A modem line is used for the modem of the unit."] * 30 + ["The modern way of the acid was used by modern men."] * 3
    lexicon = scan.build_lexicon(spark.createDataFrame([(t,) for t in texts], "t string"), "t").lexicon()
    want = "It is determined through the column in methanol, otherwise tightly closed. The modern way of the acid, determined."
    assert scan.repair(texts[40], lexicon) == (want, {"misread"})
    for other in (texts[0], texts[41], "A modem is used."):
        assert scan.repair(other, lexicon) == (other, set())
    assert scan.repair_name("Metlianol tiglitly", lexicon) == ("Metlianol tightly", {"misread"})


def test_slips_in_typed_names_stay():
    lexicon = scan.Lexicon({}, {"Idntification": 2, "ldntification": 4, "Identification": 700, "Idcntification": 2}, [])
    assert scan.repair_name("Idntification", lexicon) == ("Idntification", set())
    assert scan.repair_name("Idcntification", lexicon) == ("Identification", {"misread"})


def test_repairs_come_from_the_index(lexicon):
    emptied = scan.Lexicon(lexicon.pairs, lexicon.words, lexicon.titles)
    emptied.index = scan.Deletions([], [])
    for raw in ("加水榕解。", "The rcsidue is dissolved."):
        assert scan.repair(raw, lexicon)[1] == {"misread"} and scan.repair(raw, emptied)[1] == set()


def test_confusions_are_learned(spark):
    """A character outside the table, in several neighbourhoods; a rare word and a traditional form are none."""
    usual = ["把白猫给人，那黑猫叫了，有猫的家，买黄芪一两，放黄芪三钱，看黄芪的叶，来的人说来了就来。"] * 60
    odd = ["把白描给人，那黑描叫了，有描的家，买黄芩一两，放黄芩三钱，看黄芩的叶，來的人说來了就來。"] * 2
    held = scan.build_lexicon(spark.createDataFrame([(t,) for t in usual + odd], "t string"), "t")
    assert held.parts.value["learned"] == [("描", "猫")]
    assert scan.repair("有描的家，买黄芩一两。", held.lexicon()) == ("有猫的家，买黄芩一两。", {"misread"})


def test_letters_of_similar_shape():
    lexicon = scan.Lexicon({}, {"extract": 900, "extracl": 1, "extracs": 1, "extracct": 1, "set": 900, "sel": 1}, [])
    assert scan.repair("The extracl is", lexicon) == ("The extract is", {"misread"})
    for other in ("The extracs is", "The extracct is", "The sel is"):
        assert scan.repair(other, lexicon) == (other, set())


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ａb，“。 \u200b㎏ｶﾞ", max_size=12), st.data())
def test_draft_splices_only_what_it_repairs(source, data):
    view, starts = visual.aligned(source)
    assert scan.Draft(view).text == view
    draft = scan.Draft(view)
    draft.apply([(0, 0, "")])
    assert draft.spliced(source, starts) == source[starts[0] if view else len(source) :]
    if view:
        at = data.draw(st.integers(0, len(view) - 1))
        draft.apply([(at, at + 1, "X")])
        got = draft.spliced(source, starts)
        assert visual.canonical(got) == visual.canonical(view[:at] + "X" + view[at + 1 :]) or starts[at] in (starts[at + 1], starts[max(at - 1, 0)])


def test_looks_agree(spark):
    words = ["deterrnined", "Ieaves", "d!sso1ved", "whole", "vvool", "éclair", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(scan.look_column(scan.F.col("w"))).collect()] == list(map(scan.look, words))
    assert scan.weighted_distance("deterrnined", "determined") == scan.CONFUSED and scan.weighted_distance("modem", "modern") == scan.CONFUSED and scan.weighted_distance("abc", "abd") == scan.EDIT


# --- spam pages

PROSE = "本品为人参的干燥根，取本品粉末，加水煎煮，滤过，滤液浓缩至干。\n"


@pytest.mark.parametrize(
    ("text", "is_spam"),
    [
        ("人参批发_人参哪里买_人参供应_人参_人参报价_" * 9, True), ("首页 > 药材 > 登录 > 返回\n" * 9, True), ("人参价格 https://shop1.example/p/1\n" * 9, True), ("[人参](https://a.example/1) " * 9, True), ("人参 50g ￥9.90 加入购物车\n" * 9, True), ("#人参 #批发 #汀州 " * 9, True),
        ("buy ginseng root cheap ginseng extract best ginseng price " * 5, True), ("厂家人参汀州。汀州人参。人参厂家。厂家汀州人参。" * 9, True), (PROSE + "人参批发_人参哪里买_人参供应_人参_人参报价_" * 9, True),
        (PROSE * 9, False), (PROSE * 9 + "[1] a. https://lib.example/1\n[2] b. https://lib.example/2", False), ("首页 > 药材 > 人参\n" + PROSE * 4, False), (PROSE * 3 + "处方：\n人参 5g\n甘草 6g", False), ("今年人参的批发价格较去年上涨约9%，多数厂家仍在观望。" * 9, False),
        ("The root of the plant is cut into slices and stored in closed vessels. " * 5, False), ("", False), (None, False), (" \n\t", False),
    ],
)
def test_spam_share(text, is_spam):
    f = spam.features(text)
    assert (sum(f[k] for k in spam.KINDS) > spam.SHARE) == is_spam


def test_find_spam(spark):
    rows = [(1, PROSE * 5), (2, "人参批发_人参哪里买_人参供应_人参_人参报价_" * 9), (3, None), (4, ""), (5, PROSE * 20_000), (2, "人参批发_人参哪里买_人参供应_人参_人参报价_" * 9)]
    df = spark.createDataFrame([(*r, "zz") for r in rows], "doc_id bigint, text string, lang string")
    assert sorted(r["doc_id"] for r in spam.find_spam(df).filter("spam").collect()) == [2, 2]
    assert spam.find_spam(df.filter("false")).count() == 0


def test_page_shares_enter_the_verdict(spark):
    english = "The root of the plant is cut into slices and stored in closed vessels. It is dried in the shade.\n"
    spam_pages = ["ginseng root\n" * 200, "人参\n" * 200, "ginseng root, red ginseng, ginseng tea, " * 30, "人参、红参、人参、白参、" * 40]
    good = [PROSE * 9, english * 9, "人参", "ginseng root", "人参\n甘草\n黄芪\n白术\n当归\n川芎\n熟地\n白芍\n茯苓\n陈皮", PROSE * 9 + "人参\n" * 20, english * 9 + "ginseng root\n" * 9]
    df = spark.createDataFrame(list(enumerate([*good * 9, *spam_pages])), "doc_id int, text string")
    assert [r["doc_id"] - 9 * len(good) for r in spam.find_spam(df).filter("spam").orderBy("doc_id").collect()] == [0, 1, 2, 3]


def test_pages_without_listed_words(spark):
    """Repeated lines, keywords, shop lines and links outside the word lists, and long ones."""
    english = "The root of the plant is cut into slices and stored in closed vessels. It is dried in the shade.\n"
    russian = "Корень растения режут на ломтики и хранят в закрытых сосудах, потому что он не любит влаги.\n"
    products = "参片 芪粉 当归丸 枸杞酒 三七粉 黄精膏 灵芝片 石斛露"
    long_anchor = "the dried root of the plant that grows in the high mountains, as described in the third volume of the book"
    spam_pages = [
        "本店多年来一直为各地的客人挑选上好的人参，厂家直销，质量是可以放心的。\n" * 300, "ginseng capsules ginseng tea astragalus pills angelica powder\n" * 40, "ginseng capsules ginseng tea astragalus pills angelica powder " * 40, (products + "\n") * 60, (products + " ") * 60,
        "".join(f"Женьшень корень {k} г 5{k}0 руб в корзину\n" for k in range(80)), "".join(f"[{long_anchor} {k}](https://a.example/{k})\n" for k in range(100)), "".join(f'<a href="/p/{k}">{long_anchor} {k}</a>\n' for k in range(100)),
        "#" + "参" * 60 + " #" + "芪" * 60 + " #" + "归" * 60 + " #" + "芍" * 60,
    ]
    good = [PROSE * 9, english * 9, russian, PROSE * 30 + "人参批发_人参供应_人参报价\n" * 3, PROSE * 12 + "".join(f"[人参 {k}](https://a.example/{k})\n" for k in range(3)), "".join(f"第{k}批{PROSE}" for k in range(40))]
    pages = [page.replace("本品", f"第{i}批") for i, page in enumerate([*good] * 9)]
    df = spark.createDataFrame(list(enumerate(pages + spam_pages)), "doc_id int, text string")
    found = {r["doc_id"] for r in spam.find_spam(df).filter("spam").collect()}
    assert found == {len(pages) + k for k in range(len(spam_pages))}


def test_languages():
    for text, lang in (("La raíz de la planta se seca con el tallo y se guarda para el invierno.", "es"), ("Корень растения режут на ломтики и хранят в сосудах.", "ru"), ("Женьшень дешево", "cyrillic"), ("ราก ต้นไม้", "thai"), ("植物の根を乾燥する。", "kana"), ("뿌리", "hangul"), ("12 34", "other")):
        assert spam.features(text)["lang"] == lang


def test_language_is_told_from_the_whole_page():
    keywords = "buy ginseng, cheap ginseng, best ginseng price\n" * 100
    english = "The root of the plant is cut into slices and stored in closed vessels. It is dried in the shade.\n"
    assert len(keywords) > 4000 and spam.features(keywords + english * 200)["lang"] == "en"
    assert spam.features(keywords + "Die Wurzel wird mit der Rinde getrocknet und geschnitten.\n" * 200)["lang"] == "de"
    assert spam.features(keywords)["lang"] == "latin"
