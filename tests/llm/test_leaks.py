import random
from collections import Counter
from types import SimpleNamespace

from wellforge.llm import leaks as k

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
NAMES = ["skovetror", "plinadax", "trumovil", "gaberuth", "zelofind", "morquadon", "hiplestra", "vuncorim", "drasilex", "bofentul", "quistovar", "neplurath"]


def sentence(a, b, c, n=5):
    return f"As shown in Fig. {n}, the sealed {a} coil {n * 7} carries the {b} {c} bracket at approx. {n}.{n} mm from its outer edge, and no other part is left out there."


ITEM = sentence(*NAMES[:3]) + " " + sentence(*NAMES[3:6], n=8)


#: Items of the same template with names of their own: what they share is no name.
OTHERS = [(100 + i, sentence(f"ab{w}", f"cd{w}", f"ef{w}")) for i, w in enumerate("korin tasel mudan pelov zurik hexam".split())]


def found(spark, docs, items=((1, ITEM),)):
    items = [*items, *OTHERS]
    rows = [(i, t) for i, t in enumerate(docs)]
    got = k.leaked_passages(spark.createDataFrame(rows, DOCS), spark.createDataFrame(list(items), ITEMS))
    return sorted((r["doc_id"], r["item_id"]) for r in got.filter("kind = 'leak'").collect())


def test_words_ignore_how_they_are_written():
    plain = k.canonical("The sealed coil – près du cœur")
    assert k.canonical("THE  SEALED,\nCOIL (pres du coeur)") == plain
    assert k.canonical("Thе sеalеd cоil près du cœur") == plain
    assert k.canonical("the sea-\nled coil prÃ¨s du cœur") == plain
    assert k.canonical("9A 12.5 none x3") == ["#9a.12.5", "none", "#x3"] and k.canonical(None) == [] and k.canonical(" \n") == []
    assert k.words(k.canonical("9A 12.5 x3 none")) == ["none"]
    assert k.canonical("密封圈 ring 4个") == ["密", "封", "圈", "ring", "#4", "个"]


def test_words_that_come_again_are_spelled_once(monkeypatch):
    spelled, normalize = [], k.unicodedata.normalize
    monkeypatch.setattr(k, "unicodedata", SimpleNamespace(normalize=lambda form, text: spelled.append(text) or normalize(form, text)))
    texts = [f"Près du cœur n° {i}, la bague guidée" for i in range(200)]
    assert k.canonical(texts[7]) == ["pres", "du", "cour", "n", "#7", "la", "bagu", "guidee"]
    assert len({tuple(k.canonical(t)) for t in texts}) == 200 and len(spelled) < 20


def test_parts_of_a_text_read_as_the_whole():
    pick, signs = random.Random(3), ["-\n", "‐ \n\n", "－\n", "-´\n", "­\n", "\n", "ͺ", "　", "\x85", "が", "か゛", "カ゚", "・", "々", "漢字", "ﬁ", "½", "é", "e\u0301", "\u0301", "한글", "हिन्दी", "ไทยำ", "Ⅷ", "12", "#", "_", " ", "rn", "o", "e", "VV", "а"]
    for _ in range(3000):
        text = "".join(pick.choices(signs, k=pick.randrange(1, 25)))
        whole = k._HYPHEN.sub("", k._plain(text))
        for a, b in k.FOLDS:
            whole = whole.replace(a, b)
        found = k._TOKEN.findall(k._CJK.sub(r" \g<0> ", whole))
        assert ".".join(w.lstrip("#") for w in k.canonical(text)) == ".".join(found)
        assert [w for w in k.canonical(text) if w[0] != "#"] == [w for w in found if w.isalpha()]


def test_letter_windows_of_several_texts_have_their_own_keys_and_counts():
    texts = [" ".join("所谓中空电极是指锁定琦澜"), "ring 4 " + " ".join("所谓中空电极") + " ring " + " ".join("中空电极是指锁"), "ring", " ".join("极是指锁定琦澜")]
    texts = [k.canonical(t) for t in texts]
    which, at, keys = k.letter_keys([k._letters(" ".join(t)) for t in texts])
    expected = [(i, p, x) for i, t in enumerate(texts) for p, x in k.letter_windows(k.words(t))]
    assert list(zip(which.tolist(), at.tolist())) == [(i, p) for i, p, _ in expected]
    assert len(set(keys.tolist())) == len({x for _, _, x in expected}) == len({(key, x) for key, (_, _, x) in zip(keys.tolist(), expected)})
    counts = k._Counts(SimpleNamespace(value=k.KeySet(3, b"\xff")))
    counts.add([([" ".join(t)], " ".join(t)) for t in texts])
    assert dict(zip(*counts.taken())) == Counter(x for t in texts for x in {*k.words(t), *("=" + g for _, g in k.letter_windows(k.words(t)))})


def test_windows_are_typed():
    ordinary = frozenset("the coil carries at a".split())
    one, other = (list(k.slot_windows(k.canonical(t), ordinary)) for t in ("the coil 7 carries skovetror 5 mm plinadax", "the coil 88 carries skovetror 9 kg morquadon"))
    assert one[:2] == other[:2] and one[2:] != other[2:]  # numbers, units and other names are placeholders; the slot's own value counts


def test_other_parameters_of_an_item_are_told_from_leaks(spark):
    docs = [sentence(*NAMES[:3]), sentence(*NAMES[:3]).replace("5", "6"), sentence(NAMES[0], *NAMES[8:10])]
    docs += [f"{o} and then more text" for _, o in OTHERS]  # the corpus shows what the template is
    items = [(1, ITEM), *OTHERS]
    got = k.leaked_passages(spark.createDataFrame(list(enumerate(docs)), DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r["doc_id"], r["kind"], r["numbers_same"]) for r in got if r["item_id"] == 1 and r["doc_id"] < 3) == [(0, "leak", 1.0), (1, "leak", 0.0), (2, "reparameterised", 1.0)]


def test_bitmap_holds_every_key(spark):
    keys = [k._hash(str(i).encode()) for i in range(500)]
    made = k.key_set(spark.createDataFrame([(x,) for x in keys], "key long"), 500)
    assert all(x in made for x in keys) and sum(k._hash(f"x{i}".encode()) in made for i in range(10_000)) < 50


def test_passage_in_any_writing_is_found(spark):
    one = sentence(*NAMES[:3])
    docs = [
        "Before it. " + one + " After it.", one.upper(), one.replace(",", "").replace(".", ""), one.replace(" ", "\n"), one.replace("a", "а").replace("e", "е"),
        one.replace("sealed", "closed").replace("outer", "inner"), one.replace("plinadax", "plina-\ndax"), one.replace("5", "9"), one.replace("carries", "camies"),
    ]
    assert found(spark, docs) == [(i, 1) for i in range(len(docs))]


def test_other_texts_are_not_found(spark):
    docs = [
        sentence(*NAMES[6:9]),  # the same template with other names
        "The sealed skovetror coil carries the plinadax trumovil bracket.",  # too short
        "skovetror plinadax trumovil gaberuth " * 8,  # the names alone
        "", None, " ",
    ]
    assert found(spark, docs) == []


def test_shared_passages_count_for_every_item_and_repeats_for_every_document(spark):
    one = sentence(*NAMES[:3])
    items = [(1, ITEM), (2, "Quite another start. " + one), (3, sentence(*NAMES[9:12])), (None, one), (4, None), (5, "")]
    assert found(spark, [one, one, "x " + one], items) == [(d, i) for d in range(3) for i in (1, 2)]


def test_letters_count_in_chinese(spark):
    item = "所谓中空电极是指锁定琦澜默的任何柏棱瑞滚轮例如开口策佳泰转子不包括多孔铠诺维轴承本身并且佩森佳传感器不会泄漏"
    doc = "前文很长。" + item[:20] + "，" + item[20:40] + "。后文。"
    assert found(spark, [doc, item[:24], item[:10] + "某" + item[11:45]], [(7, item)]) == [(0, 7), (2, 7)]


def test_very_long_text(spark):
    filler = " ".join(f"word{'abcdefghij'[i % 10]} other" for i in range(200_000))
    docs = spark.createDataFrame([(1, filler + " " + sentence(*NAMES[:3]) + " " + filler)], DOCS)
    items = spark.createDataFrame([(i, sentence(*random.Random(i).sample(NAMES[3:], 3))) for i in range(5)] + [(9, ITEM)], ITEMS)
    assert [(r["doc_id"], r["item_id"]) for r in k.leaked_passages(docs, items).filter("kind = 'leak'").collect()] == [(1, 9)]


def test_passage_shared_by_any_number_of_items(spark):
    latin, chinese = sentence(*NAMES[:3]), "所谓中空电极是指锁定琦澜默的任何柏棱瑞滚轮例如开口策佳泰转子不包括多孔铠诺维轴承"
    for shared in (latin, chinese):
        for n in (2, 4, 40):
            items = [(i, f"{sentence(f'aa{chr(97 + i % 26)}x{chr(97 + i // 26)}q', 'bb', 'cc')} {shared}" if shared is latin else shared + chr(0x5000 + i) * 12) for i in range(n)]
            assert found(spark, ["before it " + shared + " after it"], items) == [(0, i) for i in range(n)]


def test_empty_tables(spark):
    empty_docs, empty_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert k.leaked_passages(empty_docs, spark.createDataFrame([(1, ITEM)], ITEMS)).count() == 0
    assert k.leaked_passages(spark.createDataFrame([(1, ITEM)], DOCS), empty_items).count() == 0


def test_items_repeated_more_often_than_names_may_be_are_found_under_each_id(spark):
    items = [(i, ITEM) for i in range(1, 8)]
    assert found(spark, [sentence(*NAMES[:3]), sentence(*NAMES[6:9])], items) == [(0, i) for i in range(1, 8)]


def test_passage_in_many_items_is_found_for_each(spark):
    items = [(i, f"{sentence(*(w + x for w in ('begin', 'middle', 'last')))} {sentence(*NAMES[:3])}") for i, x in enumerate("abcdefghk")]
    exchanged = sentence(*NAMES[:3]).replace("sealed", "closed")
    assert found(spark, [sentence(*NAMES[:3]), exchanged, sentence(*NAMES[6:9])], items) == [(d, i) for d in (0, 1) for i in range(9)]


def test_chinese_passage_in_many_items_is_found_for_each(spark):
    shared = "所谓中空电极是指锁定琦澜默的任何柏棱瑞滚轮例如开口策佳泰转子不包括多孔铠诺维轴承"
    items = [(i, shared + x * 12) for i, x in enumerate("甲乙丙丁戊己")]
    assert found(spark, [shared, shared[:10] + "某" + shared[11:]], items) == [(d, i) for d in (0, 1) for i in range(6)]


def test_passage_of_words_that_all_items_hold_is_found(spark):
    common = "the part is held by the ring and the ring is kept in the case with the part below it".split()
    orders = [random.Random(i).sample(common, len(common)) for i in range(6)]
    items = [(i, " ".join(o)) for i, o in enumerate(orders)]
    text = " ".join(orders[2][:6] + ["other"] + orders[2][7:])
    assert found(spark, ["before " + " ".join(orders[4]) + " after", text], items) == [(0, 4), (1, 2)]
