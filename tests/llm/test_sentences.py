import pytest

from marlstone.llm.sentences import sentence_units, split

#: Sentences parted by | stand for text with one space, or none where the script has none.
CASES = [
    "Dr. Amsel met J. R. Corvane. | They left at 9 a.m. each day. | No. 5 stays!",
    "See Fig. 2, Sec. 6.5 and p. 530. | The U.S. mirror is e.g. smaller, i.e. older.",
    "Paths, digests, etc. | The token does not.",
    "He asked: 'Is it safe?' and nobody answered. | “Is it? No.” asked the owner. | Fine.",
    "(It was removed (cf. No. 4).) | The edge stays (see Sec. 4.) and waits. | Done?! | Yes...",
    "Wait... is it safe? | iOS code too. | `x.y` returns.",
    "It ends.[3] | The next [8, 1]. | See footnote 1). | It explains.",
    "Das gilt z. B. für Tests, d. h. nicht hier. | Seit dem 5. Mai wartet Prof. Dr. Frei. | Gut.",
    "Er schrieb: „Alt. Bitte neu.“ und ging. | „Ganz neu.“ | Ende.",
    "La relectrice a noté : « Périmé. Il faut le refaire. » puis elle est partie. | Cf. la fig. 9. | Une preuve... est-elle utile ?",
    "El Sr. Valdoro dijo: «Viejo. Hay que rehacerlo.» y cerró. | ¿Qué? | ¡Ya! | Los EE. UU. usan otro.",
    "См. рис. 2 на стр. 54. | Это т. е. раз за запуск, и т. д. | Потом всё.",
]
TIGHT = ["第一句。|第二句！|“先不要发布。”|评审写道：“过期。请重做！”然后关闭了。|读 a.md……然后回来。|完。", "これは古い。|（削除済み。）|担当者は「古い。直す。」と書いた。|終わり！", "这是 v1.2.3 的行号。|报告？！|好。"]


def pieces(text):
    return [text[a:b] for a, b in split(text)]


@pytest.mark.parametrize("case", CASES)
def test_spaced(case):
    want = case.split(" | ")
    assert pieces(" ".join(want)) == want
    assert pieces("\n".join(want)) == want  # a line break is no boundary and no obstacle


@pytest.mark.parametrize("case", TIGHT)
def test_unspaced(case):
    assert pieces(case.replace("|", "")) == case.split("|")


def test_thai_hindi_arabic_korean():
    assert pieces("โมดูลนี้อ่านไฟล์ ตัวอ่านรอ") == ["โมดูลนี้อ่านไฟล์", "ตัวอ่านรอ"]
    assert pieces("यह बदला। संख्या 2.0.1 नहीं॥ ठीक?") == ["यह बदला।", "संख्या 2.0.1 नहीं॥", "ठीक?"]
    assert pieces("هذا قديم؟ كتب: «قديم. أعد.» ثم أغلق. نعم.") == ["هذا قديم؟", "كتب: «قديم. أعد.» ثم أغلق.", "نعم."]
    assert pieces('"기록이다. 다시." 라고 적었다. 끝.') == ['"기록이다. 다시." 라고 적었다.', "끝."]


def test_blocks():
    text = "# Head. One\nFirst. Second\nline goes on.\n\n- item one. two\n* three\n1. four\n\n```\ncode. here\n\nmore\n```\nLast"
    assert pieces(text) == ["# Head. One", "First.", "Second\nline goes on.", "- item one. two", "* three", "1. four", "```\ncode. here\n\nmore\n```", "Last"]
    assert pieces("a.\r\n\r\nb") == ["a.", "b"]
    assert pieces("```\nopen fence. still") == ["```\nopen fence. still"]


def test_edges():
    assert split(None) == split("") == split(" \n\u3000\u00a0\n") == []
    assert pieces("  x  ") == ["x"]
    assert pieces("no end (open. and on") == ["no end (open.", "and on"]
    long = "Word word word. " * 50_000
    assert len(split(long)) == 50_000
    for t in ("...", "?!", ")", "«", "“", "a." * 1000):
        for a, b in split(t):
            assert 0 <= a < b <= len(t) and t[a:b].strip() == t[a:b]


def test_operator(spark):
    df = spark.createDataFrame([(1, "A. B.", 5), (2, None, 5), (3, "", 5), (4, " ", 5), (1, "A. B.", 5)], "doc_id bigint, text string, start_char bigint")
    got = sorted(tuple(r) for r in sentence_units(df).distinct().collect())
    assert got == [(1, 0, 5)] or got == [(1, 0, 2), (1, 3, 5)]
    assert sentence_units(df.limit(0)).count() == 0


def test_unmatched_brackets_cost_linear_time():
    import time

    for text in ("(" * 500_000 + "]" * 500_000, "“(" * 250_000 + "]’" * 250_000, "`" * 3 + " `` ` " * 200_000):
        t = time.time()
        assert split(text)
        assert time.time() - t < 10


def test_list_levels():
    text = "- one\n  text of it\n  1. inner\n  more\n  2. second\n- two\n\nA line that wraps at\n3. is no list line.\n"
    assert pieces(text) == ["- one", "text of it", "1. inner", "more", "2. second", "- two", "A line that wraps at\n3.", "is no list line."]


def test_a_long_name_before_a_stop():
    name = "A" + "b" * 100
    assert pieces(f"See {name}.Next word.") == [f"See {name}.Next word."]
