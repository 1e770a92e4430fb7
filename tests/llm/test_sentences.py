import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lathework.llm import sentences as op


def cut(t):
    return [t[a - 1 : b] for a, b in op.sentence_spans(t)]


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Lang came at 3 p.m.", "He left.", "See Fig. 3 and Sec. 4.", "Ask J. R. Moor!", "Use e.g. oil X.8, not fat.", "Is it?!", "pH is 7.", "It costs approx. 5.20 vs. 6."],
        ['He said, "It leaks. Nobody saw it." and left.', "(It is old.)", 'The label says "No."', '"Stop!" she shouted.', "Wait... then go.", "Then v1.2.3 came."],
        ["Am 17. Mai kam z. B. Hr. Lang.", "Die 2. Schicht beginnt um 6.30 Uhr.", "Nötig sind Ringe usw.", "„Halt! Nein.“ rief er.", "Max. 3 mm bzw. min. 2 mm."],
        ["«Стоп!» — крикнул он.", "В 2012 г. заменили масло, шайбы и т. д.", "См. рис. 3 и табл. 6.", "Длина 2,5 м, т. е. мало."],
        ["¿Hay aceite?", "El Sr. Lang midió aprox. 9,9 mm.", "«¡Alto!», gritó el operario.", "El núm. 7 sustituye al núm. 8."],
        ["डॉ. वेल्टम ने 1.10 mm मापा।", "क्या आपूर्ति बंद है?", "“रुको!” कहकर चालक गया।", "कि.ग्रा. में भार 2.65 है।"],
        ["هل أغلق الصمام؟", "صاح العامل: «توقف!» ثم ضغط الزر.", "وزن القطعة 3.08 كغ؛ والقديمة أثقل."],
        ["“멈춰!”라고 그가 외쳤습니다.", "No. 63 도면을 보십시오.", "약 9.9 mm입니다."],
    ],
)
def test_units_separated_by_spaces(units):
    assert cut(" ".join(units)) == units


@pytest.mark.parametrize(
    "units",
    [
        ["他问“行吗？”，我说“不行。”", "标签上写着“严禁拆卸。”", "“还能用吗？”师傅问道。", "他把“先断电。再验电。”这六个字贴上。", "（注意：易损。）", "编号No. 9，径3.5mm。", "等待……直到停止。", "项目：1.油位；2.阀。", "真的吗？！"],
        ["「止めて！」と叫んだ。", "銘板に「禁止。」と書かれている。", "（消耗品です。）", "Ver.27.5以降です。", "１．５倍です．"],
        ["หมุนช้า ๆ จนหยุด"],
    ],
)
def test_units_without_spaces(units):
    assert cut("".join(units)) == units


def test_wide_gaps():
    for n in (1, 39, 40, 80):
        gap = " " * n
        assert cut(f"Ask Dr.{gap}Smith now. Then go.") == [f"Ask Dr.{gap}Smith now.", "Then go."]
        assert len(cut(f"„Halt!“{gap}{' ' * 30}rief der Mann. Er ging.")) == 2


def test_thai_spaces():
    units = ["ใช้จาระบีเบอร์ 2 หรือ 3 เท่านั้น", "หมุนแหวนซีลช้า ๆ จนหยุดสนิท", "ตั้งสำหรับเครื่อง NØRD IV-47 เท่านั้น", "ทำไมไม่ทำงาน"]
    assert cut(" ".join(units)) == units


def test_layout():
    t = "  Safety notes\n\n1. Stop the\nmachine.\n \n(2) Go\n\nNo mark at the end"
    assert cut(t) == ["Safety notes", "1. Stop the\nmachine.", "(2) Go", "No mark at the end"]
    assert cut("oil.Check it.夜班发现。Old parts.9 bolts hold it.") == ["oil.", "Check it.", "夜班发现。", "Old parts.", "9 bolts hold it."]
    assert cut("") == cut(" \n\n ") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB. !?\n“”\"()。「」ก1…е́", max_size=80))
def test_units_cover_everything_visible_once(t):
    spans = op.sentence_spans(t)
    assert all(a <= b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    inside = {i for a, b in spans for i in range(a, b + 1)}
    assert all(c.isspace() or i in inside for i, c in enumerate(t, 1))
    assert all(not t[a - 1].isspace() and not t[b - 1].isspace() for a, b in spans)


def test_table(spark):
    long = "Old parts get a tag. " * 5000
    d = spark.createDataFrame([(1, "A b. C d.", 0), (1, "A b. C d.", 0), (2, None, 1), (3, " ", 1), (4, long, 1), (5, "😀 ok. Yes.", 2)], "doc_id long, text string, spans int")
    got = [tuple(r) for r in op.sentences(d, key="doc_id", text="text").collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, 1, 1, 4), (1, 2, 6, 9)]
    assert sum(x[0] == 4 for x in got) == 5000 and sorted(x[2:] for x in got if x[0] == 5) == [(1, 5), (7, 10)]
    assert op.sentences(d.limit(0), key="doc_id", text="text").count() == 0


def test_abbreviations_of_other_languages_end_sentences():
    assert cut("Keep the limit in mind. Then start the pump.") == ["Keep the limit in mind.", "Then start the pump."]
    assert cut("Set it to max. The valve opened.") == ["Set it to max.", "The valve opened."]
    assert cut("Der Druck ist max. Wert der Anlage. Danach prüfen.") == ["Der Druck ist max. Wert der Anlage.", "Danach prüfen."]
    assert cut("Set it to max. 5 bar now.") == ["Set it to max. 5 bar now."]


def test_repeated_rows_count_once_in_lengths(spark, tmp_path):
    from lathework.llm.q_sentences import p8_lengths

    spark.createDataFrame([(1, "One. Two.", "en")] * 2 + [(2, None, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.lang, r.n_sentences) for r in p8_lengths(spark, str(tmp_path)).collect()] == [("en", 2)]
