import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lathework.llm import pages as op
from lathework.llm.automata import Trie

WORD = st.text(alphabet="abcl1", min_size=1, max_size=6)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if False else _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


@settings(max_examples=100, deadline=None)
@given(st.lists(WORD, max_size=20), WORD, st.integers(0, 2))
def test_trie_finds_all_words_within_the_distance(words, query, most):
    assert sorted(Trie(words).within(query, most)) == sorted((w, distance(query, w)) for w in set(words) if distance(query, w) <= most)


def test_line_kinds():
    title = "QV-4100 Operating Manual"
    yes = {"page_number": ["17", "Page 4 of 184", "Pa9e l2 of l84", "- 8 -", "· 12 ·", "[9]", "第 9 页", "第9页 共99页", "3/96", "p. 7", "Seite 3 von 9", "ll", "—5—"], "running_header": [title, "4  |  " + title, "Norvex — " + title, title + " · Rev 2.4", "QV-4l00 Opcrating Manual    7", title.upper()]}
    for kind, lines in yes.items():
        for s in lines:
            assert op.line_kinds(["text above.", s, "text"], title)[1] == kind, s
    for s in ["Torque 5", "p. 7).", "See " + title + " for this", "", "15 bolts hold it", "hours."]:
        assert op.line_kinds(["x", s], title)[1] == "", s
    assert op.line_kinds(["Torque (N·m)", "17", "20"], title) == ["", "", ""]
    assert op.line_kinds(["a", "b"], None) == ["", ""]


CLEAN = [
    "Check the frequency inverter of the machine every 300 hours.", "The water-cooled pump is a self-locking unit.", "Clean the filter and record the number of hours.",
    "检查项目包括油位和备件。", "更换滤芯前必须切断电源。", "Tighten the bolts to 38 N·m and wait 14 minutes.", "Use a self-locking unit and a water-cooled pump.",
]
SCAN = (
    "Page 3 of 90\nManual X\nChcck the freqiiency inver-\nter of the rnachine every 30O hours.\nThe water-\ncooled pump is a self-locking unit. Cl0an the fil-\nPage 4 of 90\nter and record the nurnber.\n捡查项目包括油位\n和奋件。更换滤芯前必须切断电\n源。\n"
    "Tighten the bolts to 3B N·m."
)


def tables(spark, extra=()):
    rows = [("t", f"c{i}", f"D{i % 3}", "Title", s * 2, "clash") for i, s in enumerate(CLEAN)] + [("t", "s", "S", "Manual X", SCAN, "clash")] * 2 + list(extra)
    return spark.createDataFrame(rows, "tbl string, row_key string, document string, title string, text string, scan string").drop("scan")


def test_noise_of_a_scan(spark):
    extra = [("t", "n1", None, None, None, ""), ("t", "n2", "D1", None, "", ""), ("t", "n3", "D2", "Title", "Title\nClean the filter.", "")]
    rows, places = op.noisy_places(tables(spark, extra))
    got = {(r.row_key, r.line_no, r.noise_kind) for r in op.noisy_lines(places).collect()}
    lines = SCAN.split("\n")
    at = lambda s: next(i for i, x in enumerate(lines, 1) if x.startswith(s))
    want = {
        ("s", 1, "page_number"), ("s", 2, "running_header"), ("s", 3, "misread"), ("s", 3, "hyphen_break"), ("s", 4, "misread"), ("s", at("cooled"), "hyphen_break"),
        ("s", at("Page 4"), "page_number"), ("s", at("ter and"), "misread"), ("s", at("捡"), "misread"), ("s", at("和奋"), "misread"), ("s", at("Tighten"), "misread"),
    }
    assert got - {("s", at("cooled"), "misread")} == want
    mended = {r.row_key: r.text for r in op.repaired(rows, places).collect()}["s"]
    assert "Check the frequency inverter of the machine every 300 hours." in mended and "water-cooled pump" in mended and "检查项目包括油位和备件。" in mended
    assert "Page" not in mended and "Manual X" not in mended and "38 N·m" in mended


def test_tables_without_scans(spark):
    rows, places = op.noisy_places(tables(spark).where("row_key <> 's'"))
    assert places.count() == 0 and op.repaired(rows, places).count() == len(CLEAN)
    _, places = op.noisy_places(tables(spark).limit(0))
    assert op.noisy_lines(places).count() == 0


def terms_of(spark, words, queries, near=True):
    """Vocabulary and queries with their segments."""
    yes = F.lit(True)
    of = lambda x, near, spread: spark.createDataFrame([(w,) for w in x], "term string").withColumn("segments", op._segments(F.col("term"), yes, F.lit(near), spread))
    return of(words, True, 0), of(queries, near, 1)


def test_long_words(spark):
    long = "qwertzu" * 60
    words = ["illumination", "communication", "commissioning", long]
    queries = {"il1urninatiqn": "illumination", "i11uminati0n": "illumination", "cornrnunication": "communication", "comrnissi0ning": "commissioning", "x" * 300: None, long[:-1] + "m": None, long.replace("qw", "gvv", 1): None}
    queries |= {long.replace("tz", "f2", 9): long, "e" + "0" * 200_000: None}
    v, q = terms_of(spark, words, queries, near=False)
    assert {r.term: r.candidate for r in op._sharded(v, q, 3).where("alike").collect()} == {k: w for k, w in queries.items() if w}


def test_a_scan_with_a_very_long_word(spark):
    extra = [("t", "s2", "S2", "Manual X", SCAN.replace("\n", "\n" + "path" * 120 + "\n", 2), "")]
    rows, places = op.noisy_places(tables(spark, extra))
    assert {r.row_key for r in op.noisy_lines(places).collect()} == {"s", "s2"}


def test_shards_give_what_one_shard_gives(spark):
    r = random.Random(0)
    words = sorted({"".join(r.choice("aeclotm") for _ in range(r.randint(2, 7))) for _ in range(300)})
    queries = sorted({w.replace("c", "e").replace("m", "rn") for w in words} - set(words))
    v, q = terms_of(spark, words, queries)
    one = {tuple(x) for x in op._sharded(v, q, 10_000).collect()}
    assert {tuple(x) for x in op._sharded(v, q, 20).collect()} == one != set()


def test_every_word_within_one_edit_is_retrieved(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(5, 8))) for _ in range(200)})
    queries = sorted({"".join(r.choice("abcd") for _ in range(r.randint(5, 8))) for _ in range(60)} - set(words))
    got = {(x.term, x.candidate) for x in op._sharded(*terms_of(spark, words, queries), 50).where("distance = 1").collect()}
    assert got == {(q, w) for q in queries for w in words if distance(q, w) == 1} != set()


def line_hits(spark, scans, clean):
    """Misread (row, line) of rows of ``scans``, each a document, beside rows of ``clean``."""
    rows = [("t", f"c{i}", f"D{i}", "Title", s) for i, s in enumerate(clean)] + [("t", k, k, "Manual X", s) for k, s in scans.items()]
    _, places = op.noisy_places(spark.createDataFrame(rows, "tbl string, row_key string, document string, title string, text string"))
    return {(r.row_key, r.line_no) for r in op.noisy_lines(places).where("noise_kind = 'misread'").collect()}


def test_misreads_in_unrecognised_scans_do_not_become_words(spark):
    clean = ["Stop the machine and check the valve.", "更换滤芯前必须切断电源。点检表上签字。"] * 60
    noisy = "Manual X\n\nStop the machlne and check the valve.\n更换滤芯前必须切断电源。点捡表上签字。\nPage 4 of 9"
    hidden = {"u": "Stop the machlne and check the valve.\n点捡表上签字。"}
    got = line_hits(spark, {f"s{i}": noisy for i in range(8)} | hidden, clean)
    assert got == {(f"s{i}", n) for i in range(8) for n in (3, 4)} | {("u", 1), ("u", 2)}


def test_rare_words_are_no_misreads(spark):
    clean = ["The test of the valve is done."] * 80 + ["The fest of the town is done."] * 2
    scans = {f"s{i}": "The test of the valve is done.\nPage 4 of 9" for i in range(80)} | {"x": "The fest of the town is done.\nPage 3 of 9"}
    assert line_hits(spark, scans, clean) == set()


def test_a_letter_not_drawn_alike_needs_its_context(spark):
    clean = ["Start the pumps near the door and use the valves now."] * 60 + ["давление масла в норме."] * 60
    scans = {"s": "Start the punps near the door and use the valyes now.\nPage 4 of 9", "r": "Page 2 of 9\nМера давпение масла в норме.", "o": "Page 2 of 9\nOld punps leak."}
    assert line_hits(spark, scans, clean) == {("s", 1)}


def test_thai_characters(spark):
    clean = ["ทำความสะอาดไส้กรองอากาศแล้วเป่าให้แห้ง"] * 40
    assert line_hits(spark, {"s": "Page 2 of 9\nทำความสะอาคไส้กรองอากาศแล้วเป่าให้แห้ง"}, clean) == {("s", 2)}


def test_line_numbers_count_line_feeds_only(spark):
    assert line_hits(spark, {"s": "Page 2 of 9\nStop\rnow.\r\nStop the machlne."}, ["Stop the machine now."] * 30) == {("s", 3)}


def test_lines_that_end_within_identifiers_are_joined():
    assert op.repaired_text("注意：NØR\nD_6574停用超过2\n8天时，由Norvex Co.\nLtd.提供。", []) == "注意：NØRD_6574停用超过28天时，由Norvex Co. Ltd.提供。"
    assert op.repaired_text("Order the\nnew part 20\n30 times", []) == "Order the new part 20 30 times"


def test_no_plan_holds_all_joins(spark, monkeypatch):
    joins = []
    count = lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or df
    write = op.written
    monkeypatch.setattr(op, "written", lambda df, what: write(count(df), what))
    _, places = op.noisy_places(tables(spark))
    count(op.noisy_lines(places))
    assert max(joins) <= 12, joins
