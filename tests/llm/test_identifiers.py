import pytest

from lathework.llm import lookalikes as op

CATALOG = [(1, "m", "QV-4100"), (2, "m", "LTX-5²"), (3, "m", "LTX-52"), (4, "m", "KRO-010"), (5, "m", "KRO-O10"), (6, "m", "CÔR-9"), (7, "m", "ТОР 7"), (8, "m", "ｶﾞｲ-9"), (9, "m", "HLM IV"), (10, "m", "TMX™-8"), (11, "m", "FLT-Ø4"), (12, "n", "QV-4100"), (13, "m", "AL-0°")]


def found(spark, values, **more):
    rows = [(i, v, "clash", 5) for i, v in enumerate(values)]
    records = spark.createDataFrame(rows, "record_id long, m string, value string, item_id int")
    catalog = spark.createDataFrame(CATALOG, "item_id int, field_name string, canonical_value string")
    out = op.misspelt_identifiers(records, catalog, key="record_id", fields=["m"]).collect()
    assert len({(r.record_id, r.field_name) for r in out}) == len(out)
    return {r.record_id: r.item_id for r in out}


@pytest.mark.parametrize(
    ("value", "item"),
    [
        ("ＱＶ－４１００", 1), ("QV‑4100", 1), ("QV–4100", 1), ("Q​V-41­00", 1), ("　QV-4100 ", 1), ("﻿QV-4100", 1), ("LTХ-5²", 2), ("КRО-O10", 5), ("KRO-О10", 5),
        ("CÔR-9", 6), ("СÔR−9", 6), ("TOP 7", 7), ("TOP 7", 7), ("ガイ-9", 8), ("HLM Ⅳ", 9), ("ΤΜΧ™‐8", 10), ("FLT-⌀4", 11), ("AL-0˚", 13), ("𝐐V-4100", 1),
    ],
)
def test_drawn_alike(spark, value, item):
    assert found(spark, [value]) == {0: item}


def test_other_identifiers_and_right_ones(spark):
    others = ["QV-4100", "  QV-4100 ", "qv-4100", "LTX-5 2", "COR-9", "TMXTM-8", "QV-41OO", "QV4100", "QV-4100²", "KRO-0l0", "", " ", None, "​", "AL-00", "тор 7", "x" * 5000]
    assert found(spark, others) == {}


def test_repeated_rows_ties_and_empty_tables(spark):
    got = found(spark, ["QV­-4100"] * 50 + ["LTX-5²‍"])
    assert got == {i: 1 for i in range(50)} | {50: 2}
    assert found(spark, []) == {}


def test_classes_do_not_depend_on_row_order(spark):
    rows = [("s", "Å-1", None), ("s", "Å-1", None), ("s", "Å-1", None), ("t", "Å-1", 3)]
    get = lambda r: {(x.scope, x.value): x.canonical for x in op.look_alike_classes(spark.createDataFrame(r, "s string, v string, n int"), scope="s", value="v", rank="n").collect()}
    assert get(rows) == get(rows[::-1])
    assert len({c for (s, _), c in get(rows).items() if s == "s"}) == 1
