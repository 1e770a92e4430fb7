import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lathework.llm import containers, mixing
from lathework.llm.tokens import VOCABULARY, encoding, n_tokens


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=15))
def test_plan_is_as_good_as_best_fit_on_single_items(capacity, counts):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    plan = containers.plan_containers(capacity, dict(counts))
    used = {}
    for n, slots in plan:
        assert n >= 1 and sum(s * k for s, k in slots) <= capacity
        for s, k in slots:
            used[s] = used.get(s, 0) + n * k
    assert used == counts
    free = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [f for f in free if f >= s]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - s)
        else:
            free.append(capacity - s)
    assert sum(n for n, _ in plan) <= len(free) * 1.1 + 1


def test_containers(spark):
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(0, 25, 400)] + [7] * 300
    items = [(i, s, ["en", "de", None][i % 3], "clash") for i, s in enumerate(sizes)] + [(1000, 95, "en", "x"), (1000, 95, "en", "x"), (1001, None, "en", "x"), (None, 4, "en", "x")]
    df = spark.createDataFrame(items, "item_id long, size int, scope string, bucket string")
    specs = spark.createDataFrame([(1, 30, None), (2, 10, "en"), (3, 50, "xx"), (4, 0, None)], "spec_id int, capacity int, scope string")
    filled = containers.fill_containers(df, specs, per_bucket=20)
    out = filled.collect()
    report = {r.spec_id: r for r in containers.fill_report(filled, specs).collect()}
    assert all((r.n_overfull, r.n_split, r.n_gaps) == (0, 0, 0) for r in containers.rules_report(filled, specs).collect())
    broken = filled.withColumn("size", F.col("size") * 9)
    assert all(r.n_overfull for r in containers.rules_report(broken, specs).collect())
    for spec, cap, scope in ((1, 30, None), (2, 10, "en"), (3, 50, "xx")):
        mine = [r for r in out if r.spec_id == spec]
        want = {i: s for i, s, sc, _ in items if s and i is not None and scope in (None, sc)}
        pieces = {}
        for r in mine:
            pieces.setdefault(r.item_id, []).append((r.token_start, r.size))
        assert {i: sum(n for _, n in p) for i, p in pieces.items()} == want
        assert all(len(p) == max(1, -(-want[i] // cap)) for i, p in pieces.items())
        assert all(a + n == b for p in pieces.values() for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:]))
        boxes = {}
        for r in mine:
            boxes.setdefault(r.container_no, []).append((r.place, r.offset, r.size))
        for box in boxes.values():
            box.sort()
            assert [p for p, _, _ in box] == list(range(1, len(box) + 1)) and box[0][1] == 0
            assert all(o + n == q for (_, o, n), (_, q, _) in zip(box, box[1:])) and box[-1][1] + box[-1][2] <= cap
        assert sorted(boxes) == list(range(1, len(boxes) + 1))
        assert len(boxes) <= report[spec].least_containers * 1.1 + 1 if mine else spec not in report
    assert containers.fill_containers(df.limit(0), specs).count() == 0


def test_rake_meets_all_marginals_where_it_can():
    tokens = np.array([100.0, 50, 80, 20, 60, 40])
    source, lang = np.array(["a", "a", "b", "b", "c", "c"]), np.array(["x", "y"] * 3)
    w = mixing.rake(tokens, [source, lang], [{"a": 120.0, "b": 60.0, "c": 20.0}, {"x": 140.0, "y": 60.0}], np.full(6, 10.0))
    got = lambda lab, k: float((w * tokens)[lab == k].sum())
    assert got(source, "a") == pytest.approx(120) and got(source, "c") == pytest.approx(20) and got(lang, "x") == pytest.approx(140, rel=1e-3)
    capped = mixing.rake(tokens, [source], [{"a": 1e9, "b": 10.0, "c": 0.0}], np.full(6, 2.0))
    assert list(capped[:2]) == [2, 2] and capped.max() <= 2


def test_mix(spark):
    rng = np.random.default_rng(1)
    docs = [(i, ["A-x", "a_X ", "b", "c", None, "zz"][i % 6], [None, "en", "de"][i % 3], "t", int(rng.integers(1, 60))) for i in range(600)]
    docs += docs[:5] + [(9000, "b", "en", "t", 4000), (9001, "b", "en", None, 0), (9002, "b", "en", "t", None)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, source string, lang string, topic string, n_tokens int, bucket int")
    t = spark.createDataFrame([(1, "a_x", 0.5, 3), (1, "b", 0.3, 3), (1, "c", 0.2, 3), (2, "c", 2.0, 1), (2, "none", 1.0, 1), (3, "none", 1.0, 2)], "mix_id int, source string, target_share double, max_repeats int")
    sel = mixing.mix_sources(d, t, per_bucket=40)
    rows = sel.collect()
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows) and all(1 <= r.repeats <= (3 if r.mix_id == 1 else 1) for r in rows)
    rep = {(r.mix_id, r.source): r for r in mixing.mix_report(sel, t).collect()}
    assert len(rep) == 6 and all(abs(rep[1, s].actual_share - rep[1, s].target_share) < 0.02 for s in ("a_x", "b", "c"))
    assert rep[2, "c"].actual_share == 1 and rep[2, "none"].n_tokens == 0 and rep[3, "none"].actual_share == 0
    assert mixing.mix_sources(d.limit(0), t).count() == 0
    limits = {(r.mix_id, r.source): r for r in mixing.reach_report(d, t).collect()}
    assert sum(r.limits for (m, _), r in limits.items() if m == 1) == 1 and limits[2, "c"].target_share == 1
    total = sum(r.n_tokens * r.repeats for r in rows if r.mix_id == 1)
    assert total <= min(r.total_if_limit for (m, _), r in limits.items() if m == 1) + 100
    shares = mixing.marginal_report(sel, d).groupBy("mix_id", "marginal").agg(F.sum("actual_share").alias("a"), F.sum("pool_share").alias("p")).collect()
    assert shares and all(r.a == pytest.approx(1) and r.p == pytest.approx(1) for r in shares)


def test_token_counts(spark):
    d = spark.createDataFrame([("hello world",), ("",), (None,), ("主轴 <|endoftext|>",), ("x " * 50_000,)], "t string")
    got = [r[0] for r in d.select(n_tokens()(F.col("t"))).collect()]
    words = encoding(VOCABULARY)
    assert b"".join(words.decode_single_token_bytes(x) for x in words.encode_ordinary("hello world")) == b"hello world"
    assert got[0] == len(words.encode_ordinary("hello world")) and got[1] == 0 and got[2] is None and got[3] > 3 and got[4] >= 50_000
