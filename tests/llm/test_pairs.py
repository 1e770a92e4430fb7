import numpy as np

from lathework.llm import pairs as op

Q = "How often must the pump of the QV-4100 be serviced?"
ZH = "QV-4100的减速机多久保养一次？"
CASES = [
    ("empty", [(Q, ""), (Q, None), (Q, " 　​"), (Q, "N/A"), (ZH, "暂无"), (ZH, "……"), (ZH, "答："), (Q, "-"), (Q, "<br>")]),
    ("copies_question", [(Q, Q), (Q, Q[:-1] + "."), (ZH, "问题：" + ZH), (ZH, ZH + ZH), (ZH, f"您的问题是“{ZH}”")]),
    ("refusal", [(Q, "Sorry, I cannot answer this question."), (ZH, "很抱歉，知识库中没有找到相关内容。"), (Q, "Unfortunately, the documents do not contain this information. Please contact the manufacturer.")]),
    ("other_language", [(Q, "减速机每 300 小时保养一次。"), (ZH, "The gear is serviced every 300 hours."), (Q, "Die Wartung erfolgt alle 300 Stunden, bei Staub früher."), (ZH, "Обслуживание выполняется каждые 300 часов.")]),
    ("truncated", [(Q, "The pump is serviced every 300 hours because of"), (ZH, "减速机每 300 小时保养一次，"), (ZH, "保养周期为 300 小时。如发现异常，应提"), (Q, "Service the pump every 300 hours (see"), (Q, "Service the pump every…")]),
    (None, [
        (Q, "Service the pump every 300 hours."), (Q, "300 hours"), (ZH, "300 小时"), (ZH, "减速机每 300 小时保养一次。"), (ZH, ZH[:-1] + "：减速机每 300 小时保养一次。"), ("“减速机”用英语怎么说？", "gear reducer"),
        ("请把“泵”翻译成英文", "It is called pump."), (Q, "Sorry for the delay. The pump is serviced every 300 hours."), (ZH, "不能带电操作。关闭总阀以后，每 300 小时保养一次。"), (ZH, "每 300 小时。屏幕显示“PUMP NOT READY, CHECK CABLE”时按此处理。"),
        ("备件号？", "HÉL-71760"), ("备件号？", "SN 10.460-X"),
    ]),
]


def test_defects(spark):
    good = [(f"g{i}", f"How often must the pump {i} of the QV-{i} be serviced?", f"Service the pump every {i}0 hours.") for i in range(1, 150)]
    good += [(f"z{i}", f"QV-{i}的减速机多久保养一次？", f"保养周期为 {i}0 小时。如发现异常，应提前检查。") for i in range(1, 150)]
    rows, want = list(good), {k: None for k, _, _ in good}
    for d, pairs in CASES:
        for i, (q, a) in enumerate(pairs):
            rows += [(f"{d}{i}", q, a)] * 2
            want[f"{d}{i}"] = d
    found = op.labelled(spark.createDataFrame([(*r, 1) for r in rows], "row_key string, question string, answer string, labels int"))
    assert found.count() == len(want)
    got = {k: None for k in want} | {r.row_key: r.defect for r in op.one_defect(found).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_nothing_to_label(spark):
    empty = spark.createDataFrame([], "row_key string, question string, answer string")
    assert op.one_defect(op.labelled(empty)).count() == 0
    one = spark.createDataFrame([("a", None, None), ("b", None, "word " * 2_000 + "end.")], "row_key string, question string, answer string")
    assert {r.row_key: r.defect for r in op.one_defect(op.labelled(one)).collect()} == {"a": "empty"}


def test_label_model_recovers_planted_labels():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.06
    behaviour = np.array([op.SURE_FOR, op.LIKELY_FOR, op.HINT_FOR, op.SURE_AGAINST])
    true = np.array([(0.7, 0.004, 0.05, 0.4), (0.5, 0.02, 0.05, 0.3), (0.3, 0.06, 0.1, 0.3), (0.001, 0.001, 0.05, 0.6)])
    votes = np.zeros((len(truth), 4), int)
    for f, (p1, p0, n1, n0) in enumerate(true):
        u = r.random(len(truth))
        p, n = np.where(truth, p1, p0), np.where(truth, n1, n0)
        votes[:, f] = np.where(u < p, 1, np.where(u < p + n, -1, 0))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, share, _ = op.fit_label_model(patterns, counts.astype(float), behaviour)
    labelled = [np.bincount(inverse.ravel()[:4000][truth[:4000] == t], minlength=len(patterns)).astype(float) for t in (True, False)]
    kept = posterior[inverse.ravel()] >= op.best_cutoff(posterior, *labelled, share)
    precision, recall = (kept & truth).sum() / kept.sum(), (kept & truth).sum() / truth.sum()
    assert precision > 0.85 and recall > 0.75 and 0.03 < share < 0.1


def test_evidence_outweighs_the_outset():
    """The outset has the weight of a fixed number of pairs: with more pairs the fitted behaviour nears the true one."""
    patterns, behaviour = np.array([[1, 1], [1, 0], [0, 1], [0, 0], [-1, -1]]), np.array([op.SURE_FOR, op.SURE_FOR])
    counts = np.array([500.0, 100, 100, 9300, 10_000])
    few, many = (op.fit_label_model(patterns, counts * k, behaviour)[2] for k in (1, 1000))
    true = 0.857  # of the pairs with a vote, each function misses one in seven
    assert abs(many[0, 1, 2] - true) < abs(few[0, 1, 2] - true) and abs(many[0, 1, 2] - true) < 0.03


def test_continuations_equal_brute_force(spark):
    import random

    r = random.Random(2)
    texts = ["".join(r.choice("ab ") for _ in range(r.randint(3, 14))) for _ in range(120)]
    complete = [(t, r.randint(1, 3)) for t in sorted(set(texts))]
    stems = sorted({t[: r.randint(1, len(t))] for t in texts})
    got = {x.stem: (x.goes_on, x.one_way) for x in op.continuations(spark.createDataFrame(complete, "am string, n long"), spark.createDataFrame([(s,) for s in stems], "stem string")).collect()}
    want = {}
    for s in stems:
        ways = {}
        for t, n in complete:
            if len(s) > 1 and t.startswith(s) and len(t) > len(s):
                ways[t[len(s)]] = ways.get(t[len(s)], 0) + n
        if ways:
            want[s] = (sum(ways.values()), max(ways.values()))
    assert got == want != {}


def test_truncated_answers_are_found_at_every_size(spark):
    """The same pairs repeated ten times under new ids give the same rows ten times."""
    good = [(f"g{i}", f"How often must the pump {i} of the QV-{i} be serviced?", f"Service the pump every {i}0 hours.") for i in range(1, 60)]
    bad = [(f"t{i}", f"How often must the pump {i} of the QV-{i} be serviced?", f"Service the pump every {i}0") for i in range(1, 5)] + [("u", Q, "The interval is 300 hours. The steps are:\n1.")]
    found = []
    for times in (1, 10):
        rows = [(f"{k}#{n}", q, a) for k, q, a in good + bad for n in range(times)]
        out = op.one_defect(op.labelled(spark.createDataFrame(rows, "row_key string, question string, answer string"))).collect()
        found.append(sorted((r.row_key.split("#")[0], r.defect) for r in out))
    assert found[1] == sorted(found[0] * 10) and ("u", "truncated") in found[0]


def test_cutoff_is_the_best_on_labelled_pairs():
    posterior, share = np.array([0.99, 0.9, 0.9, 0.7, 0.6, 0.2]), 0.1
    cutoff = lambda right, wrong: op.best_cutoff(posterior, np.array(right, float), np.array(wrong, float), share)
    assert 0.6 < cutoff([50, 30, 10, 10, 0, 0], [0, 0, 0, 5, 500, 500]) < 0.7
    assert 0.5 < cutoff([50, 30, 10, 10, 0, 0], [0, 0, 0, 0, 0, 900]) <= 0.6  # patterns that the labelled set lacks do not raise it
    assert cutoff([0] * 6, [1] * 6) == 0.5 == cutoff([1] * 6, [0] * 6)
    assert 0.7 < cutoff([50, 30, 10, 1, 0, 0], [0, 0, 0, 300, 0, 600]) < 0.9


def test_planted_pairs_have_their_defect(spark):
    good = [(f"g{i}", f"How often must the pump {i} of the QV-{i} be serviced?", f"The pump of the QV-{i} must be serviced every {i}0 hours.") for i in range(30)] + [(f"z{i}", ZH, f"减速机的保养周期为 {i}0 小时，如发现异常，应提前检查。") for i in range(30)]
    bad = [("c", Q, "You asked: " + Q), ("r", Q, "Sorry, I cannot answer this question at all."), ("l", Q, "Die Wartung erfolgt alle 300 Stunden, bei Staub früher.")]
    p = op.planted(spark.createDataFrame(good + bad, "row_key string, question string, answer string"), 1000)
    rows = p.collect()
    kinds = {r.planted for r in rows}
    assert kinds == {"none", *op.DEFECTS} and all(r.row_key is None for r in rows)
    assert sum(r.planted == "none" for r in rows) == 60 and all(r.answer == r.question for r in rows if r.planted == "copies_question")
    assert all(("小时" in r.answer) != ("减速机" in r.question) for r in rows if r.planted == "other_language")
    assert op.planted(spark.createDataFrame(good, "row_key string, question string, answer string"), 7).where("planted = 'none'").count() == 7


def test_planted_pairs_come_from_all_sound_pairs_by_default(spark):
    zh = [(f"z{i}", f"第{i}号减速机多久更换一次润滑油？", f"第{i}号每运行{i}小时更换一次，并且检查油位。") for i in range(2100)]
    en = [(f"e{i}", f"How often is the oil of gear {i} changed?", f"The oil of the gear is changed every {i} hours and is then checked.") for i in range(2100)]
    rows = op.planted(spark.createDataFrame(zh + en, "row_key string, question string, answer string"), bucket=500).groupBy("planted").count().collect()
    n = {r.planted: r["count"] for r in rows}
    assert n["none"] == n["truncated"] == n["refusal"] == 4200 and n["other_language"] > 3500
