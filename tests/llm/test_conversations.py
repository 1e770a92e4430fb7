import datetime as dt
import random
import time

from lathework.llm import conversations as op

SCHEMA = "id int, session_id string, question string, answer string, timestamp timestamp, ts string, r int"
T0 = dt.datetime(2025, 1, 1)


def brute(rows):
    """The same by plain Python."""
    sees = lambda t: bool(t) and any(not c.isspace() and c not in "​﻿" for c in t)
    by = {}
    for i, s, q, a, t in rows:
        if s and s.strip() and (sees(q) or sees(a)):
            key = (q if sees(q) else None, a if sees(a) else None, t)
            kept = by.setdefault(s.strip().lower(), {})
            kept[key] = min(i, kept.get(key, i))
    out = set()
    for s, kept in by.items():
        if any(t is None for _, _, t in kept):
            continue
        said = []
        for (q, a, t), i in sorted(kept.items(), key=lambda x: (x[0][2], x[0][0] is None, x[1])):
            said += [(i, "user")] * (q is not None) + [(i, "assistant")] * (a is not None)
        if len(said) % 2 == 0 and all(w == ("user", "assistant")[k % 2] for k, (_, w) in enumerate(said)):
            out |= {(s, k + 1, i, w) for k, (i, w) in enumerate(said)}
    return out


def write(spark, tmp_path, rows, parts=1):
    path = str(tmp_path / f"t{random.random()}")
    spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(parts).write.parquet(path)
    return path


def found(spark, path, **options):
    rows = [tuple(r) for r in op.conversations(spark, path, **options).select("session_id", "msg_pos", "id", "speaker").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_rows(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choice(["a", "B ", " b", "c", "d", None, " ", f"s{i // 4}", f"S{i // 4}"])
        t = T0 + dt.timedelta(minutes=i // 2 * r.choice([1, 1, 9]))
        if r.random() < 0.02:
            t = None
        q, a = r.choice([("q", "a"), (f"q{i}", None), (None, f"a{i}"), ("q", ""), ("​", "a"), (" ", None), ("﻿", "\t")])
        rows.append((i, s, q, a, t))
        if r.random() < 0.1:
            rows.append((i + 10_000 if r.random() < 0.5 else i, s, q, a, t))
    return rows


def test_equals_brute_force_in_any_order(spark, tmp_path):
    rows = some_rows(1)
    random.Random(2).shuffle(rows)
    assert found(spark, write(spark, tmp_path, rows)) == brute(rows) != set()


def test_rows_later_than_the_watermark_are_not_lost(spark, tmp_path):
    rows = [(i, f"s{i // 2}", "q" if i % 2 == 0 else None, None if i % 2 == 0 else "a", T0 + dt.timedelta(hours=(97 * i) % 300)) for i in range(60)]
    rows = [(i, s, q, a, T0 + dt.timedelta(hours=5 * (i // 2), minutes=i % 2)) for i, s, q, a, _ in rows]
    random.Random(3).shuffle(rows)
    path = write(spark, tmp_path, rows, parts=6)
    assert found(spark, path, delay="1 minute", bucket="10 minutes", files_per_trigger=1) == brute(rows)


def test_transcripts(spark, tmp_path):
    rows = [(2, "S", None, "a1", T0), (1, "s ", "q1", None, T0), (3, "s", "q2", "a2", T0 + dt.timedelta(days=3)), (4, "x", "q", None, T0)]
    got = op.transcripts(spark, write(spark, tmp_path, rows)).collect()
    assert [(r.session_id, r.part, r.n_messages, [(m.msg_pos, m.speaker, m.content) for m in r.messages]) for r in got] == [
        ("s", 0, 4, [(1, "user", "q1"), (2, "assistant", "a1"), (3, "user", "q2"), (4, "assistant", "a2")])
    ]


def test_empty_table(spark, tmp_path):
    assert found(spark, write(spark, tmp_path, [])) == set()


def test_long_conversations_come_in_parts(spark, tmp_path):
    rows = [(i, "s", f"q{i}", f"a{i}", T0 + dt.timedelta(minutes=i)) for i in range(5)]
    got = op.transcripts(spark, write(spark, tmp_path, rows), per_part=4).orderBy("part").collect()
    assert [(r.part, [m.msg_pos for m in r.messages]) for r in got] == [(0, [1, 2, 3, 4]), (1, [5, 6, 7, 8]), (2, [9, 10])]


def test_late_rows_join_their_open_bucket(spark, tmp_path):
    """Rows that arrive in a later micro-batch, but within the watermark, are in the streamed fragment; later ones need the correction."""
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    path = str(tmp_path / "late")
    batches = [[(1, "s", "q", None, at(1)), (2, "t", "q", None, at(2))], [(3, "x", "q", "a", at(60))], [(4, "s", None, "a", at(3))], [(5, "x", "q", "a", at(900))], [(6, "x", "q", "a", at(901))], [(7, "t", None, "a", at(4))]]
    for rows in batches:  # one file after the other, so that they are read in this order
        spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    options = {"delay": "3 hours", "bucket": "1 hour", "files_per_trigger": 1}
    streamed = {(r.session_id, r.start): r.n_rows for r in op.stream_fragments(spark, path, **options).collect()}
    assert streamed["s", T0] == 2 and streamed["t", T0] == 1
    assert found(spark, path, **options) == brute([r for b in batches for r in b])


def test_replay_gives_the_same(spark, tmp_path):
    rows = some_rows(5, 200)
    path = write(spark, tmp_path, rows)
    assert found(spark, op.replayed(spark, path, 4), files_per_trigger=1) == brute(rows)


def test_times_before_1970_and_unknown_times(spark, tmp_path):
    old = dt.datetime(1960, 5, 1)
    rows = [(1, "s", "q", "a", old), (2, "s", "q2", "a2", T0), (3, "u", "q", "a", T0), (4, "u", "q2", "a", None), (5, "v", "q", "a", None)]
    assert found(spark, write(spark, tmp_path, rows)) == brute(rows) != set()


def test_large_ids(spark, tmp_path):
    path = str(tmp_path / "large")
    spark.createDataFrame([(2**40, "s", "q", "a", T0)], SCHEMA.replace("id int", "id long").replace(", ts string, r int", "")).write.parquet(path)
    assert found(spark, path) == {("s", 1, 2**40, "user"), ("s", 2, 2**40, "assistant")}
