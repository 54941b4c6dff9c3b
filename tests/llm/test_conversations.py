import datetime as dt

from siltstone.llm import conversations as C

T0 = dt.datetime(2025, 1, 1)
MESSAGE = "id string, session_id string, role string, content string, created_at timestamp, turns string, page_no int, speaker string"


def messages(spark, rows):
    return spark.createDataFrame([(i, s, r, c, None if t is None else T0 + dt.timedelta(seconds=t), "x", 1, "y") for i, s, r, c, t in rows], MESSAGE)


ROWS = [
    ("a1", "good", "Human", "hi", 1), ("a2", "good", " AI ", "hello", 2), ("a2", "good", " AI ", "hello", 2), ("a9", "good", "Human", "hi", 1),
    ("b1", "silent", "user", " ​\n", 1), ("b2", "silent", "system", "x", 2),
    ("c1", "no_reply", "user", "hi", 1),
    ("d1", "twice", "user", "hi", 1), ("d2", "twice", "USER", "there", 2), ("d3", "twice", "bot", "yes", 3),
    ("e1", "no_time", "user", "hi", 1), ("e2", "no_time", "bot", "yes", 2), ("e3", "no_time", "tool", None, None),
    ("f1", "nobody", "user", "hi", 1), ("f2", "nobody", "bot", "yes", 2), ("f3", "nobody", "n/a", "?", 3),
    ("g2", "tied", "bot", "yes", 1), ("g1", "tied", "user", "hi", 1),
    ("h1", "bot_first", "bot", "hi", 1), ("h2", "bot_first", "user", "hi", 2), ("h3", "bot_first", "bot", "hi", 3),
    ("i1", None, "user", "hi", 1), ("j1", "null_role", None, "hi", 1),
    ("k1", "tools", "user", "hi", 1), ("k2", "tools", "function", "{}", 2), ("k3", "tools", "model", "ok", 3), ("k4", "tools", "assistant", "more", 4),
]


def test_which_sessions_are_left_out(spark):
    for page in (1, 2, 4096):
        got = {r[0] for r in C.left_out(messages(spark, ROWS), page=page).collect()}
        assert got == {"silent", "no_reply", "twice", "no_time", "nobody", "bot_first", "null_role"}, page


def test_turns_are_numbered_across_pages(spark):
    rows = [(f"m{i:04}", "s", "user" if i % 2 == 0 else "bot", f"t{i}", i // 3) for i in range(200)]
    for page in (1, 2, 7, 64):
        got = [(r.turn_no, r.id) for r in C.conversation_turns(messages(spark, rows), page=page).orderBy("turn_no").collect()]
        assert got == [(i, f"m{i:04}") for i in range(200)]


def test_no_rows(spark):
    assert C.left_out(messages(spark, [])).count() == 0
    assert C.conversation_turns(messages(spark, [])).count() == 0


def fragments(spark, rows):
    turn = "array<struct<message_hash:bigint,speaker:string,id:string>>"
    return spark.createDataFrame([(i, s, [(h, "user", str(h)) for h in hs]) for i, s, hs in rows], f"fragment_id bigint, session_id string, turns {turn}")


def test_fragments_are_assembled_by_their_overlap(spark):
    rows = [
        (3, "chain", [8, 9, 10]), (1, "chain", [1, 2, 3, 4, 5]), (2, "chain", [4, 5, 6, 7, 8]), (4, "chain", [4, 5, 6, 7, 8]), (5, "chain", [6, 7]),
        (11, "gap", [1, 2, 3]), (12, "gap", [5, 6]),
        (21, "fork", [1, 2]), (22, "fork", [2, 3]), (23, "fork", [2, 4]),
        (31, "ring", [1, 2]), (32, "ring", [2, 1]),
        (41, "alone", [7]),
    ]
    assembled = C.assemble(fragments(spark, rows), longest=4).collect()
    got = {(r.session_id, r.fragment_id): (r.place, r.whole) for r in assembled}
    assert [(r["first"], r.own) for r in sorted(assembled, key=lambda r: (r.session_id, r.place or 0)) if r.session_id == "chain"] == [(0, 3), (3, 4), (7, 3)]
    assert {k: v for k, v in got.items() if k[0] == "chain"} == {("chain", 1): (0, True), ("chain", 2): (1, True), ("chain", 3): (2, True)}
    assert got["alone", 41] == (0, True)
    assert not any(whole for (s, _), (_, whole) in got.items() if s in ("gap", "fork", "ring"))


def test_roles(spark):
    df = spark.createDataFrame([(" End-User ",), ("Tool Result",), ("",), (None,), ("Undefined",)], "r string")
    assert [r[0] for r in df.select(C.role_class(df.r)).collect()] == ["user", "tool", None, None, None]


def test_a_lost_fragment_leaves_its_session_out(spark):
    """What is left of a session without a middle fragment looks sound turn by turn: only the graph tells the gap."""
    said = [(f"m{i:03}", s, "user" if i % 2 == 0 else "bot", f"t{i}", i) for s in ("cut", "kept") for i in range(40)]
    pages = C.export_fragments(C.turns(messages(spark, said)), page=8, overlap=2)
    held = pages.collect()
    middle = next(f.fragment_id for f in held if f.session_id == "cut" and f.turns[0].id == "m016")
    assert {r.session_id: r.sound for r in C.judged(pages)[0].collect()} == {"cut": True, "kept": True}
    left = spark.createDataFrame([f for f in held if f.fragment_id != middle], pages.schema)
    assert {r.session_id: r.sound for r in C.judged(left)[0].collect()} == {"cut": False, "kept": True}
    # An export that repeats a fragment, and one that repeats a part of one, change nothing.
    again = [f for f in held if f.session_id == "kept"]
    part = again[1].asDict() | {"fragment_id": 1, "turns": again[1].turns[2:6]}
    more = spark.createDataFrame([*again, again[0], part], pages.schema)
    assert {r.session_id: r.sound for r in C.judged(more)[0].collect()} == {"kept": True}


def test_pages_over_the_borders_of_tasks(spark):
    said = [(f"m{i:04}", "s" if i < 900 else f"s{i // 20}", "user" if i % 2 == 0 else "bot", f"t{i}", i) for i in range(1500)]
    pages = C.export_fragments(C.turns(messages(spark, said)).repartition(7), page=16, overlap=2).collect()
    starts = {f.turns[0].id for f in pages}
    assert len({f.fragment_id for f in pages}) == len(pages) and max(len(f.turns) for f in pages) <= 18
    for f in pages:  # a page ends with what the next begins with, unless it is its session's last
        assert f.turns[-1].id in ("m0899", *(f"m{20 * (i // 20) + 19:04}" for i in range(900, 1500, 20))) or {t.id for t in f.turns[-2:]} & starts
