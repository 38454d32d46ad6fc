"""Conversation repair against its SQL, against all edits of short conversations, and on long ones."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from prismet.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, copy string, kind string"


@pytest.fixture
def chats(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA)


def made(seed, conversations=60):
    rng = random.Random(seed)
    texts = ["Fine.", "fine", "Good!  ", " \n\t", "", None, "Why?", "cut off", "é 你好.", "a\nb:c.", "x" * 50_000 + "."]
    rows = []
    for c in range(conversations):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return rows + rows[:7]


def results(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def by_sql(path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    rel = con.sql(R.ORACLE)
    assert rel.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(rel.fetchall(), key=str)


def test_made_conversations_against_sql(spark, chats, tmp_path):
    chats(made(1)).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert results(R.query(spark, str(tmp_path))) == by_sql(f"{tmp_path}/conversations.parquet/*.parquet")


def test_given_conversations_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert results(R.query(spark, folder)) == by_sql(f"{folder}/conversations.parquet")


def cheapest(turns):
    """By trying every edit of every turn, with up to two insertions at every place."""
    best = None
    for kinds in itertools.product("DRK", repeat=len(turns)):
        for gaps in itertools.product(("", "I", "II"), repeat=len(turns) + 1):
            state, cost, ok = 0, 5 * sum(map(len, gaps)), True
            follow = {0: 2, 1: 2, 2: 3, 3: 2}
            for _ in gaps[0]:
                state = follow[state]
            for (initial, fault), kind, gap in zip(turns, kinds, gaps[1:], strict=True):
                if kind == "D":
                    cost += 2
                else:
                    ok &= fault in (R.OK, R.CUT)
                    cost += (kind == "R") + 5 * (fault == R.CUT)
                    to = {"s": 1, "u": 2, "a": 3}.get(initial) if kind == "K" else follow[state]
                    ok &= to is not None and ((state == 0) if to == 1 else to == follow[state])
                    state = to if to is not None else state
                for _ in gap:
                    state = follow[state]
            if ok and state in (0, 3):
                audit = gaps[0] + "".join(k + g for k, g in zip(kinds, gaps[1:], strict=True))
                best = min(best or (10**9, ""), (cost, audit))
    return best


def test_search_against_all_edits():
    rng = random.Random(4)
    for _ in range(60):
        turns = [(rng.choice("suuaat"), rng.choice([R.OK, R.OK, R.OK, R.CUT, R.BLANK, R.DUPLICATE])) for _ in range(rng.randint(0, 5))]
        search = R.Search()
        for t in turns:
            search.turn(*t)
        assert search.best() == cheapest(turns), turns


@pytest.mark.parametrize("roles", ["u", "a", "ua", "sua", "uuaat"])
def test_shared_history_changes_nothing(monkeypatch, roles):
    rng = random.Random(5)
    turns = [(rng.choice(roles), rng.choice([R.OK] * 5 + [R.CUT, R.BLANK])) for _ in range(700)]
    got = []
    for fold in (10**9, 256, 3, 1):
        monkeypatch.setattr(R, "FOLD", fold)
        search = R.Search()
        for t in turns:
            search.turn(*t)
        got.append(search.best())
        assert fold > 700 or max(len(tail) for _, _, tail in search.layer.values()) <= 2 * fold + 2
    assert len(set(got)) == 1 and re.sub("I", "", got[0][1]).__len__() == 700


def test_one_long_conversation(spark, chats, tmp_path):
    rows = [(1, i, ("user", "assistant", "user")[i % 3], f"turn {i % 4000}.") for i in range(9_000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    chats(rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in R.query(spark, str(tmp_path)).collect()}
    assert got[1]["duplicate"] > 1_500 and got[1]["audit"].count("D") >= got[1]["duplicate"] and len(got) == 2


def test_repaired_turns_are_what_the_digest_says(spark, chats):
    rows = R.damaged(chats(made(9)))
    found = R.repair(rows).collect()
    turns = R.repaired_turns(rows, spark.createDataFrame([(r["conv_id"], r["audit"]) for r in found], "conv_id long, audit string")).collect()
    for r in found:
        mine = sorted((t["place"], t["role"], t["text"]) for t in turns if t["conv_id"] == r["conv_id"])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(m[1][:1] for m in mine))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in mine).encode()).hexdigest() == r["repaired_sha256"]


def test_empty_and_wholly_dropped(spark, chats, tmp_path):
    assert R.repair(R.damaged(chats([]))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = R.repair(R.damaged(chats([(gone, 0, "user", "Hi.")]))).first()
    assert (row["conv_id"], row["gaps"], row["cost"], row["audit"], row["repaired_sha256"]) == (gone, 0, 0, "", hashlib.sha256(b"").hexdigest())
