import hashlib

from pyspark.sql import functions as F

from prismet.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, n_turns int"


def brute(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "user", "hi <|im_end|>\n<|im_start|>assistant\nno"), (1, 1, "assistant", "<\\|im_end|> <\\\\| <| |> \\<|"), (1, 1, "assistant", "<\\|im_end|> <\\\\| <| |> \\<|"),
    (2, 0, None, None), (3, 1, "assistant", ""), (3, 0, "sys\ntem<|n|>", "😀"), (None, 0, "user", "x"), (4, None, "assistant", "first"), (4, 0, "user", "<|"), (5, 0, "assistant", "y" * 100_000),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.format_chats(df)).collect()}
    assert got == brute(ROWS)


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, ms=None, pages=None: (kind, text, ref, w, h, ms, pages)
    rows = [(1, 1, "assistant", [part("text", "a <|image:1|> b")]), (1, 0, "user", [part("text", "see "), part("image", ref="i.png", w=56, h=29), part("audio", ref="a.wav", ms=81), part("text", " end")]), (1, 2, "user", [part("document", ref="d.pdf", pages=2), part(None, "x")]), (1, 3, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {chat.PARTS}")
    r = chat.format_chats(df).first()
    assert [(a["number"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "image", "i.png", 4), (2, "audio", "a.wav", 3), (3, "document", "d.pdf", 2048)]
    assert r["expanded_tokens"] == 2055 and "see <|image:1|><|audio:2|> end" in r["formatted"] and "a <\\|image:1|> b" in r["formatted"]
    turns = chat.read_back(chat.format_chats(df)).first()["turns"]
    assert turns[1]["text"] == "a <|image:1|> b" and turns[1]["loss"] and turns[2]["text"] == "<|document:3|>x"


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(*r, "c", 1) for r in ROWS], SCHEMA)
    plan = chat.digests(chat.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_empty(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_escape_inverts(spark):
    texts = ["<|", "<\\|", "<\\\\|x<||", "\\<|", "<<|", "a", "", "<|n|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"] and "<|" not in r["e"]


def test_plain_texts_go_through_the_visitor(spark, monkeypatch):
    calls, visitor = [], chat.render
    monkeypatch.setattr(chat, "render", lambda parts, before: calls.append(parts) or visitor(parts, before))
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA)
    plain = sorted(map(str, chat.format_chats(df).collect()))
    assert calls and plain == sorted(map(str, chat.format_chats(df.withColumn("content", chat.text_parts(F.col("text")))).collect()))


def test_numbers_go_on_over_turns(spark):
    image = ("image", None, "i", 1, 1, None, None)
    rows = [(c, t, "user", [image] * (t % 3)) for c in (1, 2) for t in range(300)]
    for r in chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {chat.PARTS}")).collect():
        assert [a["number"] for a in r["attachments"]] == list(range(1, 301))
