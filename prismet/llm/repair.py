"""Conversation structure repair: a forward Viterbi search a conversation over the states of a turn grammar.

A repaired conversation reads `(s?(ua)+)?` by the initials of its roles. Its grammar has four states: nothing yet, after a
system turn, after a user turn, after an assistant turn. A turn is kept (cost 0), given the role user or assistant (1) or
deleted (2; blank turns and repetitions must be); user or assistant turns without text may be inserted anywhere (5);
a truncated turn that stays costs 5 more. The search carries, for each state, the least (cost, audit string) and closes
each turn's layer with at most two insertions, which reach every state that any number of them reaches. Of audits of equal
cost the ASCII-least wins.

1. DataFrame functions find each turn's fault; a repetition is found by numbering the rows of one role and text.
2. The rows are dealt by conversation, sorted by turn, and stream through the search: a task holds four bytes a turn of
   one conversation, not its texts. Every FOLD turns the survivors' audits become links to a shared history, so a long
   conversation costs no more a turn than a short one.
3. The audit of a conversation is put before its rows, which stream once more, and the repaired text is hashed as it is formed.
   A digest is a sequential value, so the rows of one conversation pass through one task each time, however many they are.

Defined results: a null role or text is one space (so a null text is blank); a null turn comes first; rows of equal turn are
taken by role, then text; a null conv_id is a conversation of its own; a conversation without rows has zeros, an empty
audit and the digest of the empty text; an empty table gives an empty result; repeated rows are repetitions. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, shared_folder, slices, stored, table

#: Costs: keep, rerole, delete, insert, and a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FOLD = 256
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
#: Where a turn of a role's initial leads from a state.
NEXT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The only role that may follow a state, as a given or an inserted role.
FOLLOWS = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}

OK, BLANK, DUPLICATE, CUT = range(4)


class Search:
    """The least (cost, audit) by state over the turns seen so far.

    An audit is (rank of its history, tail). Histories are taken between turns before insertions, when each holds all turns and
    ends with one, so that of two of them neither begins the other, and their order decides whatever follows."""

    def __init__(self) -> None:
        self.heads: list[tuple[int, str]] = [(-1, "")]
        self.ranked = [0]
        self.turns = 0
        self.layer = self._closed({NONE: (0, 0, "")})

    @staticmethod
    def _closed(layer: dict) -> dict:
        """The layer after up to two insertions."""
        out = dict(layer)
        for state, (cost, rank, tail) in layer.items():
            for n in (1, 2):
                state = FOLLOWS[state]
                reached = (cost + n * INSERT, rank, tail + "I" * n)
                if state not in out or reached < out[state]:
                    out[state] = reached
        return out

    def turn(self, initial: str, fault: int) -> None:
        opened: dict[int, tuple] = {}
        kept = NEXT.get(initial, {})
        more = TRUNCATED if fault == CUT else 0
        for state, (cost, rank, tail) in self.layer.items():
            edits = [(state, DELETE, "D")]
            if fault in (OK, CUT):
                edits.append((FOLLOWS[state], REROLE + more, "R"))
                if state in kept:
                    edits.append((kept[state], more, "K"))
            for to, price, edit in edits:
                reached = (cost + price, rank, tail + edit)
                if to not in opened or reached < opened[to]:
                    opened[to] = reached
        self.turns += 1
        if self.turns % FOLD == 0:
            opened = self._fold(opened)
        self.layer = self._closed(opened)

    def _fold(self, opened: dict) -> dict:
        histories = sorted({(rank, tail) for _, rank, tail in opened.values()})
        ranks = {h: i for i, h in enumerate(histories)}
        at = len(self.heads)
        self.heads += [(self.ranked[rank], tail) for rank, tail in histories]
        self.ranked = list(range(at, at + len(histories)))
        return {state: (cost, ranks[rank, tail], "") for state, (cost, rank, tail) in opened.items()}

    def best(self) -> tuple[int, str]:
        cost, rank, tail = min(self.layer[s] for s in ENDS if s in self.layer)
        parts, at = [tail], self.ranked[rank]
        while at >= 0:
            at, tail = self.heads[at]
            parts.append(tail)
        return cost, "".join(reversed(parts))


class Conversation:
    """Counts and the search over the rows of one conversation, in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.search = conv_id, Search()
        self.first = self.last = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.search.turn(initial, fault)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.search.best())


_SEARCHED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SEARCHED_SCHEMA = pa.schema([(c.split(" ")[0], pa.string() if c.endswith("string") else pa.int64()) for c in _SEARCHED.split(", ")])


def _search(batches):
    here: Conversation | None = None
    done: list[tuple] = []
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _SEARCHED_SCHEMA, strict=True)], schema=_SEARCHED_SCHEMA)
    for batch in batches:
        for conv_id, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")), strict=True):
            if here is None or here.conv_id != conv_id:
                if here is not None:
                    done.append(here.row())
                here = Conversation(conv_id)
            if fault is not None:  # a row that was dropped only names its conversation
                here.add(turn, initial, fault)
        if len(done) >= 4096:
            yield out()
            done.clear()
    if here is not None:
        done.append(here.row())
    if done:
        yield out()


_REPAIRED = "conv_id long, repaired_sha256 string"
_REPAIRED_SCHEMA = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


class Repaired:
    """The digest of a conversation's repaired text, formed turn by turn along its audit."""

    def __init__(self, conv_id, audit: str) -> None:
        self.conv_id, self.audit, self.at, self.state, self.sha = conv_id, audit, 0, NONE, hashlib.sha256()
        self.inserted()

    def emit(self, state: int, role: str, text: str) -> None:
        self.sha.update((("" if self.state == NONE else "\n") + role + ":" + text).encode())
        self.state = state

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            to = FOLLOWS[self.state]
            self.emit(to, ROLE[to], "")

    def turn(self, role: str, text: str) -> None:
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.emit(NEXT[role[:1]][self.state], role, text)
        elif edit == "R":
            to = FOLLOWS[self.state]
            self.emit(to, ROLE[to], text)
        self.inserted()


def _repair(batches):
    here: Repaired | None = None
    done: list[tuple] = []
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _REPAIRED_SCHEMA, strict=True)], schema=_REPAIRED_SCHEMA)
    for batch in slices(batches):
        for conv_id, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if audit is not None:
                if here is not None:
                    done.append((here.conv_id, here.sha.hexdigest()))
                here = Repaired(conv_id, audit)
            else:
                here.turn(role, text)
        if len(done) >= 4096:
            yield out()
            done.clear()
    if here is not None:
        done.append((here.conv_id, here.sha.hexdigest()))
    if done:
        yield out()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of the damaged rows; a dropped row stays as one without a copy number."""
    text_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_or("conv_id"), F.lit(":"), text_or("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_or("text"), "[.!?]", "")).otherwise(text_or("text"))
    copies = F.when(kind == 0, F.array(F.lit(None).cast("int"))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(text_or("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _order() -> tuple:
    return F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")


def faults(rows: DataFrame) -> DataFrame:
    """The rows with each one's initial and first fault; the fault of a row that was dropped is null."""
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text", F.col("copy").isNull()).orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    fault = F.when(F.col("copy").isNull(), F.lit(None).cast("int")).when(blank, BLANK).when(again, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(OK)
    return rows.select("*", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, copy) as damaged() gives them: counts, cost, audit, digest."""
    spark = rows.sparkSession
    rows = bounded(rows)
    dealt = faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    searched = stored(spark, dealt.select("conv_id", "turn", "initial", "fault").mapInArrow(_search, _SEARCHED), shared_folder(spark), "searched")
    none = lambda kind: F.lit(None).cast(kind)
    told = rows.where("copy is not null").select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", "copy", none("string").alias("audit"))
    audits = searched.select("conv_id", F.lit(0).alias("part"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("int").alias("copy"), "audit")
    again = told.union(audits).repartition("conv_id").sortWithinPartitions("conv_id", "part", *_order())
    hashed = again.select("conv_id", "audit", "role", "text").mapInArrow(_repair, _REPAIRED)
    return searched.join(hashed.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place, role, text; audits: conv_id, audit."""
    numbered = rows.where("copy is not null").withColumn("row", F.row_number().over(Window.partitionBy("conv_id").orderBy(*_order())))
    edits = audits.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    upto = Window.partitionBy("conv_id").orderBy("at")
    edits = edits.withColumn("row", F.sum((F.col("edit") != "I").cast("int")).over(upto)).where("edit <> 'D'").withColumn("place", F.row_number().over(upto))
    joined = edits.alias("e").join(numbered.alias("r"), F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("e.row") == F.col("r.row")) & (F.col("e.edit") != "I"), "left")
    given = joined.select("e.conv_id", "e.place", "e.edit", F.col("r.role").alias("own"), F.coalesce("r.text", F.lit("")).alias("text"))
    system = F.max((F.col("place") == 1) & (F.col("edit") == "K") & F.col("own").startswith("s")).over(Window.partitionBy("conv_id"))
    due = F.when((F.col("place") - F.coalesce(system, F.lit(False)).cast("int")) % 2 == 1, "user").otherwise("assistant")
    return given.select("conv_id", "place", F.when(F.col("edit") == "K", F.col("own")).otherwise(due).alias("role"), "text")


def query(spark, sf_dir):
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _edit(value: str, price: object, edit: str) -> str:
    """SQL for a survivor (nine digits of cost, then its audit) after an edit."""
    return f"lpad((substr({value}, 1, 9)::INT + {price})::VARCHAR, 9, '0') || substr({value}, 10) || '{edit}'"


_ROLE_OR_NEW = ", ".join([_edit(v, f"{REROLE} + more", "R") for v in ("v0", "v1", "v3")])
ORACLE = rf"""
WITH RECURSIVE codes AS (
  SELECT list(v ORDER BY i) AS code FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i))
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, code[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM given, codes
), hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'ok' END AS fault FROM hurt
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM numbered) GROUP BY conv_id
), layers AS (
  SELECT conv_id, 0::BIGINT AS n, '000000000' AS v0, NULL::VARCHAR AS v1, '000000005I' AS v2, '000000010II' AS v3 FROM counted
  UNION ALL
  SELECT conv_id, n, o0, o1, least(o2, {_edit("o0", INSERT, "I")}, {_edit("o1", INSERT, "I")}, {_edit("o3", INSERT, "I")}),
         least(o3, {_edit("o2", INSERT, "I")}, {_edit("o0", 2 * INSERT, "II")}, {_edit("o1", 2 * INSERT, "II")})
  FROM (SELECT conv_id, n, {_edit("v0", DELETE, "D")} AS o0, least({_edit("v1", DELETE, "D")}, CASE WHEN free AND initial = 's' THEN {_edit("v0", "more", "K")} END) AS o1,
               least({_edit("v2", DELETE, "D")}, CASE WHEN free THEN least({_ROLE_OR_NEW}) END, CASE WHEN free AND initial = 'u' THEN least({_ROLE_OR_NEW.replace(f"{REROLE} + more", "more").replace("'R'", "'K'")}) END) AS o2,
               least({_edit("v3", DELETE, "D")}, CASE WHEN free THEN {_edit("v2", f"{REROLE} + more", "R")} END, CASE WHEN free AND initial = 'a' THEN {_edit("v2", "more", "K")} END) AS o3
        FROM (SELECT r.conv_id, r.n, r.initial, r.fault IN ('ok', 'truncated') AS free, CASE r.fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END AS more, v0, v1, v2, v3
              FROM layers l JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.n = l.n + 1))
), best AS (
  SELECT l.conv_id, substr(least(v0, v3), 1, 9)::BIGINT AS cost, substr(least(v0, v3), 10) AS audit FROM layers l JOIN counted c ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.n = c.rows
), edits AS (
  SELECT conv_id, i, substr(audit, i, 1) AS edit, count(*) FILTER (WHERE substr(audit, i, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS n FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM best)
), formed AS (
  SELECT e.conv_id, e.i, e.edit, r.role, CASE e.edit WHEN 'I' THEN '' ELSE r.text END AS text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.i) AS place
  FROM edits e LEFT JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.n = e.n AND e.edit <> 'I' WHERE e.edit <> 'D'
), named AS (
  SELECT *, CASE WHEN edit = 'K' THEN role WHEN (place - max((place = 1 AND edit = 'K' AND role[1] = 's')::INT) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS due FROM formed
), digests AS (
  SELECT conv_id, sha256(string_agg(due || ':' || text, chr(10) ORDER BY i)) AS repaired_sha256 FROM named GROUP BY conv_id
)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, coalesce(d.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN digests d ON a.conv_id IS NOT DISTINCT FROM d.conv_id
"""
