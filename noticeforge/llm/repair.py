"""Conversation structure repair: signatures, cheapest edits, replay.

A conversation's turns become a signature, one character for each turn: its role
(system, user, assistant, another) and its first fault (none, truncated, blank,
duplicate). Each distinct signature is solved once, by a memoised recursion over its
suffixes and what the roles so far allow to follow; the audit, a string of edits
(Keep, Rerole, Delete, Insert), is joined back to all conversations that have the
signature and replayed over their turns. The repaired roles are one optional system
turn and alternating user and assistant turns, or none.

Turns are gathered as characters alone. Texts stream past their audit, sorted, so
that a task holds a batch of them and one audit however long a conversation is.

Cases: turns go by number, null first, ties by role, then text; null roles and texts
are one space; empty texts are blank. Identical rows each count, the later ones as
duplicates. A null conversation id is a conversation of its own. Empty tables give
empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.llm import common

#: A turn's character: 4 * fault + role. Faults: none, truncated, blank, duplicate.
ROLES, FAULTS = "sua", 4
CHARS = "suaxSUAX01234567"
DELETE, INSERT, RELABEL, TRUNCATED = 2, 5, 1, 5
#: What may follow: anything yet, a user after the system turn, an assistant, a user or the end.
START, SYSTEM, USER, ASSISTANT = range(4)
TAKES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The turn that an insertion or a new role gives in each state, and the state after it.
GIVEN = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: Turns between the places from which a long signature's recursion starts, the last first.
STEP = 100


class Solver:
    """The cheapest edits of one signature; among equally cheap ones those whose initials sort first.

    No two insertions in a row are needed before a turn: they lead back to a state
    that allows no more than before. Each edit has another initial, so the first
    one decides between equal costs.
    """

    def __init__(self, signature: str) -> None:
        self.signature = signature
        n = len(signature) + 1
        self.cost: list[list] = [[None] * n for _ in range(8)]
        self.edit = [bytearray(n) for _ in range(8)]

    def least(self, i: int, state: int, inserted: int = 0) -> int:
        known = self.cost[2 * state + inserted]
        if known[i] is None:
            options = []
            given = GIVEN[state][1]
            if i == len(self.signature):
                if state in (START, ASSISTANT):
                    known[i] = 0
                    return 0
                options.append((INSERT + self.least(i, given), "I"))
            else:
                fault, role = divmod(CHARS.index(self.signature[i]), 4)
                options.append((DELETE + self.least(i + 1, state), "D"))
                if not inserted:
                    options.append((INSERT + self.least(i, given, 1), "I"))
                if fault < 2:
                    to = TAKES[state].get(CHARS[role])
                    if to is not None:
                        options.append((fault * TRUNCATED + self.least(i + 1, to), "K"))
                    options.append((RELABEL + fault * TRUNCATED + self.least(i + 1, given), "R"))
            known[i], edit = min(options)
            self.edit[2 * state + inserted][i] = ord(edit)
        return known[i]

    def solve(self) -> tuple[int, str]:
        for i in range(len(self.signature), 0, -STEP):
            for state in range(4):
                self.least(i, state)
        cost = self.least(0, START)
        audit, i, state, inserted = [], 0, START, 0
        while edit := self.edit[2 * state + inserted][i]:
            audit.append(chr(edit))
            if audit[-1] == "I":
                state, inserted = GIVEN[state][1], int(i < len(self.signature))
                continue
            if audit[-1] != "D":
                state = TAKES[state][CHARS[CHARS.index(self.signature[i]) % 4]] if audit[-1] == "K" else GIVEN[state][1]
            i, inserted = i + 1, 0
        return cost, "".join(audit)


def describe(signature: str) -> tuple[int, int, int, int, int, str]:
    """blank, duplicate, truncated and illegal (neighbours in the wrong order) of a signature, the edits' cost, the audit."""
    faults = [CHARS.index(c) // 4 for c in signature]
    roles = [CHARS[CHARS.index(c) % 4] for c in signature]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return faults.count(2), faults.count(3), faults.count(1), illegal, *Solver(signature).solve()


def _ordered(conv_col: str, turn_col: str) -> list:
    return [F.asc_nulls_first(turn_col), F.asc("role"), F.asc("text")]


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", kept=None) -> DataFrame:
    """conv_id, turn, role, text, kept: rows with kept = false only make their conversation known."""
    kept = F.lit(True) if kept is None else kept
    full = [F.coalesce(F.col(c), F.lit(" ")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))]
    return df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), *full, kept.alias("kept"))


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature and gaps (turn numbers missing between the first and the last) of every conversation, from turns()."""
    own = Window.partitionBy("conv_id", "kept")
    order = own.orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = rows.repartition("conv_id").withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("turn").over(order))
    seen = F.row_number().over(Window.partitionBy("conv_id", "kept", "role", "text").orderBy("place")) > 1
    # What follows the last character that isn't white space tells whether the text ends as a sentence does.
    fault = F.when(~F.col("text").rlike(common.WORD_PATTERN), 2).when(seen, 3).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 1).otherwise(0)
    role = F.pmod(F.instr(F.lit(ROLES), F.substring("role", 1, 1)) - 1, F.lit(4))
    role = F.when(F.col("role") == "", 3).otherwise(role)
    char = F.substring(F.lit(CHARS), (4 * fault + role + 1).cast("int"), F.lit(1))
    new_turn = F.col("turn").isNotNull() & (F.col("before").isNull() | (F.col("before") != F.col("turn")))
    marked = placed.select("conv_id", "turn", "kept", F.when(F.col("kept"), F.struct("place", char.alias("c"))).alias("x"), new_turn.alias("new"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]), "")
    turn = F.when(F.col("kept"), F.col("turn"))
    gaps = F.max(turn) - F.min(turn) + 1 - F.count_if(F.col("kept") & F.col("new"))
    return marked.groupBy("conv_id").agg(whole.alias("signature"), F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))


PLAN = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(rows: DataFrame) -> DataFrame:
    """Of every conversation: conv_id, gaps, signature, its faults, the cost and the audit. Each distinct signature is solved once."""
    own = common.cut(signatures(rows), "signatures")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            columns = [found, *zip(*map(describe, found))] if found else [[]] * 7
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in PLAN.split(", ")])

    solved = common.map_arrow(own.select("signature").distinct(), run, PLAN)
    return common.cut(own.join(solved, "signature"), "audits")


class Replay:
    """One conversation's audit, taken turn by turn."""

    def __init__(self, conv, audit: str) -> None:
        self.conv, self.audit, self.at, self.state = conv, audit, 0, START

    def insertions(self) -> Iterator[tuple[str, str, str, object]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = GIVEN[self.state]
            self.at += 1
            yield role, "", "I", None

    def turn(self, turn, role: str, text: str) -> Iterator[tuple[str, str, str, object]]:
        """The repaired turns (role, text, edit, number) that this one gives, with those inserted before it."""
        yield from self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = TAKES[self.state][role[:1]]
            yield role, text, edit, turn
        elif edit == "R":
            given, self.state = GIVEN[self.state]
            yield given, text, edit, turn


def _past_audits(rows: DataFrame, planned: DataFrame, each, schema: str) -> DataFrame:
    """Turns stream past their conversation's audit, which sorts before them; each(replays) turns (conversation, repaired turns) to batches."""
    audits = planned.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    texts = rows.where("kept").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.lit("").alias("audit"))
    dealt = audits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text")

    def replays(batches: Iterator[pa.RecordBatch]):
        now = None
        for batch in batches:
            for conv, kind, turn, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if now:
                        yield now.conv, list(now.insertions()), True
                    now = Replay(conv, audit)
                else:
                    yield conv, list(now.turn(turn, role, text)), False
        if now:
            yield now.conv, list(now.insertions()), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(replays(batches))

    return common.map_arrow(dealt, run, schema)


def _batches(found: Iterator[tuple], names: list[str], kinds: list, most: int = common.BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in found:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)


def _kind(rows: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[column].dataType)


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, edit and turn (null: inserted) of every turn after repair."""
    kinds = [_kind(rows, "conv_id"), pa.int64(), pa.string(), pa.string(), pa.string(), _kind(rows, "turn")]
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def each(replays):
        def found():
            place = 0
            for conv, out, last in replays:
                for role, text, edit, turn in out:
                    place += 1
                    yield conv, place, role, text, edit, turn
                place = 0 if last else place

        yield from _batches(found(), ["conv_id", "place", "role", "text", "edit", "turn"], kinds)

    return _past_audits(rows, planned, each, f"conv_id {conv}, place long, role string, text string, edit string, turn {turn}")


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: the hash of `role:text` of the repaired turns, joined by line feeds, fed turn by turn."""
    kinds = [_kind(rows, "conv_id"), pa.string()]

    def each(replays):
        def found():
            own, first = hashlib.sha256(), True
            for conv, out, last in replays:
                for role, text, _, _ in out:
                    own.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
                if last:
                    yield conv, own.hexdigest()
                    own, first = hashlib.sha256(), True

        yield from _batches(found(), ["conv_id", "repaired_sha256"], kinds)

    return _past_audits(rows, planned, each, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """turns() of conversations that are damaged by the checksum of their id and turn: dropped, emptied, cut short, repeated, given to the user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns(df).withColumn("kind", F.crc32(key.cast("binary")) % 20)
    rows = rows.withColumns({"kept": F.col("kind") != 0, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.withColumn("_", F.explode(times)).select("conv_id", "turn", "role", "text", "kept")


def sql() -> str:
    """The query in DuckDB: a recursion from the last turn to the first carries the best cost, audit and turns of each state."""
    least = "list_min([{}])"
    after = {0: "b0", 1: "b1", 2: "b2", 3: "b3"}

    def step(b: str, cost: str, edit: str, out: str = "") -> str:
        turns_ = f"list_prepend({out}, {b}.o)" if out else f"{b}.o"
        return f"{{'c': {b}.c + {cost}, 'a': '{edit}' || {b}.a, 'o': {turns_}}}"

    def without(state: int) -> str:
        role, to = GIVEN[state]
        keeps = [f"CASE WHEN NOT must AND first = '{r}' THEN {step(after[t], '5 * cut', 'K', 'role || chr(58) || text')} END" for r, t in TAKES[state].items()]
        relabel = f"CASE WHEN NOT must THEN {step(after[to], '1 + 5 * cut', 'R', f'{chr(39)}{role}:{chr(39)} || text')} END"
        return least.format(", ".join([step(after[state], "2", "D"), *keeps, relabel])) + f" AS n{state}"

    def whole(state: int) -> str:
        role, to = GIVEN[state]
        inserted = step(f"n{to}", "5", "I", f"'{role}:'")
        return least.format(f"n{state}, {inserted}") + f" AS b{state}"

    end = {0: ("0", "''", "[]"), 1: ("10", "'II'", "['user:', 'assistant:']"), 2: ("5", "'I'", "['assistant:']"), 3: ("0", "''", "[]")}
    base = ", ".join(f"{{'c': {c}::BIGINT, 'a': {a}, 'o': {o}::VARCHAR[]}} AS b{s}" for s, (c, a, o) in end.items())
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(key)), lambda i: ord(key[i + 1])::BIGINT)), lambda s, b: xor(s >> 8, t[1 + (xor(s, b) & 255)])), 4294967295) % 20 AS kind FROM keyed, tab),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM rows_),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) AS prior FROM placed),
faults AS (SELECT conv_id, turn, role, text, place, role[1] AS first, prior || role[1] AS pair, CASE WHEN NOT regexp_matches(text, '{word}') THEN 'blank' WHEN seen THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM marked),
asked AS (SELECT *, fault IN ('blank', 'duplicate') AS must, (fault = 'truncated')::BIGINT AS cut FROM faults),
best AS (SELECT conv_id, max(place) AS i, {base} FROM asked GROUP BY conv_id
  UNION ALL SELECT conv_id, i - 1, {", ".join(map(whole, range(4)))} FROM (SELECT best.conv_id, i, {", ".join(map(without, range(4)))} FROM best JOIN asked ON asked.conv_id IS NOT DISTINCT FROM best.conv_id AND place = i WHERE i > 0)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
  count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM asked GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b0.c, 0)::BIGINT AS cost, coalesce(b0.a, '') AS audit, sha256(coalesce(array_to_string(b0.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id AND i = 0
"""
