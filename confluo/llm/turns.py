"""Repair of conversations by a lazily determinised weighted automaton.

The role initials of a repaired conversation have the form `(s?(ua)+)?`. Its four states, with the edits Keep, Rerole,
Delete and Insert as weighted arcs, are a nondeterministic automaton over the kinds of rows. Determinising it gives states
that are vectors of least costs, normalised by their minimum. There are few of them, as a state that another one beats by
more than any way on can win back is dropped; they are made when first met and kept in a transition table.

Three passes over the rows of each conversation, all after one shuffle by its id:

1. in order: one lookup a row gives the next vector and what the minimum grew by, so costs;
2. in reverse order: from the cheapest ends back along tight arcs (those that lie on a cheapest way), the states that
   such a way may have at each row;
3. in order: of the tight arcs at hand the letter that comes first, so the least of the cheapest audits, with the text
   hashed as it goes.

A task holds a row at a time and the audit of one conversation, however long that is. One conversation is read by one
task, as its hash and its audit are sequences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, columns

NEWLINE = "\n"
SPACES = " \t\n\x0b\x0c\r"
#: Kinds of rows by their first fault; a dropped row only stands for its conversation.
FINE, TRUNCATED, BLANK, DUPLICATE, DROPPED = range(5)
#: Costs of the edits; a truncated row that stays adds ADDED.
DELETE, INSERT, REROLE, ADDED = 3, 2, 2, 1
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": 0, "u": 1, "a": 2}
#: Where a turn of a role leads from each state, and the turn that comes next in each state.
STEPS = {0: {NOTHING: SYSTEM}, 1: {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
NONE = 15  # no way to this state
Vector = tuple[int, int, int, int]


def row_class(kind: int, role: str) -> int:
    """0: must go; else 1 and more, by the initial of the role and whether the text is truncated."""
    return 0 if kind in (BLANK, DUPLICATE) else 1 + 2 * INITIALS.get(role[:1], 3) + (kind == TRUNCATED)


def arcs(row: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of what may be done with a row of this class, letters in order."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if row:
        initial, more = divmod(row - 1, 2)
        out += [("K", q, to, more * ADDED) for q, to in STEPS[initial].items()]
        out += [("R", q, to, REROLE + more * ADDED) for q, to in NEXT.items()]
    return out


def settled(costs: list[int]) -> tuple[Vector, int]:
    """The vector after any inserts, without states that can't be on a cheapest way, and the minimum taken off."""
    v = list(costs)
    v[USER] = min(v[USER], v[NOTHING] + INSERT, v[SYSTEM] + INSERT, v[ASSISTANT] + INSERT)
    v[ASSISTANT] = min(v[ASSISTANT], v[USER] + INSERT)
    v[USER] = min(v[USER], v[ASSISTANT] + INSERT)
    # What follows nothing may follow an assistant turn, but for a system turn, which may be deleted there.
    if v[NOTHING] > v[ASSISTANT] + DELETE:
        v[NOTHING] = 1 << 30
    if v[SYSTEM] > v[ASSISTANT]:
        v[SYSTEM] = 1 << 30
    least = min(v)
    return tuple(x - least if x < 1 << 20 else NONE for x in v), least


class Table:
    """The determinised automaton, made as far as it is used."""

    start, _ = settled([0, 1 << 30, 1 << 30, 1 << 30])

    def __init__(self):
        self.known: dict[tuple[Vector, int], tuple[Vector, int]] = {}
        self.alive: dict[tuple, int] = {}
        self.chosen: dict[tuple, tuple] = {}

    def step(self, v: Vector, row: int) -> tuple[Vector, int]:
        """The next vector, and what the minimum grows by."""
        found = self.known.get((v, row))
        if found is None:
            costs = [1 << 30] * 4
            for _, q, to, w in arcs(row):
                if v[q] != NONE:
                    costs[to] = min(costs[to], v[q] + w)
            found = self.known[v, row] = settled(costs)
        return found

    @staticmethod
    def end(v: Vector) -> int:
        """The least cost of ending here, beyond the minimum."""
        return min(v[NOTHING], v[ASSISTANT])

    @staticmethod
    def before_inserts(v: Vector, live: int) -> int:
        """Live states, with those from which tight inserts lead to live ones."""
        for _ in range(3):
            for q, to in NEXT.items():
                if v[q] != NONE and v[q] + INSERT == v[to] and live >> to & 1:
                    live |= 1 << q
        return live

    def last(self, v: Vector) -> int:
        ends = sum(1 << q for q in (NOTHING, ASSISTANT) if v[q] == self.end(v))
        return self.before_inserts(v, ends)

    def back(self, v: Vector, row: int, live: int) -> int:
        """The states before the row from which tight arcs lead to `live` ones after it."""
        key = (v, row, live)
        if key not in self.alive:
            w, gain = self.step(v, row)
            found = 0
            for _, q, to, cost in arcs(row):
                if v[q] != NONE and v[q] + cost == w[to] + gain and live >> to & 1:
                    found |= 1 << q
            self.alive[key] = self.before_inserts(v, found)
        return self.alive[key]

    def choose(self, v: Vector, row: int, before: int, after: int, q: int) -> tuple[str, int, tuple[int, ...], str]:
        """(letters, state after the row, states of inserted turns, the row's own letter) of the first of the tight ways
        over a row."""
        key = (v, row, before, after, q)
        if key not in self.chosen:
            w, gain = self.step(v, row)
            letters, put = "", ()
            while True:
                tight = {x: to for x, at, to, cost in arcs(row) if at == q and v[q] + cost == w[to] + gain and after >> to & 1}
                to = NEXT[q]
                if "D" not in tight and v[q] + INSERT == v[to] and before >> to & 1:
                    letters, put, q = letters + "I", (*put, to), to
                    continue
                letter = min(tight)
                self.chosen[key] = letters + letter, tight[letter], put, letter
                break
        return self.chosen[key]

    def inserts_at_end(self, v: Vector, q: int) -> tuple[str, tuple[int, ...]]:
        put = ()
        while q not in (NOTHING, ASSISTANT) or v[q] != self.end(v):
            q = NEXT[q]
            put = (*put, q)
        return "I" * len(put), put


def packed(v: Vector) -> int:
    return v[0] << 12 | v[1] << 8 | v[2] << 4 | v[3]


def unpacked(x: int) -> Vector:
    return x >> 12, x >> 8 & 15, x >> 4 & 15, x & 15


def same(a, b) -> bool:
    return a is not None and a == b


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 1. Adds the row's place, the vector before it and the cost so far after it."""
    table, last, v, spent, seq = Table(), None, Table.start, 0, 0
    for x in bounded(batches, rows=2000):
        places, vectors, costs = [], [], []
        for conv, kind, role in zip(x.column("conv").to_pylist(), x.column("kind").to_pylist(), x.column("role").to_pylist(), strict=True):
            if not same(last, (conv,)):
                last, v, spent, seq = (conv,), Table.start, 0, 0
            places.append(seq)
            vectors.append(packed(v))
            if kind != DROPPED:
                v, gain = table.step(v, row_class(kind, role))
                spent += gain
            costs.append(spent)
            seq += 1
        yield pa.RecordBatch.from_arrays([*x.columns, pa.array(places, pa.int64()), pa.array(vectors, pa.int32()), pa.array(costs, pa.int64())], [*x.schema.names, "seq", "vector", "spent"])


def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 2, rows in reverse order. Adds the live states before and after the row, and the conversation's cost."""
    table, last, live, cost = Table(), None, 0, 0
    for x in bounded(batches, rows=2000):
        befores, afters, costs = [], [], []
        for conv, kind, role, vector, spent in zip(*(x.column(c).to_pylist() for c in ("conv", "kind", "role", "vector", "spent")), strict=True):
            v = unpacked(vector)
            row = row_class(kind, role)
            if not same(last, (conv,)):
                end = v if kind == DROPPED else table.step(v, row)[0]
                last, live, cost = (conv,), table.last(end), spent + table.end(end)
            afters.append(live)
            if kind != DROPPED:
                live = table.back(v, row, live)
            befores.append(live)
            costs.append(cost)
        more = [pa.array(befores, pa.int32()), pa.array(afters, pa.int32()), pa.array(costs, pa.int64())]
        yield pa.RecordBatch.from_arrays([*x.columns, *more], [*x.schema.names, "before", "after", "cost"])


class Reading:
    """What is known of a conversation while its rows come."""

    def __init__(self, conv):
        self.conv, self.q, self.end, self.cost = conv, NOTHING, Table.start, 0
        self.audit: list[str] = []
        self.sha, self.begun = hashlib.sha256(), False
        self.counts = [0] * 5
        self.illegal, self.initial = 0, None
        self.least = self.most = self.turn = None
        self.turns = 0

    def put(self, role: str, text: str = "") -> None:
        self.sha.update(f"{NEWLINE if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def take(self, table: Table, kind: int, turn, role: str, text: str, v: Vector, before: int, after: int, cost: int) -> None:
        self.counts[kind] += 1
        self.cost = cost
        if kind == DROPPED:
            return
        if turn is not None and turn != self.turn:
            self.turn, self.turns = turn, self.turns + 1
            self.least, self.most = turn if self.least is None else self.least, turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        row = row_class(kind, role)
        letters, self.q, put, letter = table.choose(v, row, before, after, self.q)
        self.audit.append(letters)
        for q in put:
            self.put(ROLES[q])
        if letter != "D":
            self.put(role if letter == "K" else ROLES[self.q], text)
        self.end = table.step(v, row)[0]

    def row(self, table: Table) -> tuple:
        letters, put = table.inserts_at_end(self.end, self.q)
        for q in put:
            self.put(ROLES[q])
        gaps = min(self.most - self.least + 1 - self.turns, 2**63 - 1) if self.turns else 0
        return self.conv, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.cost, "".join(self.audit) + letters, self.sha.hexdigest()


FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 3: a row for each conversation."""
    table, now, of = Table(), None, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = [of, *[pa.int64()] * len(FOUND), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv", *FOUND, "audit", "repaired_sha256"])

    for x in bounded(batches, rows=2000):
        out, of = [], x.schema.field("conv").type
        names = ("conv", "kind", "turn", "role", "text", "vector", "before", "after", "cost")
        for conv, fault, turn, role, text, vector, before, after, cost in zip(*(x.column(c).to_pylist() for c in names), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row(table))
                now = Reading(conv)
            now.take(table, fault, turn, role, text, unpacked(vector), before, after, cost)
        if out:
            yield made(out)
    if now is not None:
        yield made([now.row(table)])


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by the crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its
    text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. Null texts, roles and keys count as one space.
    Dropped rows stay, marked by `dropped`."""
    own = columns(rows, ["conv_id", "turn", "role", "text"])
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = own.withColumn("harm", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20)
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(part("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """Per conversation: id, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by role and text. The first fault of a row counts: blank (no
    character but ASCII white space), duplicate (role and text as in an earlier row), truncated (the last such character
    is none of `.!?`). Edits of a row: Keep (0), Rerole to user or assistant (2), Delete (3, the only one for blank and
    duplicate rows); Insert an empty user or assistant turn anywhere (2); a truncated row that stays adds 1. `audit` is
    the least in ASCII order of the cheapest lists of edits that give role initials of the form `(s?(ua)+)?`.

    Null roles and texts count as one space, so such texts are blank. A null id is a conversation of its own. Rows with
    `dropped_col` true only keep their conversation in the result; one without other rows has zeros, no audit and the hash
    of nothing. Turns missing between the least and the greatest are `gaps`, without null turns. Equal rows are duplicates
    of the first. An empty table gives an empty result; other columns are ignored.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dropped = F.coalesce(F.col(dropped_col), F.lit(False)) if dropped_col else F.lit(False)
    own = columns(rows, [id_col, turn_col, role_col, text_col, *([dropped_col] if dropped_col else [])])
    own = own.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), dropped.alias("dropped"))
    own = own.repartition("conv")
    earlier = F.row_number().over(Window.partitionBy("conv", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())) > 1
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    kind = F.when(F.col("dropped"), DROPPED).when(end == "", BLANK).when(earlier, DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    own = own.select("conv", "turn", "role", "text", kind.cast("int").alias("kind"))
    of = own.schema["conv"].dataType.simpleString()
    base = f"conv {of}, turn long, role string, text string, kind int"
    one = own.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(scanned, f"{base}, seq long, vector int, spent long")
    two = one.sortWithinPartitions("conv", F.desc("seq")).mapInArrow(traced, f"{base}, seq long, vector int, spent long, before int, after int, cost long")
    out = two.sortWithinPartitions("conv", "seq").mapInArrow(repaired, f"conv {of}, {', '.join(f'{c} long' for c in FOUND)}, audit string, repaired_sha256 string")
    return out.withColumnRenamed("conv", id_col)


ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
harmed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(k, ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
         lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) % 20 AS harm FROM keyed),
convs AS (SELECT conv_id, row_number() OVER () AS cn FROM (SELECT DISTINCT conv_id FROM conversations)),
left_over AS (
  SELECT cn, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM harmed JOIN convs ON harmed.conv_id IS NOT DISTINCT FROM convs.conv_id WHERE harm <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY cn ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial FROM left_over),
told AS (
  SELECT *, row_number() OVER (PARTITION BY cn, role, text ORDER BY i) > 1 AS again, right(rtrim(text, E' \t\n\x0B\x0C\r'), 1) AS final,
         lag(initial) OVER (PARTITION BY cn ORDER BY i) || initial AS pair FROM placed),
faults AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM told),
walk AS (
  SELECT cn, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': '', 'r': ''} AS s0, {'c': CAST(1000000000 AS BIGINT), 'a': '', 'r': ''} AS s1,
         {'c': CAST(2 AS BIGINT), 'a': 'I', 'r': E'\nuser:'} AS s2, {'c': CAST(4 AS BIGINT), 'a': 'II', 'r': E'\nuser:\nassistant:'} AS s3 FROM convs
  UNION ALL
  SELECT cn, i, s0, s1, list_sort([s2, {'c': s3.c + 2, 'a': s3.a || 'I', 'r': s3.r || E'\nuser:'}])[1], s3
  FROM (SELECT cn, i, s0, s1, s2, list_sort([s3, {'c': s2.c + 2, 'a': s2.a || 'I', 'r': s2.r || E'\nassistant:'}])[1] AS s3
  FROM (SELECT cn, i, s0, s1, s3, list_sort([s2, {'c': s0.c + 2, 'a': s0.a || 'I', 'r': s0.r || E'\nuser:'}, {'c': s1.c + 2, 'a': s1.a || 'I', 'r': s1.r || E'\nuser:'}])[1] AS s2
  FROM (
    SELECT w.cn, f.i, {'c': w.s0.c + 3, 'a': w.s0.a || 'D', 'r': w.s0.r} AS s0,
      list_sort([{'c': w.s1.c + 3, 'a': w.s1.a || 'D', 'r': w.s1.r}, {'c': CASE WHEN stays AND initial = 's' THEN w.s0.c + more ELSE 1000000000 END, 'a': w.s0.a || 'K', 'r': w.s0.r || own}])[1] AS s1,
      list_sort([{'c': w.s2.c + 3, 'a': w.s2.a || 'D', 'r': w.s2.r},
        {'c': CASE WHEN stays AND initial = 'u' THEN w.s0.c + more ELSE 1000000000 END, 'a': w.s0.a || 'K', 'r': w.s0.r || own},
        {'c': CASE WHEN stays AND initial = 'u' THEN w.s1.c + more ELSE 1000000000 END, 'a': w.s1.a || 'K', 'r': w.s1.r || own},
        {'c': CASE WHEN stays AND initial = 'u' THEN w.s3.c + more ELSE 1000000000 END, 'a': w.s3.a || 'K', 'r': w.s3.r || own},
        {'c': CASE WHEN stays THEN w.s0.c + 2 + more ELSE 1000000000 END, 'a': w.s0.a || 'R', 'r': w.s0.r || E'\nuser:' || text},
        {'c': CASE WHEN stays THEN w.s1.c + 2 + more ELSE 1000000000 END, 'a': w.s1.a || 'R', 'r': w.s1.r || E'\nuser:' || text},
        {'c': CASE WHEN stays THEN w.s3.c + 2 + more ELSE 1000000000 END, 'a': w.s3.a || 'R', 'r': w.s3.r || E'\nuser:' || text}])[1] AS s2,
      list_sort([{'c': w.s3.c + 3, 'a': w.s3.a || 'D', 'r': w.s3.r},
        {'c': CASE WHEN stays AND initial = 'a' THEN w.s2.c + more ELSE 1000000000 END, 'a': w.s2.a || 'K', 'r': w.s2.r || own},
        {'c': CASE WHEN stays THEN w.s2.c + 2 + more ELSE 1000000000 END, 'a': w.s2.a || 'R', 'r': w.s2.r || E'\nassistant:' || text}])[1] AS s3
    FROM walk w JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS more, E'\n' || role || ':' || text AS own FROM faults) f
      ON f.cn = w.cn AND f.i = w.i + 1)))),
ends AS (SELECT cn, list_sort([s0, s3])[1] AS s FROM walk QUALIFY row_number() OVER (PARTITION BY cn ORDER BY i DESC) = 1),
counts AS (
  SELECT cn, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY cn)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       s.c AS cost, s.a AS audit, sha256(substr(s.r, 2)) AS repaired_sha256
FROM convs JOIN ends USING (cn) LEFT JOIN counts USING (cn)
"""
