"""Repair of conversations against a plain search over all edits, on odd rows and on random conversations."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from confluo.llm import queries, turns

from ..oracle import connect, difference

SCHEMA = "conv_id long, turn long, role string, text string, conv string, kind string, seq string, cost string, dropped boolean"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w", None) for r in rows], SCHEMA).repartition(3)


def planted(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def plain(rows, convs):
    """Least (cost, audit) over all lists of edits, kept by the initials so far."""
    want = []
    for conv in convs:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, kinds = set(), []
        for _, _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        ways = {"": (0, "", ())}

        def better(at, found):
            return at if found is None or at < found else found

        def with_inserts(ways):
            for _ in range(3):
                for done, (c, a, out) in list(ways.items()):
                    to = extended(done, "u" if done[-1:] in ("", "s", "a") else "a")
                    ways[to] = better((c + 2, a + "I", (*out, ("user" if to[-1] == "u" else "assistant") + ":")), ways.get(to))
            return ways

        def extended(done, initial):
            """Initials so far, in short: only the last and whether a pair is whole matter."""
            if initial == "s":
                return "s" if done == "" else None
            if initial == "u":
                return "u" if done in ("", "s", "a") else None
            return "a" if initial == "a" and done == "u" else None

        ways = with_inserts(ways)
        for (_, _, role, text), kind in zip(own, kinds, strict=True):
            new = {}
            more = int(kind == "truncated")
            for done, (c, a, out) in ways.items():
                new[done] = better((c + 3, a + "D", out), new.get(done))
                if kind in ("blank", "duplicate"):
                    continue
                for letter, as_role, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (to := extended(done, as_role[:1])) is not None:
                        new[to] = better((c + cost + more, a + letter, (*out, f"{as_role}:{text}")), new.get(to))
            ways = with_inserts(new)
        cost, audit, out = min(w for done, w in ways.items() if done in ("", "a"))
        known = [t for _, t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        want.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()))
    return sorted(want, key=repr)


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (1, 3, "user", "And"), (1, 9, "assistant", "Then."),
    (2, None, "user", "Who?"), (2, None, None, "Me."), (2, 5, "assistant", None), (2, 5, "assistant", None), (2, 7, "", "No role."),
    (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (None, None, "assistant", "None."),
    (3, 4, "tool", "{}"), (3, 4, "tool", "{}"), (3, 4, "assistant", "So."), (3, 4, "user", "So!"), (4, 0, "assistant", "Alone."), (5, 0, "system", "Only."), (5, 0, "system", "Only."),
    (6, 1, "user", " \t\n "), (6, 2, "user", "ideographic space　"), (6, 3, "assistant", "ends.\n\n"), (7, -(2**63), "user", "low."), (7, 2**63 - 1, "assistant", "high."),
    (8, 0, "user", "long " * 60_000 + "."), (8, 1, "assistant", "é😀."), (9, 0, "assistant", "a."), (9, 1, "system", "b."), (9, 2, "user", "c."),
]


def random_rows(seed, convs, most):
    r = random.Random(seed)
    return [(c, r.choice([i, i, i, i + 1, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "s", None]), r.choice(["", "Yes.", "No", "Why?", None, f"{i}!", f"{i}"])) for c in range(convs) for i in range(r.randint(1, most))]


@pytest.mark.parametrize("rows", [ODD, random_rows(1, 150, 9), random_rows(2, 4, 300)])
def test_against_plain_search(spark, rows):
    convs = list(dict.fromkeys(r[0] for r in rows))
    got = sorted((tuple(r) for r in turns.repair(turns.damaged(frame(spark, rows)), dropped_col="dropped").collect()), key=repr)
    want = [(*w[:1], min(w[1], 2**63 - 1), *w[2:]) for w in plain(planted(rows), convs)]
    assert got == want


def test_plain_search_is_least():
    """The plain search itself against every list of edits of short conversations."""
    r = random.Random(3)
    for _ in range(60):
        rows = [(0, i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["Yes.", "No", "", f"{i}."])) for i in range(r.randint(0, 3))]
        best = None
        seen, kinds = set(), []
        for _, _, role, text in rows:
            kinds.append("gone" if not text or (role, text) in seen else "truncated" if text[-1] != "." else "")
            seen.add((role, text))
        for puts in product(range(3), repeat=len(rows) + 1):
            for edits in product("DKUA", repeat=len(rows)):
                if any(k == "gone" and e != "D" for k, e in zip(kinds, edits, strict=True)):
                    continue
                for first in product("ua", repeat=sum(puts)):
                    it, made, audit, cost = iter(first), "", "", 0
                    for i, n in enumerate(puts):
                        for _ in range(n):
                            made, audit, cost = made + next(it), audit + "I", cost + 2
                        if i < len(rows):
                            e = edits[i]
                            audit += "R" if e in "UA" else e
                            cost += {"D": 3, "K": 0}.get(e, 2) + (e != "D" and kinds[i] == "truncated")
                            made += "" if e == "D" else rows[i][2][:1] if e == "K" else e.lower()
                    if re.fullmatch("(s?(ua)+)?", made) and (best is None or (cost, audit) < best):
                        best = cost, audit
        found = plain(rows, [0])[0]
        assert (found[6], found[7]) == best, rows


def test_without_damage_and_empty(spark):
    rows = [(1, 0, "user", "Hello?"), (1, 1, "assistant", "Hi."), (2, 0, "user", "Twice."), (2, 1, "user", "Twice.")]
    got = {r.conv_id: (r.cost, r.audit, r.duplicate) for r in turns.repair(frame(spark, rows)).collect()}
    assert got == {1: (0, "KK", 0), 2: (5, "KDI", 1)}
    assert turns.repair(turns.damaged(frame(spark, [])), dropped_col="dropped").count() == 0


def test_few_states():
    """However long a conversation is, the table stays small."""
    table, r, v = turns.Table(), random.Random(0), turns.Table.start
    for _ in range(50_000):
        v, _ = table.step(v, r.choice([0, 0, *range(9)]) if r.random() < 0.9 else 0)
    assert len({s for s, _ in table.known}) < 60


def test_query_against_sql(spark, small):
    assert difference(queries.op13_conversation_repair(spark, small), connect(small), turns.ORACLE_SQL) == ""
