import hashlib
import itertools
import re
import zlib

import pytest

from noticelake.llm import conversation
from noticelake.llm.conversation import Repair, as_text, chained, cheapest, damage, edited

GRAMMAR = re.compile(r"(s?(ua)+)?")
ROLES = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, seg int"


def brute(rows):
    """Every edit sequence with at most two insertions at a place, by its cost and audit."""
    best = None
    per_row = [(["D"] if f in (1, 2) else ["K", "R", "D"]) for _, f in rows]
    for kinds in itertools.product(*per_row):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + k for n, k in zip(inserts, kinds)) + "I" * inserts[-1]
            cost = 5 * sum(inserts) + sum({"K": 0, "R": 1, "D": 2}[k] + (5 if f == 3 and k != "D" else 0) for k, (_, f) in zip(kinds, rows))
            if best is not None and (cost, audit) >= best:
                continue
            free = ["ua" if c in "IR" else rows[i][0] for c, i in zip(audit, itertools.accumulate([0, *(c != "I" for c in audit)])) if c != "D"]
            if any(GRAMMAR.fullmatch("".join(x)) for x in itertools.product(*free)):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("roles", ["", "u", "a", "su", "ua", "uu", "au", "ssu", "sxa", "uau", "uuaa", "asua"])
def test_search_is_exact(roles):
    for faults in itertools.product((0, 1, 3), repeat=len(roles)):
        rows = list(zip(roles, faults))
        assert cheapest(rows)[0][1:] == brute(rows)


def test_segments_chain():
    rows = [(r, f) for r, f in zip("suaxuuaasuaauxua" * 2, [0, 3, 0, 0, 2, 0, 1, 0] * 4)]
    whole = cheapest(rows)[0]
    for size in (1, 3, 7, 40):
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        ways = [[(e, *w) for e in conversation.NEXT for w in cheapest(p, e, (0, 1, 2, 3), True)] for p in parts]
        cost, audits = chained(ways)
        assert (cost, "".join(audits)) == whole[1:]


def expected(rows):
    """Result of one conversation's damaged rows (turn, role, text), by plain means."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        codes.append((role[:1], 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
        seen.add((role, text))
    _, cost, audit = cheapest(codes)[0]
    made, state = edited([r[1] for r in rows], [r[2] for r in rows], audit)
    assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in made)) and state in (0, 3)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    faults = [f for _, f in codes]
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(as_text(made).encode()).hexdigest(), made


def damaged(conv, turn, role, text):
    role, text = (" " if v is None else v for v in (role, text))
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def test_table(spark, monkeypatch):
    monkeypatch.setattr(conversation, "SEGMENT", 40)
    rows = [(c, t, ("system" if t == 0 and c % 3 == 0 else "user" if t % 2 else "assistant"), f"Text {c % 5} {t}" + ".!?;"[(c + t) % 4] + " \n"[: t % 3]) for c in range(60) for t in range(c % 9)]
    rows += [(777, t, "ua"[t % 2] + "x" * (t % 3), "Same." if t % 4 else f"Own {t}") for t in range(700)]  # a hot conversation with many repeats
    rows += [(778, 1, "user", "One turn."), (778, 1, "user", "One turn."), (778, 1, "assistant", None), (778, None, None, "no turn."), (778, None, "system", "S.")]
    rows += [(None, 1, "user", "Null id."), (None, 2, "assistant", "Answer."), (779, 0, "user", "Long " * 30_000 + "."), (780, None, "user", "x."), (781, 1, "", "no role."), (-5, -3, "user", "a!"), (-5, 3, "assistant", "b!")]
    frame = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).repartition(4)
    repair = Repair(damage(frame))
    found = {r.conv: tuple(r)[1:] for r in repair.results().collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).extend(damaged(*r))
    want = {c: expected(v) for c, v in by.items() if v}
    assert {c: w[:8] for c, w in want.items()} == found
    assert repair.segments.filter("conv = 777").count() > 5
    bare = Repair(damage(frame), texts=False)
    assert {r.conv: tuple(r)[1:] for r in bare.results().collect()} == found and bare.segments.filter("whole and texts is not null").isEmpty()
    with pytest.raises(ValueError):
        bare.rows()
    made = {}
    for r in sorted(repair.rows().collect(), key=lambda r: (r.part, r.seg, r.ord)):
        made.setdefault(r.conv, []).append((r.role, r.text))
    assert made == {c: w[8] for c, w in want.items() if w[8]}


def test_empty(spark):
    assert Repair(damage(spark.createDataFrame([], SCHEMA))).results().collect() == []
