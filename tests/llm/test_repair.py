"""Conversation structure repair: the tables against all edits of short conversations, and whole tables against a plain recursion."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillmesh.llm import repair

FORM = re.compile("(s?(ua)+)?")


def all_edits(rows):
    """Least (cost, letters) over every sequence of edits of (initial, gone, truncated), with up to two inserts at each place."""
    choices = []
    for initial, gone, truncated in rows:
        extra = 5 if truncated else 0
        choices.append([("D", 2, "")] if gone else [("D", 2, ""), ("K", extra, initial), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")])
    inserts = [("", 0, "")] + [("I" * n, 5 * n, "".join(x)) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    steps = [inserts]
    for c in choices:
        steps += [c, inserts]
    found = (tuple(zip(*path, strict=True)) for path in itertools.product(*steps))
    return min((sum(c), "".join(a)) for a, c, r in found if FORM.fullmatch("".join(r)))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_every_short_conversation(n):
    t = repair.tables()
    kinds = [("?", True, False), *[(i, False, cut) for i in "sua?" for cut in (False, True)]]
    cases = list(itertools.product(range(9), repeat=n))
    for case in random.Random(2).sample(cases, min(len(cases), 120)):
        letters, q = t.trace(bytes(case), repair.FINAL)[repair.START]
        cost = min(t.matrix(bytes(case))[r] + repair.FINAL[r] for r in range(4))
        assert (cost, letters + repair._closing(q)) == all_edits([kinds[s] for s in case])


def brute(rows):
    """(audit, cost, kept lines) of (turn, role, text) rows in order, from the last row to the first."""
    seen, kinds = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(fault)
    fill = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(go):
        for _ in range(3):
            go = {q: min(go[q], (go[fill[q][0]][0] + 5, "I" + go[fill[q][0]][1], (f"{fill[q][1]}:", *go[fill[q][0]][2]))) for q in go}
        return go

    never = (10**9, "", ())
    go = inserted({"": (0, "", ()), "s": never, "u": never, "a": (0, "", ())})
    for (_, role, text), fault in zip(reversed(rows), reversed(kinds), strict=True):
        new = {}
        for q in go:
            ways = [(go[q][0] + 2, "D" + go[q][1], go[q][2])]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                to = fill[q][0]
                ways.append((go[to][0] + 1 + extra, "R" + go[to][1], (f"{fill[q][1]}:{text}", *go[to][2])))
                if role[:1] and role[:1] in legal[q]:
                    ways.append((go[role[0]][0] + extra, "K" + go[role[0]][1], (f"{role}:{text}", *go[role[0]][2])))
            new[q] = min(ways)
        go = inserted(new)
    cost, audit, lines = go[""]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def table(seed, long=400):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "ok!", "", " \t", "Why?", "end. \n", "…", None, "a:b\nc.", "x" * 70 + ".", "x" * 70 + "b."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [None, *range(60), "long"]:
        n = long if conv == "long" else rng.randrange(0, 9)
        for turn in range(n):
            text = rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(10**6)}" + rng.choice([".", "?", "", "!"])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            at = rng.choice([turn, turn, turn, turn // 2, None, turn + 3])
            rows += [(None if conv is None else 999 if conv == "long" else conv, at, role, text)] * rng.choice([1, 1, 1, 1, 1, 3])
    rows += [(1000, 1, "user", "y" * 200_000 + ".")] * 2 + [(1001, None, None, None), (1002, 5, "tool", "A tool.")]
    rng.shuffle(rows)
    return rows


def expected(rows):
    of = {}
    for conv, turn, role, text in rows:
        of.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: brute(sorted(rs, key=order)) for c, rs in of.items()}


NAMES = "conv_id long, turn long, role string, text string, conv string, part int, seq int, m int, Text string, K int, audit string, cost int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y", 4, "z", 5) for r in rows], NAMES)


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_brute_force(spark, partitions):
    """With seven partitions a conversation of 400 turns lies in several pieces."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows = table(partitions)
        got = {r[0]: tuple(r)[1:] for r in repair.report(frame(spark, rows)).collect()}
        want = expected(rows)
        assert got == want
        lines = repair._lines(repair._named(frame(spark, rows), "conv_id", "turn", "role", "text").drop("conv_id"))
        pieces = lines.filter("conv = '=999'").select("part").distinct().count()
        assert pieces == 1 if partitions == 1 else pieces > 1
        # The edits, read as a table, say the same.
        edits = repair.repaired(frame(spark, rows)).orderBy("conv_id", "seq", "k").collect()
        for conv, w in want.items():
            mine = [r for r in edits if r["conv_id"] == conv]
            assert "".join(r["edit"] * r["times"] for r in mine) == w[6]
            text = "\n".join(f"{r['role']}:{r['text']}" for r in mine if r["edit"] != "D")
            assert hashlib.sha256(text.encode()).hexdigest() == w[7]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_damage(spark):
    rows = [r for r in table(3, long=60) if r[1] is not None or r[0] != 1000]
    want = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            out = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            want += [out] * (2 if k == 3 else 1)
    assert sorted(map(tuple, repair.damaged(frame(spark, rows)).collect()), key=str) == sorted(want, key=str)


def test_no_rows(spark):
    none = frame(spark, []).limit(0)
    assert repair.report(none).count() == 0
    some = frame(spark, [(1, 1, "user", "A."), (None, 1, "user", "A.")])
    got = repair.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), some)
    assert sorted(map(tuple, got.collect()), key=str) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, None)]
    assert repair.repaired(none).count() == 0
