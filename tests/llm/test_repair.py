import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from wattspan.llm import repair
from wattspan.llm.registered import damaged, op13_conversation_repair
from wattspan.llm.repair import Search, between, repair_conversations, repair_report

SCHEMA = "conv_id long, turn long, role string, text string, audit int, conv string"
ACCEPT = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "x" if (role, text) in seen else "k" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, edits) by the least of all choices from the end, over prefixes of the wanted roles."""
    marks = faults(rows)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for r in "ua":
                if r in after[state]:
                    ways += [(3 + c, "I" + e) for c, e in best(i, after[state][r], inserts + 1)]
        if i < len(rows):
            ways += [(4 + c, "D" + e) for c, e in best(i + 1, state, 0)]
            if marks[i] in "kt":
                extra = 3 * (marks[i] == "t")
                initial = rows[i][0][:1]
                if initial in after[state]:
                    ways += [(extra + c, "K" + e) for c, e in best(i + 1, after[state][initial], 0)]
                for r in "ua":
                    if r in after[state]:
                        ways += [(3 + extra + c, "R" + e) for c, e in best(i + 1, after[state][r], 0)]
        return [min(ways)] if ways else []

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for state in after:
            best(i, state, 0)
    return best(0, "", 0)[0]


def report(rows):
    """What the contract asks of one conversation's (turn, role, text) rows in order."""
    said = [(r, t) for _, r, t in rows]
    marks = faults(said)
    cost, audit = cheapest(said) if rows else (0, "")
    out, i, state = [], 0, ""
    for e in audit:
        turn = said[i] if i < len(said) else None
        role = "assistant" if state == "u" else "user"
        if e == "I":
            out.append((role, ""))
        elif e == "R":
            out.append((role, turn[1]))
        elif e == "K":
            out.append(turn)
        i += e != "I"
        state = out[-1][0][:1] if out else ""
    assert ACCEPT.fullmatch("".join(r[:1] for r, _ in out))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
    body = "\n".join(f"{r}:{t}" for r, t in out)
    counts = [marks.count(m) for m in "bxt"]
    return gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(body.encode()).hexdigest()


def made(seed, n, longest):
    draw, rows = random.Random(seed), []
    texts = ["Yes.", "No", "Why?", "", " \t", "Good!  ", "long tale. " * 30 + "end", "x\n"]
    for conv in range(n):
        turn = 0
        for _ in range(draw.randint(0, longest)):
            turn += draw.choice([0, 1, 1, 1, 1, 3])
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "student", "", "\n"])
            rows.append((conv, turn if draw.random() > 0.03 else None, role, draw.choice(texts) + draw.choice(["", str(turn) + "."]), 1, "c"))
    return rows


def by_conversation(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def compared(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in repair_report(df, df).collect()}
    assert got == {c: report(held) for c, held in by_conversation(rows).items()}


def test_search_is_the_cheapest_and_least():
    for rows in product([("user", "a."), ("assistant", "b."), ("system", "c"), ("user", "")], repeat=5):
        marks = faults(rows)
        codes = [("d" if m in "bx" else m) + r[0] for (r, _), m in zip(rows, marks)]
        audit, end = Search(codes, None).run(0)
        assert (repair.price(audit, codes), audit) == cheapest(rows) and end in (0, 3)


def test_pieces_add_up_to_the_whole():
    draw = random.Random(3)
    for _ in range(60):
        codes = [draw.choice("kkktd") + draw.choice("suaua?") for _ in range(40)]
        whole, _ = Search(codes, None).run(0)
        cut = draw.randint(1, 39)
        behind = [min(between(codes[cut:])[4 * s + e] + repair.FINISH[e] for e in range(4)) for s in range(4)]
        head, state = Search(codes[:cut], behind).run(0)
        tail, _ = Search(codes[cut:], None).run(state)
        assert head + tail == whole


def test_equals_brute_force(spark):
    compared(spark, made(1, 300, 9))


def test_one_conversation_in_many_pieces(spark):
    rows = [r for r in made(2, 40, 8) if r[0] % 3] + [(7, *r[1:]) for r in made(4, 12, 90)]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = repair_conversations(df)
    seven = pieces.where("conv = '=7'").orderBy("piece").collect()
    assert len(seven) > 1 and [r.last for r in seven] == [False] * (len(seven) - 1) + [True]
    assert "".join(r.edits for r in seven) == seven[-1].audit
    body = "\n".join(f"{t.role}:{t.text}" for r in seven for t in r.turns)
    assert hashlib.sha256(body.encode()).hexdigest() == seven[-1].repaired_sha256
    compared(spark, rows)


def test_repeated_rows_beyond_one_piece(spark):
    rows = [(1, 0, "user", "Hi.", 1, "c")] * 1_500 + [(1, 1, "assistant", "Yes.", 1, "c"), (2, 0, "user", "Hi.", 1, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in repair_report(df, df).collect()}
    assert got[1].audit == "K" + "D" * 1_499 + "K" and got[1].duplicate == 1_499 and got[1].cost == 4 * 1_499
    assert got[2].audit == "D" or (got[2].cost, got[2].audit) == cheapest([("user", "Hi.")])


def test_awkward_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_report(empty, empty).collect() == [] and repair_conversations(empty).collect() == []
    long = "word " * 300_000
    rows = [(None, None, None, None, 1, "c"), (None, 4, "user", long + ".", 1, "c"), (3, None, "user", None, 1, "c"), (3, None, "user", "Ok.", 1, "c")]
    rows += [(4, -(2**62), "system", "é\U0001f600.", 1, "c"), (4, 2**62, "user", "Hm.", 1, "c"), (5, 0, "system", "Only this.", 1, "c")]
    compared(spark, rows)
    gone = repair_report(empty, spark.createDataFrame(rows, SCHEMA)).where("conv_id = 3").first()
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("conv", [None, 5])
def test_damage(spark, conv):
    rows = [(conv, t, "assistant" if (t or 0) % 2 else None, "One. Two! Three?", 1, "c") for t in [None, *range(60)]]
    got = damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role = "user" if kind == 4 else role or " "
        text = {1: "", 2: "One Two Three"}.get(kind, text)
        want += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) != 61


def test_query_on_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    held = by_conversation([tuple(r) for r in damaged(rows).select("conv_id", "turn", "role", "text").collect()])
    want = {r.conv_id: report(held.get(r.conv_id, [])) for r in rows.select("conv_id").distinct().collect()}
    assert {r[0]: tuple(r)[1:] for r in op13_conversation_repair(spark, sf_dir).collect()} == want
    assert op13_conversation_repair(spark, sf_dir).where(F.col("cost") > 0).count() > 5
