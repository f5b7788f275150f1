"""Cheapest repair of conversations by iterative-deepening A*.

The turns of a conversation are read in order, and every one is deleted, kept or given another role;
turns may be inserted before it. A repaired conversation has the roles of ``(s?(ua)+)?``: an automaton
with four states says which roles may follow. The search goes depth first through the edits in ASCII order (Delete,
Insert, Keep, Rerole) under a cost bound. A table holds for every failed pair of position and
state a bound that its remaining cost cannot be below, and ends a visit whose rest of the bound is smaller; the
next bound is the least cost that exceeded the last one. No path costs less than the bound, so the first
accepting path is the cheapest, and of those the least in ASCII order.

A conversation of any length is searched in pieces of at most ``PIECE`` turns and ``PIECE_BYTES`` of text (one
turn at least). Turns are dealt out by ranges of (conversation, turn), so that a conversation
with a third of all rows is many pieces on many tasks. Such pieces need what the turns behind them cost from each
state: every piece gives the least costs between its states (a 4 x 4 matrix), and one pass from the last piece to the
first adds them up. Inserts belong to the turn they precede, so a piece's edits are no prefix of
another choice of them, and the least edits of each piece in turn make the least edits of all. The digest
of a repaired conversation is one sequential hash: its pieces pass through a task as a stream, of which
the running hash and the edits are kept, one letter a turn.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wattspan.durable import durable

PIECE, PIECE_BYTES = 512, 4 << 20
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, RENAME, TRUNCATED = 4, 3, 3, 3
#: states: nothing yet, after system, after user, after assistant
STATES = range(4)
ACCEPTED = (0, 3)
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: the state after an inserted or renamed turn, and its role
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: least costs from each state when no turn is left
FINISH = (0, 2 * INSERT, INSERT, 0)
GOOD_PAIRS = {"su", "ua", "au"}

PIECE_SCHEMA = (
    "conv string, part int, seq int, whole boolean, codes string, roles array<string>, texts array<string>, "
    "turns array<long>, distinct_turns long, first_turn string, last_turn string, "
    "blank long, duplicate long, truncated long, illegal long, ends string, matrix array<int>"
)


def edits_of(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, turns used, next state) of the edits at a turn, in ASCII order. ``code`` is its fault
    (d: has to go, t: truncated, k: none) and the initial of its role."""
    found = [("D", DELETE, 1, state), ("I", INSERT, 0, NEXT[state])]
    if code[0] != "d":
        extra = TRUNCATED if code[0] == "t" else 0
        if state in KEEP.get(code[1:], {}):
            found.append(("K", extra, 1, KEEP[code[1:]][state]))
        found.append(("R", RENAME + extra, 1, NEXT[state]))
    return found


class Search:
    """The search over one piece. ``behind`` holds the least cost behind the piece from each state; with None the
    conversation ends here, and turns may be inserted behind the last one."""

    def __init__(self, codes: list[str], behind: list[int] | None):
        self.n, self.behind = len(codes), behind
        known = {(code, state): edits_of(code, state) for code in set(codes) for state in STATES}
        self.edits = [known[code, state] for code in codes for state in STATES]
        self.edits += [[("I", INSERT, 0, NEXT[s])] if behind is None else [] for s in STATES]
        least = {"d": DELETE, "t": min(DELETE, TRUNCATED), "k": 0}
        rest = np.cumsum([0, *[least[c[0]] for c in reversed(codes)]])[::-1] + min(behind or [0])
        # what the cost from (turn, state) cannot be below: failures raise it
        self.below = np.repeat(rest, 4).tolist()
        self.below[4 * self.n :] = behind or FINISH

    def run(self, state: int) -> tuple[str, int]:
        """The cheapest edits from ``state``, the least of them in ASCII order, and the state they end in."""
        while True:
            found = self._under(self.below[state], state)
            if found:
                return found

    def _under(self, bound: int, state: int) -> tuple[str, int] | None:
        below, edits, end = self.below, self.edits, 4 * self.n
        nodes, budgets, tried, path = [state], [bound], [0], []
        while nodes:
            node, budget = nodes[-1], budgets[-1]
            if node >= end and (self.behind is not None or node - end in ACCEPTED):
                return "".join(path), node - end
            ways, i = edits[node], tried[-1]
            while i < len(ways):
                letter, cost, used, after = ways[i]
                i += 1
                ahead = (node & ~3) + 4 * used + after
                if below[ahead] <= budget - cost:
                    tried[-1] = i
                    nodes.append(ahead)
                    budgets.append(budget - cost)
                    tried.append(0)
                    path.append(letter)
                    break
            else:
                below[node] = min(cost + below[(node & ~3) + 4 * used + after] for _, cost, used, after in ways)
                nodes.pop(), budgets.pop(), tried.pop()
                if path:
                    path.pop()
        return None


def between(codes: list[str]) -> list[int]:
    """The least cost from each state before the turns to each state behind them, row by row; inserts
    precede turns. A state that cannot be reached has a cost beyond all others."""
    far = 1 << 30
    known: dict[tuple[str, int], list] = {}
    out = []
    for start in STATES:
        cost = [far] * 4
        cost[start] = 0
        for code in codes:
            for _ in range(2):
                for s in STATES:
                    cost[NEXT[s]] = min(cost[NEXT[s]], cost[s] + INSERT)
            after = [far] * 4
            for s in STATES:
                if (code, s) not in known:
                    known[code, s] = edits_of(code, s)
                for _, price, used, to in known[code, s]:
                    if used:
                        after[to] = min(after[to], cost[s] + price)
            cost = after
        out += [min(c, far) for c in cost]
    return out


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """The turns that the edits ``audit`` make, and the cost-free replay's last state."""
    out, i = [], 0
    for letter in audit:
        if letter == "I":
            out.append((ROLE[state], ""))
            state = NEXT[state]
            continue
        if letter == "K":
            out.append((roles[i], texts[i]))
            state = KEEP[roles[i][:1]][state]
        elif letter == "R":
            out.append((ROLE[state], texts[i]))
            state = NEXT[state]
        i += 1
    return out, state


def price(audit: str, codes: list[str]) -> int:
    """The cost of the edits."""
    total, i = 0, 0
    for letter in audit:
        total += {"D": DELETE, "I": INSERT, "K": 0, "R": RENAME}[letter]
        if letter != "I":
            total += TRUNCATED if letter != "D" and codes[i][0] == "t" else 0
            i += 1
    return total


def conversation_key(column: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.when(column.isNull(), "").otherwise(F.concat(F.lit("="), column.cast("string")))


def faulty_turns(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their count, with conv (its key), bare (text without closing white space) and whether an
    earlier turn of the conversation has the same role and text."""
    space = F.lit(" ")
    rows = rows.select(
        conversation_key(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    rows = durable(rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")), "turns")
    first = rows.groupBy("conv", "role", "text").agg(F.min(F.struct("turn")).alias("first"))
    rows = rows.join(first, ["conv", "role", "text"])
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("k")
    return rows.select("conv", "turn", "role", "text", "copies", fault.alias("fault"), (~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("again"))


class _Piece:
    """Turns of one conversation that are being gathered."""

    def __init__(self, conv: str, first: bool):
        self.conv, self.first, self.bytes = conv, first, 0
        self.codes, self.faults, self.roles, self.texts, self.turns = [], [], [], [], []

    def add(self, turn: str | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        self.codes.append(("d" if fault in "bx" else fault) + (initial if initial in KEEP else "?"))
        self.faults.append(fault)
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.codes) >= PIECE or self.bytes >= PIECE_BYTES

    def record(self, part: int, seq: int, whole: bool) -> dict:
        known = [int(t) for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return {
            "conv": self.conv,
            "part": part,
            "seq": seq,
            "whole": whole,
            "codes": "".join(self.codes),
            "roles": self.roles,
            "texts": self.texts,
            "turns": [known[0], known[-1]] if known else [],
            "distinct_turns": len(set(known)),
            "first_turn": self.turns[0],
            "last_turn": self.turns[-1],
            "blank": self.faults.count("b"),
            "duplicate": self.faults.count("x"),
            "truncated": self.faults.count("t"),
            "illegal": sum(a + b not in GOOD_PAIRS for a, b in zip(initials, initials[1:])),
            "ends": "".join(i if i in KEEP else "?" for i in (initials[0], initials[-1])),
            "matrix": [] if whole else between(self.codes),
        }


def _pieces(batches):
    """Pieces of the sorted turns of a partition. A conversation is whole in one piece if turns of others lie on both
    sides of it."""
    part, held, first, seq = TaskContext.get().partitionId(), None, True, 0
    for rows in batches:
        out = []
        for conv, turn, role, text, copies, fault, again in rows.itertuples(index=False):
            if held is not None and held.conv != conv:
                out.append(held.record(part, seq, not first and held.first))
                first, held, seq = False, None, seq + 1
            for i in range(copies):
                if held is not None and held.full():
                    out.append(held.record(part, seq, False))
                    held, seq = _Piece(conv, False), seq + 1
                    if len(out) >= 16:
                        yield pd.DataFrame(out)
                        out = []
                held = held or _Piece(conv, True)
                held.add(turn, role, text, "b" if fault == "b" else "x" if again or i else fault)
        if out:
            yield pd.DataFrame(out)
    if held is not None:
        yield pd.DataFrame([held.record(part, seq, False)])


def _costs_behind(batches):
    """For the pieces of conversations, last one first: the least costs behind each."""
    conv, behind = None, None
    for rows in batches:
        out = []
        for row in rows.itertuples(index=False):
            last = row.conv != conv
            if last:
                conv, behind = row.conv, list(FINISH)
            out.append({"conv": row.conv, "part": row.part, "seq": row.seq, "last": last, "behind": behind})
            m = np.asarray(row.matrix, np.int64).reshape(4, 4)
            behind = (m + np.array(behind)).min(axis=1).tolist()
        yield pd.DataFrame(out, columns=["conv", "part", "seq", "last", "behind"])


def _codes(text: str) -> list[str]:
    return [text[i : i + 2] for i in range(0, len(text), 2)]


def _searched(batches):
    """Edits of every piece from each state it may be met in (a whole conversation: from the first)."""
    for rows in batches:
        audits, exits = [], []
        for codes, whole, last, behind in zip(rows["codes"], rows["whole"], rows["last"], rows["behind"], strict=True):
            search = Search(_codes(codes), None if last else [int(c) for c in behind])
            found = [search.run(s) for s in ([0] if whole else STATES)]
            audits.append([a for a, _ in found])
            exits.append([e for _, e in found])
        yield rows.assign(audits=audits, exits=exits)


def _joined(with_turns: bool):
    """The pieces of conversations in order, as a stream: the edits that follow from the state before each."""

    def run(batches):
        conv, state, piece, total = None, 0, 0, {}
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                if row.conv != conv:
                    conv, state, piece = row.conv, 0, 0
                    total = {"audit": [], "hash": hashlib.sha256(), "empty": True, "low": None, "high": None, "distinct": 0, "turn": None, "initial": None, "cost": 0}
                    total |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                audit = row.audits[state]
                turns, after = repaired(audit, state, row.roles, row.texts)
                for role, text in turns:
                    total["hash"].update(f"{'' if total['empty'] else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    total["empty"] = False
                state = after
                total["audit"].append(audit)
                total["cost"] += price(audit, _codes(row.codes))
                for name in ("blank", "duplicate", "truncated", "illegal"):
                    total[name] += getattr(row, name)
                first, last = row.ends
                if piece:
                    total["illegal"] += total["initial"] + first not in GOOD_PAIRS
                total["initial"] = last
                total["distinct"] += row.distinct_turns - (row.first_turn is not None and row.first_turn == total["turn"])
                total["turn"] = row.last_turn
                if len(row.turns):
                    total["low"] = int(row.turns[0]) if total["low"] is None else total["low"]
                    total["high"] = int(row.turns[1])
                made = {"conv": conv, "piece": piece, "edits": audit, "last": bool(row.last)}
                made["turns"] = [{"role": r, "text": t} for r, t in turns] if with_turns else None
                piece += 1
                if row.last:
                    gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["distinct"]
                    made |= {"gaps": gaps, "audit": "".join(total["audit"]), "repaired_sha256": total["hash"].hexdigest()}
                    made |= {name: total[name] for name in ("blank", "duplicate", "truncated", "illegal", "cost")}
                else:
                    made |= {"audit": None, "repaired_sha256": None}
                    made |= dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
                out.append(made)
            if out:
                yield pd.DataFrame(out)[[c.split()[0] for c in JOINED.split(", ")]]

    return run


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
JOINED = "conv string, piece int, edits string, last boolean, turns array<struct<role:string;text:string>>, " + REPORT


def repair_conversations(rows: DataFrame, with_turns: bool = True) -> DataFrame:
    """Repair the conversations of ``rows`` (conv_id, turn long, role, text; other columns are ignored).

    Turns are in the order of turn (nulls first), then of role and text. Null roles and texts are one space, a
    null conv_id is a conversation like any other. Each turn's first fault counts: blank, duplicate (role and text seen
    earlier), truncated. Returns per piece of a conversation: conv (see ``conversation_key``), piece, edits (their initials), turns (the
    repaired ones, null without ``with_turns``) and last; on the last piece of each also gaps, blank, duplicate, truncated, illegal,
    cost, audit (all edits) and repaired_sha256. An empty table gives an empty one; equal rows are
    turns of their own, of which the second is a duplicate.
    """
    turns = faulty_turns(rows).select("conv", F.col("turn"), "role", "text", "copies", "fault", "again")
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "text"]
    turns = turns.repartitionByRange(count, *order).sortWithinPartitions(*order)
    turns = turns.withColumn("turn", F.col("turn").cast("string"))
    pieces = durable(turns.mapInPandas(_pieces, PIECE_SCHEMA), "pieces")
    parted = pieces.where(~F.col("whole")).select("conv", "part", "seq", "matrix")
    parted = parted.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seq"))
    behind = parted.mapInPandas(_costs_behind, "conv string, part int, seq int, last boolean, behind array<int>")
    pieces = pieces.drop("matrix").join(behind, ["conv", "part", "seq"], "left").withColumn("last", F.coalesce("last", F.lit(True)))
    more = StructType.fromDDL("audits array<string>, exits array<int>")
    found = pieces.mapInPandas(_searched, StructType([*pieces.schema.fields, *more.fields]))
    found = found.repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return found.mapInPandas(_joined(with_turns), JOINED.replace(";", ", "))


def repair_report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per distinct conv_id of ``ids``: what ``repair_conversations`` finds in ``rows``. A conversation
    without rows has zeros, an empty audit and the digest of an empty text."""
    found = repair_conversations(rows, with_turns=False).where("last").drop("piece", "edits", "turns", "last")
    ids = ids.select("conv_id").distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    joined = ids.join(found, "conv", "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    names = [c.split()[0] for c in REPORT.split(", ")]
    return joined.select("conv_id", *[F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in names])
