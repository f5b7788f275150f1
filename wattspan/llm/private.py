"""Personal data: spans that generators propose and boosted trees select, in SQL functions throughout.

``RULES`` find the base spans; a match that fails its check is dropped and not tried again. ``GENERATORS`` have high
recall: they propose spans that overlap each other and the base ones, for one kind or two, among them what a rule lost in a
longer match and what is written in disguise (``name (at) host``, ``10[.]1[.]2[.]3``, numbers with dots).

Every proposal has features of format and context, each a small integer (``FEATURES``). The trees learn from base spans,
which the proposals equal, from the same spans in disguise, and from the proposals that no base span of their kind touches. Equal
feature vectors are one row with counts, and all of them are learned from: at the driver while they are few, else from sums by feature and value.
Half of the texts grow the trees, the other half sets each kind's threshold: the least score from which
on the share of right proposals is at least ``PRECISION``.

Patterns are written so that none is tried twice over the same characters: runs are possessive and begin where
the character before is not of the run. Positions are those of code points: a text is split at its matches,
and the lengths of all before are summed by a window over (text, generator).
"""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattspan.durable import durable

KINDS = ["email", "ip", "card", "phone"]
PRECISION, ROUNDS, DEPTH, RATE = 0.99, 16, 3, 0.4
#: a split has to gain so much and leave so much weight on either side: single unlabelled spans make no leaf
LEAST_GAIN, LEAST_WEIGHT = 1.0, 1.0
#: gradients and weights are summed in whole parts of this size
UNITS = 1 << 30

AT = r"(?:@|\x20?[(\[{]\x20?(?i:at)\x20?[)\]}]\x20?|\x20(?i:at)\x20)"
DOT = r"(?:\.|\x20?[(\[{]\x20?(?:\.|(?i:dot))\x20?[)\]}]\x20?|\x20(?i:dot)\x20)"
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

RULES = {
    # a match may begin where the last one ended, within a run of its own characters
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "addresses": (["email"], rf"(?<!{LOCAL}){LOCAL}++{AT}{LABEL}++(?:{DOT}{LABEL}++)*+"),
    "quads": (["ip"], rf"(?<![0-9])[0-9]++(?:{DOT}[0-9]++){{3}}"),
    "chains": (["card", "phone"], r"(?<![0-9])[+(]{0,2}+[0-9](?:[\x20()./-]{0,3}[0-9]){8,}+"),
    "groups": (["card"], r"(?<![0-9])(?:[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}|[0-9]{12,19})(?![0-9])"),
    "calls": (
        ["phone"],
        r"(?<![0-9])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
    ),
}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: words before a span that speak for a kind
HINTS = {
    1: r"(?i)(?:e-?mail|contact|write|reach)",
    2: r"(?i)(?:\bip\b|host|server|address|addr)",
    3: r"(?i)(?:card|visa|master|amex|credit|debit|paid)",
    4: r"(?i)(?:tel|phone|call|fax|mobile|whatsapp)",
}
#: how far the context of a span reaches
BEFORE, AFTER = 24, 4
FEATURES = ["digits", "signs", "lead", "brackets", "char_before", "char_after", "valid", "groups", "longest", "disguise", "hint", "ending"]


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check (leading zeros change nothing)."""
    held = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(1, 20):
        digit = F.substring(held, i, 1).cast("int")
        # every second digit from the right is doubled, with the digits of the double added
        total = total + (digit if i % 2 else digit * 2 - F.when(digit > 4, 9).otherwise(0))
    return total % 10 == 0


def passes(kind: Column, found: Column) -> Column:
    """The check of a match of the kind's rule."""
    digits = digits_of(found)
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(kind == "card", n.between(12, 19) & luhn(digits))
        .otherwise(n.between(9, 15))
    )


def matches(docs: DataFrame) -> DataFrame:
    """(key, half, source, start, end, found, before, after) of every match of every rule and generator in
    ``docs`` (key, text). Rows of one key are one text."""
    patterns = RULES | {name: pattern for name, (_, pattern) in GENERATORS.items()}
    text, parts = F.col("text"), []
    for name, pattern in patterns.items():
        cut = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
        parts.append(F.struct(F.lit(name).alias("source"), F.when(text.rlike(pattern), cut).alias("cut")))
    rows = docs.select("key", F.inline(F.array(*parts))).where("cut IS NOT NULL")
    rows = rows.select("key", "source", F.posexplode("cut").alias("i", "piece"))
    gap, found = F.col("piece.gap"), F.col("piece.found")
    held = F.struct(F.char_length(gap).alias("skip"), found.alias("found"), F.right(gap, F.lit(BEFORE)).alias("before"), F.left(gap, F.lit(AFTER)).alias("open"))
    rows = rows.groupBy("key", "source", "i").agg(F.first(held).alias("held")).select("key", "source", "i", "held.*")
    order = Window.partitionBy("key", "source").orderBy("i")
    size = F.col("skip") + F.coalesce(F.char_length("found"), F.lit(0))
    end = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end.cast("long")).withColumn("after", F.lead("open").over(order)).where("found IS NOT NULL")
    return rows.select("key", "source", (F.col("end") - F.char_length("found")).alias("start"), "end", "found", "before", "after")


def _class_of(char: Column) -> Column:
    return (
        F.when(char == "", 0)
        .when(char.rlike(r"\s"), 1)
        .when(char.rlike(r"\p{L}"), 2)
        .when(char.rlike("[0-9]"), 3)
        .when(char.isin(".", "-", "/", "_", ":"), 4)
        .when(char.isin('"', "'", "=", "|"), 5)
        .otherwise(6)
    )


def features(kind: Column, found: Column, before: Column, after: Column) -> list[Column]:
    """The features of a span, in the order of ``FEATURES``: small integers."""
    digits = digits_of(found)
    n = F.length(digits)
    groups = F.split(found, "[^A-Za-z0-9]+")
    longest = F.array_max(F.transform(groups, F.length))
    ending = F.regexp_extract(found, "([A-Za-z0-9]+)$", 1)
    open_quad = found.rlike(rf"^{OCTET}(?:[^0-9]+{OCTET}){{3}}$")
    valid = (
        F.when(kind == "email", ending.rlike("^[A-Za-z]{2,}$") & found.rlike(rf"{DOT}{LABEL}+$"))
        .when(kind == "ip", open_quad)
        .when(kind == "card", n.between(12, 19) & F.when(n <= 19, luhn(digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )
    lead = F.when(found.startswith("+"), 1).when(found.startswith("00"), 2).when(found.startswith("("), 3).otherwise(0)
    style = F.when(found.rlike(r"[(\[{]\x20?(?i:at|dot|\.)"), 1).when(found.rlike(r"\x20(?i:at|dot)\x20"), 2).otherwise(0)
    hint = F.lit(0)
    for value, pattern in HINTS.items():
        hint = F.when(before.rlike(pattern), value).otherwise(hint)
    next_char, next_two = F.left(after, F.lit(1)), F.left(after, F.lit(2))
    goes_on = F.when(next_two.rlike("^[.-][A-Za-z0-9]"), 7).otherwise(_class_of(next_char))
    kinds = [
        F.least(n, F.lit(20)),
        F.least(F.length(F.regexp_replace(found, "[A-Za-z0-9]", "")), F.lit(10)),
        lead,
        found.contains("(").cast("int"),
        _class_of(F.right(before, F.lit(1))),
        goes_on,
        valid.cast("int"),
        F.least(F.size(groups), F.lit(10)),
        F.least(longest, F.lit(20)),
        style,
        hint,
        F.least(F.length(ending), F.lit(8)),
    ]
    return [F.coalesce(c.cast("int"), F.lit(0)).alias(name) for c, name in zip(kinds, FEATURES, strict=True)]


def disguised(kind: Column, found: Column) -> Column:
    """Other ways to write a base span."""
    spaced = F.regexp_replace(digits_of(found), "([0-9]{4})(?=[0-9])", "$1 ")
    plain = F.substring(found, F.lit(2), F.char_length(found))
    email = [F.replace(found, F.lit("@"), F.lit(" (at) ")), F.replace(F.replace(found, F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" [dot] "))]
    email.append(F.replace(F.replace(found, F.lit("@"), F.lit(" at ")), F.lit("."), F.lit(" dot ")))
    return (
        F.when(kind == "email", F.array(*email))
        .when(kind == "ip", F.array(F.replace(found, F.lit("."), F.lit("[.]")), F.replace(found, F.lit("."), F.lit(" dot "))))
        .when(kind == "card", F.array(spaced, F.translate(spaced, " ", ".")))
        .otherwise(F.array(F.concat(F.lit("00"), plain), F.translate(found, " ()", "..")))
    )


def spans_of(found: DataFrame) -> DataFrame:
    """Distinct spans of ``matches``: (key, kind, start, end, found, before, after), whether a rule found it (base), whether a generator
    did (proposed), and whether a base span of its kind (touches_own) or of any kind (touches) overlaps it."""
    kinds = F.create_map(*[x for name, (kinds, _) in GENERATORS.items() for x in (F.lit(name), F.array(*map(F.lit, kinds)))])
    base = F.col("source").isin(KINDS)
    rows = found.where(~base | passes(F.col("source"), F.col("found")))
    proposed = F.when(base, F.array("source")).otherwise(F.element_at(kinds, F.col("source")))
    rows = rows.select("key", F.explode(proposed).alias("kind"), "start", "end", "found", "before", "after", base.alias("base"))
    told = F.first(F.struct("found", "before", "after")).alias("told")
    rows = rows.groupBy("key", "kind", "start", "end").agg(F.max("base").alias("base"), F.max(~F.col("base")).alias("proposed"), told)
    first = F.when(F.col("base"), F.col("start"))
    last = F.when(F.col("base"), F.col("end"))

    def touching(*keys: str) -> Column:
        frame = (Window.unboundedPreceding, 0)
        behind = F.max(last).over(Window.partitionBy(*keys).orderBy("start").rangeBetween(*frame))
        ahead = F.min(first).over(Window.partitionBy(*keys).orderBy(F.desc("start")).rangeBetween(*frame))
        return F.coalesce((behind > F.col("start")) | (ahead < F.col("end")), F.lit(False))

    rows = rows.withColumn("touches", touching("key")).withColumn("touches_own", touching("key", "kind"))
    return rows.select("key", "kind", "start", "end", "told.*", "base", "proposed", "touches", "touches_own")


def half_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(2)).cast("int")


def vectors_of(spans: DataFrame) -> DataFrame:
    """Labelled feature vectors with counts: (kind, half, features, right, wrong). Spans are those of ``spans_of``."""
    kind, found = F.col("kind"), F.col("found")
    base = spans.where("base")
    told = ["key", "kind", "found", "before", "after"]
    right = base.select(*told).union(base.select("key", "kind", F.explode(disguised(kind, found)).alias("found"), "before", "after"))
    wrong = spans.where("proposed AND NOT base AND NOT touches_own").select(*told)
    # what is right for one kind is wrong for every other one that would propose it
    whole = {k: "|".join(pattern for kinds, pattern in GENERATORS.values() if k in kinds) for k in KINDS}
    others = F.array(*[F.when((kind != k) & found.rlike(f"^(?:{pattern})$"), k) for k, pattern in whole.items()])
    mistaken = right.withColumn("other", F.explode(F.array_compact(others)))
    wrong = wrong.union(mistaken.select("key", "other", "found", "before", "after"))
    rows = right.withColumn("right", F.lit(1)).union(wrong.withColumn("right", F.lit(0)))
    rows = rows.select("kind", half_of(F.col("key")).alias("half"), "right", *features(kind, found, F.col("before"), F.col("after")))
    return rows.groupBy("kind", "half", *FEATURES).agg(F.sum("right").alias("right"), F.sum(1 - F.col("right")).alias("wrong"))


def _split(sums: list[tuple[np.ndarray, np.ndarray]]):
    """The best split of a node by Newton gains, of each feature's sums of gradient and weight by value: (feature, cut,
    sums up to it), or None. Of equal gains the first; rounding makes none larger."""
    total_g, total_w = (x.sum() for x in sums[0])
    best, at = LEAST_GAIN, None
    for f, (g, w) in enumerate(sums):
        g, w = np.cumsum(g)[:-1], np.cumsum(w)[:-1]
        gains = g**2 / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g**2 / (total_w + 1)
        gains[np.minimum(w, total_w - w) < LEAST_WEIGHT] = 0.0
        if len(gains) and gains.max() > best * (1 + 1e-9):
            cut = int(np.flatnonzero(gains >= gains.max() * (1 - 1e-9))[0])
            best, at = gains.max(), (f, cut, (g[cut], w[cut]))
    return at


def _grown(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int):
    """A regression tree: a number, or (feature, cut, tree of values up to it, tree of those beyond)."""
    leaf = float(gradient.sum() / (weight.sum() + 1.0))
    if depth == 0 or len(x) < 2:
        return leaf
    at = _split([(np.bincount(x[:, f], gradient), np.bincount(x[:, f], weight)) for f in range(x.shape[1])])
    if at is None:
        return leaf
    low = x[:, at[0]] <= at[1]
    return (*at[:2], _grown(x[low], gradient[low], weight[low], depth - 1), _grown(x[~low], gradient[~low], weight[~low], depth - 1))


def value_of(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, value_of(low, x), value_of(high, x))


def boost(x: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> list:
    """Trees whose sum, times ``RATE``, is the log odds of a right span; the first is a number."""
    score = np.full(len(x), np.log((right.sum() + 1.0) / (wrong.sum() + 1.0)))
    trees = [float(score[0]) / RATE if len(x) else 0.0]
    for _ in range(ROUNDS if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        both = right + wrong
        trees.append(_grown(x, right - both * p, both * p * (1 - p), DEPTH))
        score = score + RATE * value_of(trees[-1], x)
    return trees


def threshold(score: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> float:
    """The least score, even odds at least, from which on enough of the spans are right: between
    the last score that will do and the next smaller one. Infinite if there is none."""
    order = np.argsort(-score, kind="stable")
    held, good, all_ = score[order], np.cumsum(right[order]), np.cumsum((right + wrong)[order])
    last = np.r_[held[1:] != held[:-1], True][: len(score)]
    fine = np.flatnonzero(last & (good > 0) & (good >= PRECISION * all_))
    if not len(fine):
        return float("inf")
    below = held[fine[-1] + 1] if fine[-1] + 1 < len(held) else -float("inf")
    return float(max(0.0, (held[fine[-1]] + below) / 2))


def _of_kind(columns: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("kind") == kind, c) for kind, c in columns.items()], F.lit(0.0))


def _next_trees(rows: DataFrame) -> dict:
    """A tree of each kind, like :func:`_grown`, from ``rows`` (kind, features, gradient, weight, the last two in whole ``UNITS``):
    a level at a time, from the sums by value of each feature of each node."""
    tree: dict = {}  # (kind, node) -> (feature, cut) or a number

    def below(kind: str, node: int) -> Column:
        if isinstance(at := tree.get((kind, node)), tuple):
            return F.when(F.col(FEATURES[at[0]]) <= at[1], below(kind, 2 * node + 1)).otherwise(below(kind, 2 * node + 2))
        return F.lit(float(node))

    ended: set = set()
    for level in range(DEPTH):
        node = _of_kind({kind: below(kind, 0) for kind in KINDS}).cast("int").alias("node")
        values = F.posexplode(F.array(*FEATURES)).alias("f", "value")
        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        found = rows.select("kind", node, "gradient", "weight", values).where(F.col("node") >= 2**level - 1)
        nodes: dict = {}
        # a row per value of a feature of a node
        for r in found.groupBy("kind", "node", "f", "value").agg(F.count("*").alias("n"), total("gradient"), total("weight")).collect():
            nodes.setdefault((r.kind, r.node), {}).setdefault(r.f, {})[r.value] = r.n, int(r.gradient), int(r.weight)
        for (kind, node), by_feature in nodes.items():
            if (kind, node) in ended:
                continue
            sums = []
            for f in range(len(FEATURES)):
                g, w = np.zeros((2, max(by_feature[f]) + 1))
                for value, (_, a, b) in by_feature[f].items():
                    g[value], w[value] = a / UNITS, b / UNITS
                sums.append((g, w))
            (g, w), n = (x.sum() for x in sums[0]), sum(x[0] for x in by_feature[0].values())
            at = _split(sums) if n > 1 else None
            if at is None:
                tree[kind, node] = float(g / (w + 1.0))
                ended.add((kind, node))
                continue
            tree[kind, node] = at[:2]
            for child, (a, b) in ((2 * node + 1, at[2]), (2 * node + 2, (g - at[2][0], w - at[2][1]))):
                tree[kind, child] = float(a / (b + 1.0))

    def whole(kind: str, node: int):
        at = tree.get((kind, node), 0.0)
        return (*at, whole(kind, 2 * node + 1), whole(kind, 2 * node + 2)) if isinstance(at, tuple) else at

    return {kind: whole(kind, 0) for kind in KINDS}


def _thresholds(rows: DataFrame) -> dict[str, float]:
    """:func:`threshold` of each kind over ``rows`` (kind, score, right, wrong): running sums within cells of scores, after
    those of all higher cells."""
    cell = F.floor(F.col("score") * 64).alias("cell")
    sums = [F.sum("right").alias("right"), F.sum(F.col("right") + F.col("wrong")).alias("all")]
    rows = durable(rows.groupBy("kind", cell, "score").agg(*sums), "scores")
    down = Window.partitionBy("kind").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    higher = rows.groupBy("kind", "cell").agg(F.sum("right").alias("right"), F.sum("all").alias("all"))
    higher = higher.select("kind", "cell", *[F.coalesce(F.sum(c).over(down), F.lit(0)).alias(f"{c}_higher") for c in ("right", "all")])
    inside = Window.partitionBy("kind", "cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    good, all_ = (F.sum(c).over(inside) + F.col(f"{c}_higher") for c in ("right", "all"))
    fine = rows.join(higher, ["kind", "cell"]).select("kind", "score", good.alias("good"), all_.alias("all"))
    fine = fine.where((F.col("good") > 0) & (F.col("good") >= F.lit(PRECISION) * F.col("all")))
    last = fine.groupBy("kind").agg(F.min("score").alias("last"))
    next_ = rows.join(last, "kind").groupBy("kind", "last").agg(F.max(F.when(F.col("score") < F.col("last"), F.col("score"))).alias("next"))
    found = {r.kind: max(0.0, (r.last + (-float("inf") if r.next is None else r.next)) / 2) for r in next_.collect()}  # a row per kind
    return {kind: found.get(kind, float("inf")) for kind in KINDS}


def learned(vectors: DataFrame, most: int) -> dict[str, tuple[list, float]]:
    """Trees and threshold of each kind, from all vectors. Up to ``most`` of them are learned from at the driver,
    more by :func:`_learned_by_sums`; the trees are the same."""
    rows = vectors.limit(most + 1).collect()
    if len(rows) > most:
        return _learned_by_sums(vectors)
    models = {}
    for kind in KINDS:
        held = sorted(tuple(r) for r in rows if r.kind == kind)
        table = np.array([r[1:] for r in held], np.int64).reshape(-1, len(FEATURES) + 3)
        x, right, wrong = table[:, 1:-2], table[:, -2].astype(float), table[:, -1].astype(float)
        grow, check = table[:, 0] == 0, table[:, 0] == 1
        trees = boost(x[grow], right[grow], wrong[grow])
        score = RATE * sum((value_of(t, x[check]) for t in trees), np.zeros(int(check.sum())))
        models[kind] = trees, threshold(np.round(score, 9), right[check], wrong[check])
    return models


def _learned_by_sums(vectors: DataFrame) -> dict[str, tuple[list, float]]:
    """Trees and thresholds whatever the number of vectors. Trees are grown from sums by feature and value, so the driver holds
    these and no vector; gradients are summed as whole numbers, in any order alike."""
    grows, score = F.col("half") == 0, F.col("score")
    totals = vectors.where(grows).groupBy("kind").agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong"))
    trees = {kind: [0.0] for kind in KINDS}
    for r in totals.collect():  # a row per kind
        trees[r.kind] = [float(np.log((r.right + 1.0) / (r.wrong + 1.0))) / RATE]
    told = {r.kind for r in totals.collect()}
    rows = vectors.withColumn("score", F.lit(RATE) * _of_kind({kind: F.lit(t[0]) for kind, t in trees.items()}))
    p, both = 1 / (1 + F.exp(-score)), F.col("right") + F.col("wrong")
    units = lambda c, name: F.round(c * F.lit(float(UNITS))).cast("long").alias(name)
    for _ in range(ROUNDS if told else 0):
        rows = durable(rows.select("kind", "half", *FEATURES, "right", "wrong", "score"), "boosted")
        slopes = units(F.col("right") - both * p, "gradient"), units(both * p * (1 - p), "weight")
        new = _next_trees(rows.where(grows).select("kind", *FEATURES, *slopes))
        for kind in told:
            trees[kind].append(new[kind])
        rows = rows.withColumn("score", score + F.lit(RATE) * _of_kind({kind: _tree_column(new[kind]) for kind in told}))
    least = _thresholds(rows.where(~grows).withColumn("score", F.round("score", 9)))
    return {kind: (trees[kind], least[kind]) for kind in KINDS}


def _tree_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(F.col(FEATURES[f]) <= cut, _tree_column(low)).otherwise(_tree_column(high))


def scored(spans: DataFrame, models: dict[str, tuple[list, float]], kind: str) -> DataFrame:
    """The proposals of one kind that touch no base span and reach its threshold, with their score."""
    trees, least = models[kind]
    rows = spans.where((F.col("kind") == kind) & F.col("proposed") & ~F.col("base") & ~F.col("touches"))
    rows = rows.select("key", "kind", "start", "end", *features(F.lit(kind), F.col("found"), F.col("before"), F.col("after")))
    total = _tree_column(trees[0])
    for tree in trees[1:]:
        total = total + _tree_column(tree)
    return rows.select("key", "kind", "start", "end", F.round(RATE * total, 9).alias("score")).where(F.col("score") >= least)


def apart(rows: DataFrame) -> DataFrame:
    """Of spans that overlap, one after the other, the one of the largest score (ties: the first, then the longest)."""
    order = Window.partitionBy("key").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("island", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("island").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("key", "island").orderBy(F.desc("score"), "start", F.desc("end"), "kind")
    return rows.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place", "island")


def text_key(docs: DataFrame) -> Column:
    """A name of a document by id and text, the same for repeated rows."""
    return F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(docs["text"], F.lit(""))))


def private_spans(docs: DataFrame, vectors: int = 20_000, seen: Callable | None = None) -> DataFrame:
    """(key, kind, start, end, base, score) of the personal data in the texts of ``docs`` (key, text): all base spans
    (score null) and the proposals that the trees select. Code points, end exclusive. Null and empty texts have none, rows of
    one key count once, an empty table gives an empty result; without base spans of a kind nothing is added
    to it. Up to ``vectors`` distinct feature vectors are learned from at the driver, more by
    distributed sums; ``seen`` is called with the models.
    """
    spans = durable(spans_of(matches(docs)), "spans")
    models = learned(durable(vectors_of(spans), "vectors"), vectors)
    if seen:
        seen(models)
    added = scored(spans, models, KINDS[0])
    for kind in KINDS[1:]:
        added = added.union(scored(spans, models, kind))
    base = spans.where("base").select("key", "kind", "start", "end", F.lit(True).alias("base"), F.lit(None).cast("double").alias("score"))
    return base.union(apart(added).select("key", "kind", "start", "end", F.lit(False), "score"))


def span_report(docs: DataFrame, vectors: int = 20_000) -> DataFrame:
    """Per document of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256 (of ``kind:start:end`` by start and kind, comma-joined) and spans (all of them, joined likewise). Null
    texts are empty, null ids are kept, repeated rows have a row each."""
    docs = docs.select("doc_id", "text")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key(docs).alias("key"))
    found = private_spans(docs.select("key", "text"), vectors)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    told = F.struct("start", place.alias("place"), "end", F.concat_ws(":", "kind", "start", "end").alias("told"))
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: s["told"]), ",")

    found = found.groupBy("key").agg(
        *counts,
        joined(F.collect_list(F.when(F.col("base"), told))).alias("base_spans"),
        joined(F.collect_list(told)).alias("spans"),
    )
    rows = docs.select("doc_id", "key").join(found, "key", "left")
    return rows.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
