import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from wattspan.llm import private
from wattspan.llm.private import apart, boost, private_spans, span_report, text_key, threshold, value_of

# the rules as the contract words them
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text: str) -> list[tuple[int, int, str]]:
    out = []
    for place, rule in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            right = [
                True,
                all(int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")) if place == 1 else False,
                12 <= len(digits) <= 19 and luhn(digits),
                9 <= len(digits) <= 15,
            ][place]
            if right:
                out.append((m.start(), place, m.end()))
    return sorted(out)


def expected(text: str | None) -> tuple:
    found = base(text or "")
    told = ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in found)
    return *[sum(k == place for _, k, _ in found) for place in range(4)], hashlib.sha256(told.encode()).hexdigest()


def report(spark, texts, schema="doc_id long, text string"):
    return span_report(spark.createDataFrame(list(texts), schema))


def number(draw, n):
    head = f"4{draw.randrange(10 ** (n - 2)):0{n - 2}d}"
    return next(head + str(last) for last in range(10) if luhn(head + str(last)))


def test_base_spans_equal_the_rules(spark):
    draw = random.Random(1)
    bits = ["a@b.c", "@", ".", "-", "_", "%", "x.y@z", "d.e-f", " ", "  ", "1.2.3.4", "256.1.1.1", "007.0255.1.0", "4111 1111 1111 1111", "4111-1111", "+1 (377) 555-0271", "+", "(", ")"]
    bits += ["12", "9", "555-0271", "é", "\U0001f600", "\n", "name", "0" * 13, "+49.30", "c_d@e.f"]
    texts = ["".join(draw.choices(bits, k=draw.randint(1, 14))) for _ in range(4_000)]
    got = {r.doc_id: tuple(r)[1:6] for r in report(spark, enumerate(texts)).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}
    assert all(sum(v[k] for v in got.values()) > 20 for k in range(4))


def corpus(n=700):
    """Prose with personal data in their plain form; every fifth text has a number that is none."""
    draw, out = random.Random(2), []
    for i in range(n):
        words = "the lamp of a river stood at noon near dot and hill".split() * 3
        kind = i % 5
        item = [
            f"ann{i}.lee@mail{i % 9}.example.com" if i % 2 else f"{draw.choice(words)}.{draw.choice(words)}@mail.example.com",
            ".".join(str(draw.randrange(256)) for _ in range(4)),
            number(draw, 16),
            f"+1 ({draw.randrange(100, 999)}) 555-{draw.randrange(10_000):04d}",
            str(draw.randrange(10**15, 10**16)) if i % 10 == 4 else f"lot {draw.randrange(10**9, 10**10)}",
        ][kind]
        words.insert(draw.randrange(len(words)), item)
        out.append((i, " ".join(words)))
    return out


def test_disguised_and_swallowed_spans_are_added_and_prose_is_left_alone(spark):
    draw = random.Random(3)
    card = number(draw, 16)
    hidden = {
        9001: ("lamp ann.lee (at) mail.example.com near", "email:5:34"),
        9002: ("lamp bob7.lee [at] mail3 [dot] example [dot] com near", "email:5:48"),
        9003: ("host 10[.]20[.]30[.]40 of", "ip:5:22"),
        9004: (f"noon {card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]} near", "card:5:24"),
        9005: (f"stood {card} 20231105 12 near", "card:6:22"),
    }
    plain = {9101: "the lamp stood at noon and a dot on the hill", 9102: "the 1234567890 lamp of 12 hills", 9103: "look at that. a hill", 9104: "built in 1999, 2001 and 2005"}
    rows = corpus() + [(k, t) for k, (t, _) in hidden.items()] + list(plain.items())
    got = {r.doc_id: r for r in report(spark, rows).collect()}
    assert {k: got[k].spans for k in hidden} == {k: s for k, (_, s) in hidden.items()}
    assert {k: got[k].spans for k in plain} == dict.fromkeys(plain, "")
    for i, text in corpus():
        told = [f"{private.KINDS[k]}:{a}:{b}" for a, k, b in base(text)]
        assert set(told) <= set(got[i].spans.split(","))
        assert len(told) == len([s for s in got[i].spans.split(",") if s]), (text, got[i].spans)


def test_the_main_path_has_no_python(spark):
    made = report(spark, corpus(60))
    plan = made._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_boosted_trees_and_thresholds():
    draw = np.random.default_rng(4)
    x = draw.integers(0, 6, (3_000, 3))
    truth = (x[:, 0] > 2) ^ (x[:, 1] > 3)
    right = np.where(truth, 5.0, 0.0)
    trees = boost(x, right, 5.0 - right)
    score = private.RATE * sum(value_of(t, x) for t in trees)
    assert ((score > 0) == truth).mean() > 0.99
    cut = threshold(score, right, 5.0 - right)
    held = score >= cut
    assert right[held].sum() >= private.PRECISION * 5 * held.sum() and held[truth].mean() > 0.95
    assert threshold(np.array([1.0, 1.0]), np.array([1.0, 0.0]), np.array([0.0, 1.0])) == float("inf")
    assert threshold(np.zeros(0), np.zeros(0), np.zeros(0)) == float("inf")
    # the same trees as columns
    assert boost(x[:0], right[:0], right[:0]) == [0.0]


def test_columns_equal_the_trees(spark):
    tree = (1, 2, (0, 0, -1.5, 2.0), (4, 3, 0.25, (2, 1, 4.0, 8.0)))
    x = np.random.default_rng(5).integers(0, 6, (200, len(private.FEATURES)))
    rows = spark.createDataFrame(x.tolist(), ", ".join(f"{c} int" for c in private.FEATURES))
    got = [r[0] for r in rows.select(private._tree_column(tree)).collect()]
    assert np.array_equal(got, value_of(tree, x))


def test_overlapping_additions(spark):
    rows = [("a", "card", 0, 10, 1.0), ("a", "phone", 5, 12, 2.0), ("a", "ip", 12, 20, 0.5), ("b", "ip", 0, 5, 1.0), ("b", "card", 0, 5, 1.0)]
    made = spark.createDataFrame(rows, "key string, kind string, start long, end long, score double")
    assert {(r.key, r.kind) for r in apart(made).collect()} == {("a", "phone"), ("a", "ip"), ("b", "card")}


def test_long_texts(spark):
    bits = ["x", "1", "a.b", "1 ", "1.2.", "b.", "(", "+1-", " ", "9." * 3 + "9 ", "a@b.c_"]
    short = [t for b in bits for t in (b * 2_000, b * 2_000 + "@", "a@" + b * 2_000 + "c", "+1" + b * 2_000)]
    got = {r.doc_id: tuple(r)[1:6] for r in report(spark, enumerate(short)).collect()}
    assert got == {i: expected(t) for i, t in enumerate(short)}
    # the rules worded plainly take quadratic time here; these must not
    long = [t for b in bits for t in (b * 100_000, "a@" + b * 100_000 + "c", "+1" + b * 100_000)]
    assert report(spark, enumerate(long)).count() == len(long)


def test_awkward_rows(spark, docs, empty):
    assert span_report(empty).collect() == [] and span_report(docs).count() == docs.count()
    rows = [(1, None, 5), (2, "", 5), (None, "a@b.c", 5), (None, "a@b.c", 6), (3, "a@b.c 1.1.1.1", 5), (3, "a@b.c 1.1.1.1", 5), (3, "+1 555 123 4567", 5)]
    got = report(spark, rows, "doc_id long, text string, key int")
    assert sorted(map(str, (tuple(r)[:6] for r in got.collect()))) == sorted(str((k, *expected(t))) for k, t, _ in rows)


def test_copies_of_one_text(spark):
    many = spark.range(3_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("write to a@b.example or +1 (377) 555-0271").alias("text"))
    spans = private_spans(many.select(text_key(many).alias("key"), "text"))
    assert spans.where("base").count() == 2
    assert span_report(many).select("n_email", "n_phone", "spans").distinct().count() == 1


def test_all_vectors_are_learned_from(spark):
    """More distinct vectors than the 20,000 that were taken before: trees and thresholds are those of all of them."""
    draw = np.random.default_rng(6)
    x = np.unique(draw.integers(0, 9, (24_000, len(private.FEATURES))), axis=0)
    half, chance = draw.integers(0, 2, len(x)), np.where((x[:, 0] > 4) ^ (x[:, 3] > 6), np.where(x[:, 1] > 5, 0.8, 0.999), 0.02)
    right = (draw.random(len(x)) < chance) * draw.integers(1, 4, len(x))
    wrong = np.where(right, 0, draw.integers(1, 4, len(x)))
    kinds = [["ip", "card"][i] for i in x[:, 7] % 2]
    rows = [(k, int(h), *map(int, v), int(a), int(b)) for k, h, v, a, b in zip(kinds, half, x, right, wrong, strict=True)]
    schema = ", ".join(["kind string", "half int", *(f"{c} int" for c in private.FEATURES), "right long", "wrong long"])
    models = private.learned(spark.createDataFrame(rows, schema).repartition(3), 20_000)
    for kind in ("ip", "card"):
        own = np.array(kinds) == kind
        grow, check = own & (half == 0), own & (half == 1)
        trees = boost(x[grow], right[grow].astype(float), wrong[grow].astype(float))
        score = private.RATE * sum(value_of(t, x[check]) for t in trees)
        got = private.RATE * sum(value_of(t, x[check]) for t in models[kind][0])
        assert len(trees) == len(models[kind][0])
        np.testing.assert_allclose(got, score, atol=1e-6)
        want = threshold(np.round(score, 9), right[check].astype(float), wrong[check].astype(float))
        assert abs(models[kind][1] - want) < 1e-6 and 0 < want < float("inf")
    assert models["email"] == models["phone"] == ([0.0], float("inf"))
