import math
from collections import Counter

import cases
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattspan.llm.mixing import BLOCK, FIRST, PRIOR, Code, Evidence, Mixer, _learned, _score, _sum, _tally, _train, decisions, find_classes, mixing_scores, vectors
from wattspan.llm.textarrays import Words


def test_code_is_a_full_tree():
    counts = np.zeros(256, np.int64)
    counts[[32, 97, 101]] = [5000, 3000, 2000]
    code = Code(counts)
    assert sum(2.0 ** -int(n) for n in code.length) == pytest.approx(1.0)
    assert code.length[32] <= 2 < code.length[200]


def test_spellings_add_up_to_one():
    """The probabilities of all next bytes after a prefix are one in total."""
    draw = np.random.default_rng(1)
    code, mixer = Code(draw.integers(0, 100, 256)), Mixer(0.3 + 0.1 * draw.standard_normal((25, 6)))
    total = 0.0
    for byte in range(256):
        if byte == 32:
            word = b"ab "
        else:
            word = b"ab" + bytes([byte]) + b" "
        slots, node, bit, _ = decisions(word, np.zeros(1, np.uint8), code)
        zeros, ones = (slots % 7).astype(float), (slots % 5).astype(float)
        p = mixer.predict(zeros, ones, node)[0]
        before = int(code.length[[97, 98]].sum())
        mine = slice(before, before + int(code.length[byte]))
        total += np.exp(np.log(np.where(bit == 1, p, 1 - p))[mine].sum())
    assert total == pytest.approx(1.0)


@pytest.mark.parametrize("chunk,bucket", [(8 << 20, 1_000_000), (2000, 100)])
def test_counts_and_base_scores_equal_brute_force(docs, chunk, bucket):
    table = docs.withColumn("train", F.coalesce(F.col("doc_id") % 7 != 2, F.lit(False)))
    rows = table.collect()
    words = [(r.text or "").encode().lower().split() + [None] for r in rows]
    counts = Counter(w for r, own in zip(rows, words) if r.train for w in own)
    n, v = sum(counts.values()), len(counts)
    expected = Counter(
        (r.doc_id, r.train, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 4))
        for r, own in zip(rows, words)
    )
    got = mixing_scores(table, "train", chunk_bytes=chunk, bucket_words=bucket).collect()
    assert Counter((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.n_tokens), set()).add(round(r.score, 6))
    assert all(len(s) == 1 for s in by_text.values())


def test_the_model_beats_the_unigrams_on_held_out_texts(spark):
    tongues = ("an er the of ing tion re ea st ou", "schen heit und der ung ver ge lich")
    rows = [(i, cases.prose(120, i, tongues[i % 2])) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.col("doc_id") % 5 != 0)
    held = [r for r in mixing_scores(table, "train").collect() if not r.train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nothing_to_learn_from_and_no_rows(docs, empty):
    none = mixing_scores(docs.withColumn("train", F.lit(False)), "train").collect()
    assert len(none) == docs.count() and {r.n_known for r in none} == {0} and {r.train_tokens for r in none} == {0}
    assert mixing_scores(empty.withColumn("train", F.lit(True)), "train").collect() == []


def test_counts_beyond_the_digits_of_a_float_are_whole():
    code, big = Code(np.zeros(256, np.int64)), 1 << 24
    rows = pd.DataFrame({"words": [b"ab ", b"ab "], "counts": [np.array([n], "<i8").tobytes() for n in (big, 1)], "classes": [b"\0", b"\0"]})
    sent = pd.concat(_tally(code)(iter([rows])))
    slots, _, bit, _ = decisions(b"ab ", np.zeros(1, np.uint8), code)
    slot, bit = int(slots[4, -1]), int(bit[-1])
    own = sent[sent["block"] == slot // BLOCK]
    whole = _sum(pd.concat([own, own])).iloc[0]
    held = np.zeros((BLOCK, 2), np.int64)
    held[np.frombuffer(whole["at"], "<u2")] = np.frombuffer(whole["n"], np.int64).reshape(-1, 2)
    assert held[slot % BLOCK, bit] % (2 * (big + 1)) == 0 and held[slot % BLOCK, bit] > 0


def test_counts_beyond_32_bits_reach_the_base_score():
    class Table:
        value = np.zeros((FIRST[-1], 2), np.float32)

    start, many = Mixer(), (1 << 32) + 5
    row = {"bucket": 0, "words": b"ab ", "classes": b"\0", "whole": np.array([many], "<i8").tobytes(), "chunks": [0], "places": [np.zeros(1, "<u4").tobytes()]}
    (found,) = _score(Code(np.zeros(256, np.int64)), Table, start.weights, start.map)(iter([pd.DataFrame([row])]))
    assert np.frombuffer(found["c"].iloc[0], "<i8").tolist() == [many]


def test_classes_come_from_all_training_texts(spark):
    tongues = ("an er the of ing tion re ea st ou", "schen heit und der ung ver ge lich", "ka mo ti ra su ne lo")
    rows = [(i, cases.prose(60, i, tongues[0 if i % 4 else 1 + i // 4 % 2])) for i in range(400)] + [(400, ""), (401, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    start, got = find_classes(table, "text", 0.1, rounds=0), find_classes(table, "text", 0.1)
    words = Words([t.encode() for _, t in rows[:400]])
    x = vectors(words.hashes(), words.doc, 400).astype(np.float16).astype(float)
    for _ in range(5):
        nearest = (x @ start.T).argmax(1)
        start = np.stack([x[nearest == j].sum(0) if (nearest == j).any() else c for j, c in enumerate(start)])
        start /= np.sqrt((start**2).sum(1, keepdims=True))
    assert np.allclose(got, start, atol=1e-5)
    assert np.allclose(find_classes(table.repartition(7), "text", 0.1), got, atol=1e-12)


def test_log_odds_are_worked_out_per_slot_not_per_decision(monkeypatch):
    class Table:
        value = np.random.default_rng(3).integers(0, 50, (FIRST[-1], 2)).astype(np.float32)

    code, start = Code(np.zeros(256, np.int64)), Mixer()

    def met(count: int) -> int:
        words = b"".join(b"w%d " % i for i in range(count))
        one = np.ones(count, "<i8").tobytes()
        row = {"bucket": 0, "words": words, "classes": bytes(count), "whole": one, "counts": one, "chunks": [0], "places": [np.zeros(1, "<u4").tobytes()]}
        seen, log = [], np.log
        with monkeypatch.context() as patch:
            patch.setattr(np, "log", lambda x, *more: seen.append(np.size(x)) or log(x, *more))
            list(_score(code, Table, start.weights, start.map)(iter([pd.DataFrame([row])])))
            list(_train(code, Table)(iter([pd.DataFrame([row])])))
        return sum(seen)

    assert met(10) == met(5000)


def test_evidence_leaves_a_word_out_of_the_counts_that_predict_it():
    draw = np.random.default_rng(2)
    counts = draw.integers(0, 600, (FIRST[-1], 2)).astype(np.float32)
    slots = np.stack([draw.integers(a, b, 500) for a, b in zip(FIRST, FIRST[1:])])
    bit, node = draw.integers(0, 2, 500), draw.integers(0, 255, 500)
    for left_out in (False, True):
        zeros, ones = counts[slots, 0].astype(float), counts[slots, 1].astype(float)
        if left_out:
            zeros, ones = np.maximum(zeros - (1 - bit), 0), np.maximum(ones - bit, 0)
        inputs, gate = Evidence(counts, left_out).met(slots, bit)
        assert np.allclose(inputs[:-1], np.log((ones + PRIOR) / (zeros + PRIOR)), atol=1e-5)
        p, own = Mixer().predict(zeros, ones, node)
        assert (own == gate).all() and np.allclose(Mixer().corrected(inputs, gate, node), p, atol=1e-6)


def test_words_not_learned_from_are_left_out():
    words, used = _learned(b"ab c de ", np.array([1, 0, 5, 9]))
    assert words == b"ab de " and used.tolist() == [0, 2]
    assert _learned(b"ab c ", np.zeros(2))[0] == b""
