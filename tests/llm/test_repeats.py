import hashlib
from collections import Counter

import cases
import pytest

from wattspan.llm.repeats import remove_repeats


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window,chunk,bucket", [(35, 2_000_000, 500_000), (35, 3000, 40), (7, 2000, 100), (2, 5000, 50)])
def test_equals_brute_force(docs, window, chunk, bucket):
    rows = docs.collect()
    expected = Counter(
        (r.doc_id, r.text, n, lost, hashlib.sha256(kept).hexdigest(), kept.decode())
        for r, (n, lost, kept) in zip(rows, brute([r.text for r in rows], window))
    )
    got = remove_repeats(docs, window=window, chunk_chars=chunk, bucket_words=bucket).collect()
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == expected


def test_other_columns_stay_and_names_clash(spark, docs):
    clash = docs.withColumnRenamed("id", "n_words").withColumnRenamed("length", "kept_text")
    got = remove_repeats(clash)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "bucket", "key", "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert {r.lang for r in got.collect()} == {"en", "de", None}
    big = 2**60 + 1
    one = cases.documents(spark, [(big, "a b", None, None, big, 1, 2, "b", "k"), (None, "c", None, None, None, 1, 2, "b", "k")])
    assert {(r.doc_id, r.n_chars) for r in remove_repeats(one, with_text=False).collect()} == {(big, big), (None, None)}


def test_empty_table(empty):
    assert remove_repeats(empty).collect() == []
