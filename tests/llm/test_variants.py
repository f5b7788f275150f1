import random
import zlib
from collections import Counter

import cases
import regex
from pyspark.sql import functions as F

from wattspan.llm.registered import misspelt
from wattspan.llm.variants import group_variants, near_words, roots, runs, word_counts


def edited(word: str, letters: str) -> set[str]:
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    less = {a + b[1:] for a, b in cuts if b}
    more = {a + c + b for a, b in cuts for c in letters}
    other = {a + c + b[1:] for a, b in cuts if b for c in letters}
    return (less | more | other) - {word}


def expected(counts: dict[str, int]) -> set[tuple]:
    letters = "".join(sorted(set("".join(counts))))
    near = {w: [x for x in edited(w, letters) if x in counts] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return out


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_equals_all_edits_of_all_words(spark):
    draw = random.Random(1)
    counts = {}
    for _ in range(3_000):  # few letters: runs, words near many others, long chains
        word = "".join(draw.choices("aaabé", k=draw.randint(1, 9)))
        counts[word] = draw.choice([3, 4, 6, 8, 17, 40, 90, 400])
    got = rows(group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert len(got) == len(counts) and set(got) == expected(counts)


def test_pairs_are_found_once(spark):
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "aaaab", "abaaa", "baaaaa", "aaaaab"]
    pairs = near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).select("word", "near").collect()
    assert len(pairs) == len(set(pairs))
    assert {tuple(p) for p in pairs} == {(w, x) for w in words for x in edited(w, "ab") if x in words}


def test_long_chain_and_a_root_of_many(spark):
    chain = [(f"w{i:05d}", f"w{i + 1:05d}") for i in range(70)]
    many = [(f"x{i:05d}", "w00000") for i in range(500)]
    got = dict(roots(spark.createDataFrame(chain + many, "word string, form string")).collect())
    assert len(got) == 570 and set(got.values()) == {"w00070"}


def test_query_of_whole_texts(spark, docs):
    counts = Counter()
    for key, text, *_ in cases.rows() * 3:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = regex.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            cut = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            counts[cut] += len(cut) >= 5
    counts = {w: n for w, n in counts.items() if n >= 3}
    assert any(len(w) > 1_000 for w in counts) and len(counts) > 500
    assert set(rows(group_variants(word_counts(misspelt(docs.union(docs).union(docs)))))) == expected(counts)


def test_awkward_words(spark, empty):
    assert rows(group_variants(word_counts(misspelt(empty)))) == []
    words = [("house", 4, 1), ("house", 5, 1), ("housse", 20, 1), (None, 9, 1), ("other", None, 1), ("", 7, 1), ("\U0001f600", 3, 1)]
    made = spark.createDataFrame(words, "word string, n long, root int")
    assert set(rows(group_variants(made))) == expected({"house": 9, "housse": 20, "": 7, "\U0001f600": 3})
    assert spark.range(1).select(runs(F.lit(None).cast("string"))).first()[0] is None


def test_a_third_of_all_rows_is_one_word(spark):
    many = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot word"[:3] + "test").otherwise(F.concat(F.lit("word"), F.hex(F.col("id") % 600))).alias("word"))
    found = {r[0]: r[3] for r in rows(group_variants(word_counts(many)))}
    assert found["hottest"] == 6667
