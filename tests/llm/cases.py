"""Small documents with the awkward cases that every operator has to meet."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, length long, bucket string, key string"


def prose(n: int, seed: int, syllables: str = "an er the of ing tion re ea st ou wh nd") -> str:
    draw = random.Random(seed)
    parts = syllables.split()
    return " ".join("".join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(n))


def rows() -> list[tuple]:
    """Prose, an exact copy, a near copy, a shared passage, null and blank texts, one long
    word, a text of one repeated word, a very long text, a null key and a repeated row."""
    passage = prose(60, 99)
    base = prose(300, 1)
    near = base.split()
    near[150] = "changed"
    texts = {
        1: base,
        2: base,
        3: " ".join(near),
        4: prose(80, 2) + "\n" + passage + "\t" + prose(80, 3),
        5: passage + " " + prose(90, 4),
        6: None,
        7: "",
        8: " \n\t ",
        9: "x" * 5000,
        10: "same " * 400,
        11: prose(20_000, 5),
        12: "Two words",
        13: "12 34 -- !!",
        14: "<|endoftext|> it's  é́ 日本語\r\n ok",
        15: prose(200, 6, "schen heit und der ung ver ge lich"),
    }
    made = [(k, t, "de" if k == 15 else "en", None, None) for k, t in texts.items()]
    made += [(None, base, None, "s", 3), (16, prose(40, 7), None, "s", 1), (16, prose(40, 7), None, "s", 1)]
    return [(*r, 5, 6, "b", "k") for r in made]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
