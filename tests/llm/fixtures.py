"""Small documents with the awkward cases every operator must take: nulls, empty and long texts, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __text string, __th long, __id string, score double, length long, label int"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["ba", "ke", "li", "mo", "tu", "ran", "sel"]) for _ in range(draw.randint(1, 4))) for _ in range(words))


def documents(spark, extra=()):
    passage = "\n".join(prose(1000 + k, 20) for k in range(4))
    texts = {
        0: None,
        1: "",
        2: "one two three",
        3: prose(3, 120),
        4: prose(3, 120),
        5: prose(3, 120).replace(prose(3, 120).split()[60], "changed", 1),
        6: prose(6, 6000),
        7: f"{prose(7, 30)}\n{passage}\n{prose(70, 30)}",
        8: f"{prose(8, 25)}\n{prose(80, 9)}\n{passage}",
        9: "!!! ???",
        10: "one two three",
        11: prose(11, 2) + "\n\n  " + prose(12, 300) + "  \n",
    }
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "x", 1, "y", 0.5, 3, 1) for i, t in texts.items()]
    rows += [rows[3], (None, prose(99, 50), "en", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
