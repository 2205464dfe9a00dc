"""Small tables with the awkward cases that every corpus operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, bits int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(n=40, seed=1):
    """Ordinary texts, then null and empty ones, copies, near copies, a long text, repeated rows, null identifiers; extra columns have clashing names."""
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdefghiklmnoprstuvé", k=random.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(random.choices(vocabulary, k=random.randint(12, 60))) + ".\n" + " ".join(random.choices(vocabulary, k=15)) for _ in range(n)]
    texts += [None, "", " \t\n", "one", "ONE", "two words", texts[0], texts[0], texts[1].upper(), texts[2] + " tail", texts[3].replace("a", "e", 1), "\n\n".join(["same line here"] * 9)]
    texts.append(" ".join(random.choices(vocabulary, k=20_000)))
    out = [(i, t, ["en", None][i % 2], [f"s{i % 4}", None][i % 5 == 4], 0, True, "x", 1) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, texts[7], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def frame(spark, *args, **kwargs):
    return spark.createDataFrame(rows(*args, **kwargs), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
