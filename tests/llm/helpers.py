"""Small tables with the awkward cases that every operator has to bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, k string, _id string, kept boolean"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("er", "th", "an", "in", "wh", "sh", "lo", "ta", "mi", "ge")) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows(texts):
    """Documents with ids in order, and columns whose names operators use themselves."""
    return [(i, t, ("en", "de", None)[i % 3], f"src{i % 7}" if i % 5 else None, None if t is None else len(t), 1, "k", "x", False) for i, t in enumerate(texts)]


def awkward():
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "   \n\t ", "one", "one two three four", base, base, " ".join(near), base.upper(), words(2, 20_000), "line a\nline b\nline a\n", words(3, 80) + "\n" + "shared boilerplate line here", "é ü ß 日本語 😀 " * 30, "a" * 5000, "\x00 nul \x1c sep", "x " * 300, "▁ sign <|endoftext|> token <s>"]
    texts += [words(100 + i, 60) + "\nshared boilerplate line here\n" + words(200 + i, 10) for i in range(8)]
    return rows(texts) + [rows([*texts])[5]]  # a wholly repeated row


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)
