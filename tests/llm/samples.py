"""Small texts with every awkward case."""

import random

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards boil green tea near an old river stone bridge".split()


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows, extra=True):
    """(doc_id, text[, lang, source]) rows, with columns whose names clash with
    ones that operators use inside."""
    full = [(*r, *("en", "s0")[len(r) - 2 :])[:4] for r in rows]
    if not extra:
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
    more = [(*r, i, "x", 1.5) for i, r in enumerate(full)]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, rid long, row string, score double")


AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "..."), (None, "a row without an id"), (7, "Ünï çødé wörds ñ 日本語"), (8, prose(6000, 1)), (9, prose(40, 2)), (9, prose(40, 2)), (10, "x" * 70000)]
