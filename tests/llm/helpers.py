"""A small table of documents with every awkward case, and rows as dictionaries."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))


def awkward(spark, rows=None):
    """(doc_id, text, lang, source, n_chars) and columns whose names operators use themselves."""
    long_text = prose(1, 4000)
    base = prose(2, 120)
    near = base.split()
    near[7] = "changed"
    texts = [
        base, base, " ".join(near), base + " " + prose(3, 60), None, "", " ", "...", "word", "two words", long_text,
        long_text + " tail", "Éé ñandú 日本語 😀 " * 30, "a" * 3000, "<|endoftext|> literal", prose(4, 300) + prose(2, 120), prose(5, 90),
    ]
    table = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] if rows is None else rows
    if rows is None:
        table += [table[0], table[0], (None, base, None, None, None), (None, None, None, None, None)]
    extra = [(*r, 1, "x", 2.5, "r", 7, True, "k", 3, "h") for r in table]
    return spark.createDataFrame(
        extra,
        "doc_id long, text string, lang string, source string, n_chars long, id int, h string, score double, row string, "
        "n int, kept boolean, _id string, _rows int, _mentions string",
    )


def shown(frame) -> list[dict]:
    return [r.asDict() for r in frame.collect()]
