"""Texts that the operators' tests share."""

import random

WORDS = "the of and Ähre ción x 12.5 naïve don't end. 日本語 — to be or not is Haus bleu 7 foo@bar".split()


def prose(r: random.Random, n: int) -> str:
    return "".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.5 else "") + r.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))


def corpus(seed: int = 7, n: int = 60) -> list[tuple]:
    """(doc_id, text) with exact and near copies, passages in common, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    passage = prose(r, 30)
    out = []
    for i in range(n):
        t = prose(r, r.randint(1, 120))
        if i % 7 == 0:
            t = f"{t} {passage} {prose(r, 10)}"
        if i % 11 == 5:
            t = out[r.randrange(len(out))][1] or ""
        if i % 11 == 6 and out[-1][1]:
            t = out[-1][1] + " tail"
        out.append((i, t))
    out += [(n, ""), (n + 1, None), (n + 2, " \n\t "), (n + 3, prose(r, 5000) + passage), (None, passage), (3, out[3][1]), (n + 4, "word " * 300)]
    r.shuffle(out)
    return out


def frame(spark, rows, parts: int = 3):
    """documents with columns that clash with the operators' own."""
    more = [(i, t, "en", f"s{k % 3}", len(t or ""), "own", 1.0, "fp") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, fp string").repartition(parts)
