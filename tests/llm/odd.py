"""Small awkward inputs shared by the operator tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, row string, th long, _id long, length long"


def docs_frame(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names the operators use."""
    return spark.createDataFrame([(d, t, la, s, len(t) if t is not None else None, -1, -2, "x", -3, -4, -5) for d, t, la, s in rows], SCHEMA).repartition(3)


def sentence(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


def odd_rows(seed=1, n=60):
    """Nulls, empty and blank texts, one long text, copies, near copies, repeated rows, shared passages and lines."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Über", "naïve", "x|y", "a b"]
    shared = sentence(rng, 40, vocab)
    line = "A line that many sites show below their pages."
    rows = [(100, None, "en", "s1"), (101, "", "en", None), (102, " \t\n\x0b ", None, "s2"), (None, sentence(rng, 30, vocab), "de", "s1"),
            (103, sentence(rng, 6000, vocab), "en", "s0"), (104, "one", "en", "s0"), (105, "a " * 200, "en", "s3"), (106, "p q r " * 50, "en", "s3")]
    for i in range(n):
        t = sentence(rng, rng.randint(1, 90), vocab)
        if i % 5 == 0:
            t += "\n" + shared[rng.randint(0, 60):]
        if i % 4 == 0:
            t += "\n" + line + "\n" + sentence(rng, 3, vocab)
        rows.append((i, t, rng.choice(["en", "de"]), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])}"))
    rows += [(200 + i, rows[20][1], "en", f"s{i % 7}") for i in range(12)]  # copies
    long = rows[4][1].split()
    for i in range(10):  # near copies
        w = list(long[:300])
        w[rng.randrange(300)] = f"changed{i}"
        rows.append((300 + i, " ".join(w), "en", f"s{i % 7}"))
    return rows + [rows[20], rows[0], rows[3]]  # repeated rows
