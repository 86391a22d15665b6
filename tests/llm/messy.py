"""Small tables with everything that real ones hold: nulls, empty and long texts, ties, copies, clashing names."""

import random

SCHEMA = "doc_id long, text string, source string, key long, row string, blob string, size long, part int, a int, component int, h string"


def documents(spark, n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta's", "theta.", "iota", "kappa"]
    base = [" ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 120))) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "x" * 20_000), (4, "long words " * 6_000)]
    for i in range(5, n):
        t = rng.choice(base)
        w = t.split(" ")
        if rng.random() < 0.5 and len(w) > 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, (" " if rng.random() < 0.5 else "\n").join(w)))
    rows.append(rows[10])  # a repeated row
    full = [(d, t, None if d % 7 == 0 else f"s{d % 3}", d, "r", "b", 1, 2, 3, 4, "h") for d, t in rows] + [(None, "no id", None, 0, "", "", 0, 0, 0, 0, "")]
    return spark.createDataFrame(full, SCHEMA).repartition(3), rows


def with_null_id(rows):
    """The rows of documents(), the one without an id among them."""
    return [*rows, (None, "no id")]
