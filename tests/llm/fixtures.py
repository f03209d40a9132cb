"""A small documents table with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rid string, fp string, block string"


def rows(n=60, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "ündé", "x|y", "and", "to", "a", "in", "那", "🦀"] + [f"w{k}" for k in range(60)]
    out = []
    for k in range(n):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 6)))
        out.append((k, text, rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s1", "é", None]), len(text), "x", "y", None, "z"))
    out += [(n, None, "en", "s0", None, None, None, None, None), (n + 1, "", "de", None, 0, None, None, None, None), (n + 2, " \n\t ", None, "s1", 4, None, None, None, None)]
    out += [(n + 3 + k, out[5][1], "en", "s1", 1, None, None, None, None) for k in range(7)]
    out += [out[7], out[7], (n + 20, ("long words here " * 4000).strip(), "en", "s0", 1, None, None, None, None), (None, "no id here at all", "en", "s0", 1, None, None, None, None)]
    return out


def docs(spark, n=60):
    return spark.createDataFrame(rows(n), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
