"""Small tables with the awkward cases that every operator has to bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward_docs(seed=3):
    """Nulls in every column, empty and blank texts, a long one, exact and near copies, repeated rows, equal ids."""
    rng = random.Random(seed)
    base = [sentence(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", None, 1), (21, base[1].replace("a", "e", 1), None, "b", None), (22, base[2] + "\n" + base[3], "en", "b", 2)]
    rows += [(30, None, None, None, None), (31, "", "en", "a", 0), (32, " \n\t ", "en", "a", 4), (None, base[4], "en", "a", 1),
             (None, "no id here", "en", "a", 1)]
    rows += [(40, sentence(rng, 4000), "en", "long", 9), (41, "x" * 30_000, "en", "long", 9)]
    rows += [rows[5], rows[5], (6, "another text under an id that is taken", "en", "a", 3)]
    return rows


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def clashing(df, *names):
    """`df` with columns that carry names an operator might use itself."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit(7))
    return df
