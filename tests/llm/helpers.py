"""Small documents with everything that may go wrong: nulls, empty and long texts, ties, copies, odd columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(60)] + ["Straße", "Éa", "x"]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def values(seed=0, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 25, 40, 80])) for _ in range(n)]
    passage = prose(rng, 30)
    for k in range(0, n, 7):
        texts[k] += "\n" + passage + " " + prose(rng, 5)
    for k in range(3, n, 11):
        texts[k] = texts[k - 1]  # exact copies
    for k in range(5, n, 13):
        texts[k] = texts[k - 1] + " tail"  # near copies
    texts[8], texts[9], texts[10] = "", None, " \t\n"
    texts[12] = prose(rng, 5000)
    texts[14] = "one"
    return [(k, t, "en", None if k % 9 == 0 else f"s{k % 4}" if k % 3 else "s0", None if t is None else len(t)) for k, t in enumerate(texts)]


def documents(spark, seed=0, n=60, odd=False):
    """odd: with columns whose names operators use inside."""
    df = spark.createDataFrame(values(seed, n), DOCS)
    if odd:
        df = df.selectExpr("*", "1 AS size", "'a' AS spans", "2 AS k0", "3 AS c0", "4 AS score", "5 AS taken", "6 AS id", "7 AS band", "8 AS _id", "9 AS items", "10 AS `row`", "11 AS target", "12 AS `a.b`")
    return df


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()
