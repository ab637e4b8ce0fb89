import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts: ids count up from 0; other columns clash with what operators name."""

    def build(texts, start=0, **extra):
        rows = [(start + i, t, "en", "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names the operators use for their own."""
    from pyspark.sql import functions as F

    def add(df):
        for name in ("ids", "n_tokens", "part", "rank", "component", "node", "bucket", "marks", "sketch", "line", "rep", "_doc", "_gone"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return add


@pytest.fixture(scope="session")
def prose():
    """Texts with exact copies, near copies, shared passages, repeats of their own, nulls and empties."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("ba", "Du", "ke", "lo", "mé", "ro", "sí", "tu") for b in ("n", "r", "st", "lla", "ment", ".", ",")]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage = words(60)
    texts = [None, "", " ", "\n\t", "one", "one two", "  lead and trail  "]
    for _ in range(40):
        own = words(rng.randint(1, 300))
        texts.append(" ".join(own))
        if rng.random() < 0.4:
            near = own[:]
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
        if rng.random() < 0.3:
            texts.append("\n".join([" ".join(words(12)), " ".join(passage), " ".join(words(30))]))
        if rng.random() < 0.2:
            texts.append(texts[-1])
    texts.append(" ".join(words(40) * 6))
    texts.append(" ".join(words(6000)))
    return texts
