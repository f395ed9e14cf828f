import pytest
from pyspark.sql import types as T

from siftwell.llm.common import importable

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that operators use inside
        *(T.StructField(n, T.LongType()) for n in ("id", "key", "uid", "t", "row", "n", "token", "c0", "p0", "kept", "__id", "x", "data")),
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) and further columns with clashing names."""
    importable(spark)

    def build(rows):
        return spark.createDataFrame([(*(list(r) + [None] * 4)[:4], *([7] * 13)) for r in rows], DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty texts, copies, repeated rows, a very long text and a very long word."""
    long = " ".join(f"word{i % 977} thing{i % 89}" for i in range(30_000))
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "  \n\t", "en", "a"),
        (4, "one two three four five six seven eight nine ten eleven twelve and so it goes on for a while here", "en", "a"),
        (5, "one two three four five six seven eight nine ten eleven twelve and so it goes on for a while here", "fr", "a"),
        (5, "one two three four five six seven eight nine ten eleven twelve and so it goes on for a while here", "fr", "a"),
        (None, "one two three four five six seven eight nine ten eleven twelve and so it goes on for a while there", "en", None),
        (7, long, "en", "b"),
        (8, long + " more", "en", "b"),
        (9, "x" * 100_000, None, "b"),
        (10, "12345 67890", "en", "c"),
        (11, "Zeichen für Größe \U0001f642 ñandú", "de", "c"),
    ]


@pytest.fixture(scope="session")
def corpus():
    """Random texts of few syllables with copies, near copies, truncated copies and shared passages."""
    import random

    random = random.Random(3)
    words = ["".join(random.choice(["an", "to", "re", "éi", "ba", "Lu"]) for _ in range(random.randint(1, 4))) for _ in range(400)]
    say = lambda n: [random.choice(words) for _ in range(n)]
    line, texts = say(14), []
    for i in range(220):
        kind = random.random()
        if texts and kind < 0.15:
            text = list(random.choice(texts))
        elif texts and kind < 0.5:
            text = list(random.choice(texts))
            for _ in range(random.randint(1, 6)):
                text[random.randrange(len(text)) if text else 0 : 1] = say(1)
        else:
            text = say(random.choice([0, 1, 3, 4, 5, 6, 30, 60, 150]))
        if random.random() < 0.4:
            text[len(text) // 2 : len(text) // 2] = line
        texts.append(text)
    return [(3 * i + 100, random.choice([" ", "  ", "\n"]).join(t)) for i, t in enumerate(texts)]
