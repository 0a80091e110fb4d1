import random

import pytest

from tidemark.llm.shipping import ship

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "ön") for b in ("ra", "sun", "de", "vi", "é")]


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def random_texts(seed=7, n=60):
    """Texts with shared lines and passages, exact copies, near copies and odd cases."""
    rng = random.Random(seed)
    shared = [passage(rng, 60) for _ in range(3)]
    line = "  This is a Line that many documents share \t"
    texts = []
    for i in range(n):
        parts = [passage(rng, rng.randint(1, 90)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), line.upper() if i % 2 else line)
        if i % 4 == 0:
            parts.append(rng.choice(shared)[rng.randint(0, 60):])
        if i % 7 == 0:
            parts.append("| " * rng.randint(30, 80))
        if i % 11 == 0:
            parts.append("ab" * rng.randint(60, 160))
        texts.append("\n".join(parts))
    texts += [texts[3], texts[3], texts[5] + " end", "", " \n\t ", "x", "\n\n", "a b", shared[0]]
    texts.append(passage(rng, 6000))
    texts.append(texts[-1][2000:30000] + " tail")
    return texts


@pytest.fixture
def rows():
    """Rows of a documents table: unique ids in mixed order, some nulls in other columns."""
    out = []
    for i, text in enumerate(random_texts()):
        lang = (None, "en", "de")[i % 3]
        source = (None, "a", "b", "b", "ü")[i % 5]
        out.append(((i * 37) % 211, text, lang, source, len(text) if i % 4 else None))
    out.append((1000, None, "en", "a", None))
    return out


@pytest.fixture
def documents(spark):
    def build(rows):
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return build


@pytest.fixture
def odd_documents(spark):
    """Rows without id, rows repeated, ids with two texts, and columns with clashing names."""
    long = "the same passage again " * 30
    rows = [
        (None, long, "e", 1, 2), (None, long, "e", 1, 2), (None, "other words here", None, 3, 4),
        (5, long, "e", 1, 2), (5, long, "e", 1, 2), (5, long + " and more", "f", 5, 6),
        (7, None, None, None, None), (7, None, None, None, None), (8, "", "s", 0, 0),
    ]
    columns = (
        "doc_id bigint, text string, source string, n_lines int, size int"
    )
    df = spark.createDataFrame(rows, columns)
    for name in ("Taken", "_k", "k", "t", "fp", "drop", "_drop", "id", "key", "kept", "start", "h1",
                 "n_words", "score", "lang_pred", "_b", "_place", "_part"):
        df = df.selectExpr("*", f"'{name}' AS `{name}`")
    return df.selectExpr("*", "text AS `a.b`", "'en' AS lang")
