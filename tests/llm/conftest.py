import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, node string, score string, slot string"


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    """Random prose with exact copies, near copies, chains of near copies, nulls, empty, short, letterless and one very long text."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    prose = lambda k: [rnd.choice(words) for _ in range(k)]
    out: list[str | None] = [" ".join(prose(rnd.randint(1, 120))) for _ in range(n)]
    for i in range(0, n // 3):
        w = prose(60) if i % 2 else out[i].split()
        near = list(w)
        near[rnd.randrange(len(near))] = "changed"
        out += [" ".join(w), "\n".join(w), " ".join(near)]
    chain = prose(80)
    for _ in range(12):
        chain = chain[2:] + prose(2)
        out.append(" ".join(chain))
    passage = prose(50)
    out += [" ".join(passage + prose(rnd.randint(5, 40))) for _ in range(30)]
    out += [None, None, "", "   ", "\t\n", "one", "one two", "1234 5678", "é", " ".join(prose(20_000))]
    return out


@pytest.fixture(scope="session")
def corpus(spark):
    """(DataFrame, rows); extra columns bear names that the operators use themselves."""
    rows = [(i, t, None if i % 11 == 0 else "ab"[i % 2], None if i % 13 == 0 else f"s{i % 3}" if i % 3 else "hot", 0, "x", "x", "x", "x", "x") for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "a null id", "a", "hot", 0, "x", "x", "x", "x", "x"), (None, None, None, None, None, "x", "x", "x", "x", "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
