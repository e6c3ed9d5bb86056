import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, runs int, size string, n int, id string, tag string, n_removed string"


def make_texts() -> list:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, line = " ".join(words(70)), " ".join(words(9))
    texts = [None, "", "   \t\n", "one", "One", "two words", "\n\n\n", "é ß 你好 \U0001f600 ж", "x y\x0bz\x85w v", "a " * 400, "ab" * 900]
    base = words(220)
    for k in range(24):
        body = words(rng.randint(1, 260))
        if k % 4 == 0:
            body[len(body) // 2 : 0] = passage.split()
        text = " ".join(body)
        if k % 3 == 0:
            text = text + "\n" + line + "\n" + line.upper() + "\n" + " ".join(words(12))
        texts.append(text)
    for k in range(8):  # near copies
        copy = list(base)
        for _ in range(k * 2):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [texts[15], texts[15], texts[16].upper(), texts[20] + " ", " ".join(words(6_000)), "\n".join([line, "tail", "other"] * 3)]
    return texts


@pytest.fixture(scope="session")
def unique_rows():
    return [(k * 3 % 97, t, "en" if k % 5 else None, [None, "s1", "s2", "ü"][k % 4], None, "d", 1, "z", None, "i", None, "q") for k, t in enumerate(make_texts())]


@pytest.fixture(scope="session")
def rows(unique_rows):
    """With repeated rows, an id with two texts, and a row without id."""
    r = unique_rows
    return [*r, r[20], r[20], (r[21][0], *r[22][1:]), (None, *r[23][1:])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def unique_docs(spark, unique_rows):
    return spark.createDataFrame(unique_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
