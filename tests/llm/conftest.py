import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, shard int, slot string, score double, size string, key int, g long, parcel string, rep long, part int, held boolean"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edge_rows():
    """Nulls in any column, empty and blank texts, repeated rows, one id on two texts, near copies, a long text."""
    rng = random.Random(1)
    base = sentence(rng, 80)
    near = base.split()
    near[40] = "changed"
    texts = [base, base.upper(), " ".join(near), None, "", " \t\n", "one two", "ONE two", "one", sentence(rng, 30_000), "ünïcödé ☃ 𝔘 " * 9, "é" * 5000]
    rows = [(k, t, "en" if k % 2 else None, "s1" if k % 3 else None, None, -k, 1, "x", 0.5, "y", 3, 4, "p", 5, 6, True) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[4]]
    rows += [(None, base, "en", "s1", *[None] * 12), (None, None, *[None] * 14), (7, "another text on the id seven here", "fr", "s2", *[None] * 12)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some(spark):
    """300 documents in groups of near copies, with shared passages, of three sources."""
    rng, rows = random.Random(2), []
    passage = sentence(rng, 40)
    for k in range(300):
        if k % 5 == 0 or not rows:
            words = sentence(rng, rng.randrange(1, 120)).split()
        else:
            words = rows[-1][1].split()
            for _ in range(max(1, len(words) // rng.choice([12, 40, 200]))):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
        text = " ".join(words)
        if k % 7 == 0:
            text += " " + passage
        rows.append((k, text, rng.choice(["en", "fr"]), f"s{k % 3}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
