import random

import pytest

# Extra columns named like those that operators make themselves.
EXTRA = "k1 string, k2 int, id string, row string, score double, kept string, bucket int, n int"
ALPHABET = [f"w{i}" for i in range(40)]


def prose(seed: int, n: int, line: int = 12) -> str:
    rng = random.Random(seed)
    words = [rng.choice(ALPHABET) + ("é" if rng.random() < 0.05 else "") for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of([(doc_id, text), ...]): documents with clashing extra columns."""

    def make(pairs):
        rows = [(i, t, "x", 1, "y", "z", 0.5, "k", 2, 3) for i, t in pairs]
        return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, a null id, ties, copies, near copies, a long text."""
    base, long = prose(1, 120), prose(2, 6000)
    near = base.split(" ")
    near[7] = "other"
    return [
        (1, base),
        (2, None),
        (3, ""),
        (4, " \t\n \r\n"),
        (5, base),
        (6, " ".join(near)),
        (7, prose(3, 200) + "\n" + base),
        (7, prose(4, 90)),
        (8, long),
        (9, long[: len(long) // 2] + " end"),
        (10, "short one"),
        (11, "SHORT one"),
        (12, "a a " * 60),
        (13, prose(5, 150)),
        (13, prose(5, 150)),
        (None, prose(6, 100)),
        (None, None),
    ]
