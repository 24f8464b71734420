import random

import pytest

WORDS = ("the of and to in is that it was for on with as by at from this be are or an " + " ".join(
    f"{a}{b}" for a in ("ran", "tor", "ment", "ing", "plu", "vas") for b in ("ko", "lim", "dre", "sta", "on"))).split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(seed=3, n=60):
    """(doc_id, text) with copies, near copies, repeated rows, null ids, null, empty and long texts, odd characters."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    rows = [(i * 3, t) for i, t in enumerate(base)]
    rows += [(1000 + i, base[i]) for i in range(12)]                                # copies
    rows += [(1100 + i, base[i].replace(" ", "\t\n", 2) + " ") for i in range(8)]   # white space only
    rows += [(1200 + i, base[i].upper()) for i in range(6)]
    rows += [(1300 + i, prose(rng, 30) + " " + base[20] + base[21] + " " + prose(rng, 30)) for i in range(5)]
    rows += [(3, base[1]), (3, base[1]), (3, "another text of the same id"), (None, base[2]), (None, None), (7, None),
             (8, ""), (10, " \t\r\n"), (11, "x"), (13, prose(rng, 6000)), (14, "a" * 5000), (15, "ab" * 900 + "  end"),
             (16, "café 中文 \U0001f600 x\x1cy İſ K it's we'll 12,345 \x85  z"),
             (17, "é" * 400), (18, base[30] + "\n" + base[30])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with columns whose names the operators use themselves."""
    rows = [(i, t, "en", 1, "x", 5) for i, t in corpus()]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, hash int, digest string, n long").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
