import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, id string, rows string, h long, block int, label int"


def prose(rng, words=60):
    syllables = "an er th on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


def rows_of(texts, sources=("a", "b", None)):
    """Documents with columns that clash with names used inside the operators."""
    return [(k, t, "en", sources[k % len(sources)], None, 1, "x", "y", 7, 9, None) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """Plain texts, copies, near copies, null, empty, wordless and one very long text."""
    rng = random.Random(3)
    plain = [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    long = prose(rng, 30_000)
    near = [plain[k] + " " + prose(rng, 1) for k in range(0, 20, 2)]
    return [*plain, *plain[:15], *near, None, "", " \n\t ", "² ½ ③ 12", "a", "A", "é ñ", long, long + " tail", None, ""]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
