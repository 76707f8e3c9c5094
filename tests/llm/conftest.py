import random
import string

import pytest

UPPER = string.ascii_uppercase
LOWER = string.ascii_lowercase
# Columns that operators might use themselves.
CLASHES = ["id", "fp", "key", "digest", "norm", "salt", "n", "mark", "s", "_s", "_p", "_text", "words", "part", "rank", "length", "at", "_gone", "_fp"]


def az(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def sentence(rng, n):
    return " ".join("".join(rng.choices(LOWER, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts of every awkward kind, with copies, near copies and shared passages."""
    rng = random.Random(5)
    shared, other = sentence(rng, 70), sentence(rng, 55)
    base = sentence(rng, 300)
    near = base.split(" ")
    near[20], near[150] = "changed", "also"
    plain = [sentence(rng, rng.randint(1, 120)) for _ in range(20)]
    return [
        None, "", "   \n\t ", "one", "two words", "ÄÖ É ß İ ſ K", "\u0301 \u200b 漢字 🙂 \U00030001", "A" * 5000, "te " * 3000,
        "Hello World", "hello world", "HELLO WORLD", "hello world", base, base.upper(), " ".join(near), base,
        sentence(rng, 30) + " " + shared + " " + sentence(rng, 10), shared + " " + sentence(rng, 40), sentence(rng, 15) + " " + shared,
        other + " " + sentence(rng, 5), sentence(rng, 9) + " " + other, "<|endoftext|> x <|endoftext|>", "tab\tand\x0bvt\x1cfs\x85nel\xa0nbsp",
        " ".join(sentence(rng, 200) for _ in range(60)), *plain,
    ]


@pytest.fixture(scope="session")
def awkward(spark, texts):
    """The texts as documents: a null id, repeated rows, and extra columns with likely names."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (500, "twice"), (500, "twice"), (501, "TWICE")]
    extra = tuple(None if i % 2 else "x" for i in range(len(CLASHES)))
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([r + extra for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
