import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and blank texts, ties, repeated rows, a very long text, odd characters.
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Hello World"), (5, "hello world"), (5, "hello world"), (None, "hello world"), (None, None),
    (6, "É" * 3), (7, "é" * 3), (8, "<|endoftext|> <s> ▁ x y\x1cz"), (9, "word " * 30000), (10, "x" * 70000), (11, "😀漢字   mixed Text, here."),
    (12, "A" * 64 + " tail one"), (13, "a" * 64 + " TAIL one"), (14, "A" * 64 + " tail two"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with every awkward case, and columns whose names clash with those that operators add or use."""
    rows = [(i, t, None, None, None, "mine", 1.5, True) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA + ", blob string, score double, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """A small corpus with exact and near copies, shared lines, secrets and junk."""
    import random

    rng = random.Random(7)
    words = ["".join(rng.choice(["an", "er", "th", "on", "re", "ou", "le"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [make(rng.randint(5, 300)) + "." for _ in range(120)]
    base = make(150)
    for _ in range(40):  # a dense group: some links, some not
        w = base.split()
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[3].upper()] * 5 + [texts[4]] * 30
    line = make(20)
    texts += [make(30) + "\n" + line + "\n" + make(12) for _ in range(10)] + [make(20) + ". " + line + ". " + make(20) for _ in range(5)]
    texts += ["Password: hunter22x and token='abc' AKIA" + "Q" * 16 + " " + "0af" * 9 + " api_key=token:secretvalue"] * 3
    texts += ["BUY!! NOW!! $$$ ### " * 40 for _ in range(5)]
    rows = [(k, t, "en" if k % 2 else "fr", "s", len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)
