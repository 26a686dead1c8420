import os
import random

import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _wanted_id long, id long, key string, length long"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "stone", "river", "über", "naïve", "walk", "a", "tree", "cloud"]) + rng.choice(["", "s", "ing", "er"]) for _ in range(n))


def corpus():
    """Texts with copies, near copies, shared passages, very long and very short ones."""
    rng = random.Random(11)
    base = words(rng, 120)
    passage = words(rng, 40)
    texts = [base, base, base.replace("stone", "stones", 1), base + " end", "", " \n\t ", "one", "one two", "one two three", "ONE Two three", "x" * 5000, None]
    texts += [words(rng, 60) + " " + passage + " " + words(rng, 50) for _ in range(6)]
    texts += ["same line\n" * 30, "All rights reserved.\nReleased under the MIT License.", "日本語 テキスト 😀 <|endoftext|> tail", words(rng, 4000)]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t) if t else None, 7, i, "k", 3) for i, t in enumerate(corpus())]
    rows.append(rows[2])
    rows.append((None, "a text without id that stands alone", None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("the test tables aren't here")
    return SF
