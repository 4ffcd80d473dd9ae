"""Documents with the awkward cases that every operator has to answer, and plain helpers."""

from __future__ import annotations

import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, spans string, row string"
WORDS = {
    "en": "the of and in that for was with his they this from have not but what all were when your can said there".split(),
    "de": "der und die nicht das ist mit sich auf für werden über können größer schön straße müssen würde zwei".split(),
}


def ascii_lower(x: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def words_of(text: str | None) -> list[str]:
    return [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]


def prose(rng: random.Random, lang: str, n: int) -> str:
    out = []
    for i in range(n):
        a, b = rng.choice(WORDS[lang]), rng.choice(WORDS[lang])
        out.append((a + b if rng.random() < 0.5 else a) + (".\n" if i % 17 == 16 else ""))
    return " ".join(out)


def messy_rows() -> list[tuple]:
    rng = random.Random(7)
    base = [prose(rng, "en" if i % 3 else "de", rng.randint(60, 160)) for i in range(24)]
    texts = list(base)
    passage = prose(rng, "en", 70)
    texts += [base[0], base[0], base[1].upper()]  # copies, and one in capitals
    near = base[2].split(" ")
    near[30] = "changed"
    texts += [" ".join(near), f"{base[3]}\n{passage}", f"{passage}\n{base[4]}", f"{base[5]} {passage} {base[6]}"]
    texts += [None, "", " \n\t ", "a", "12 34", "é" * 300, "ab" * 400, "x" * 199, "y" * 200]
    texts += [("same line again and again\n") * 40, " ".join(base) * 3]  # a long one
    rows = [(i, x, "en" if i % 3 else "de", "s", None, "n", "k", "p", "r") for i, x in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "q" * 250, None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return messy_rows()
