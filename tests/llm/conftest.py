"""Documents that the tests of this folder share."""

import random

import pytest
from llm_prose import prose


@pytest.fixture(scope="session")
def texts():
    """Plain, repeated, near-copied, null, empty and odd texts, by id."""
    r = random.Random(5)
    out = {i: prose(r, r.randrange(60, 220)) for i in range(30)}
    out[30] = out[3]
    out[31] = out[3]
    words = out[4].split(" ")
    words[10] = "changed"
    out[32] = " ".join(words)
    out[33] = out[32].replace(" the ", " a ", 1)
    out[34] = out[5] + "\n" + out[6]
    out[35] = "Start here.\n" + out[7] + "\nEnd there."
    out[36] = None
    out[37] = ""
    out[38] = " \n\t "
    out[39] = "one two three"
    out[40] = "one two three"
    out[41] = "x " * 30000
    out[42] = "aé日本\x0b#*& 100%\r\nLine\nLine\n"
    out[43] = " ".join(prose(r, 40) for _ in range(1)) + " Released under the MIT License. CC BY-NC 4.0, cc by nc cc by nc"
    out[44] = "a b c " * 40
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with a column whose name clashes with results."""
    rows = [(i, t, None if i % 9 == 4 else "en", f"src{i % 3}" if i % 7 else None, len(t) if t else None, "mine") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(4)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
