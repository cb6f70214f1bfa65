import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts() -> dict:
    """Documents with copies, near copies, shared passages, ties, empty and null texts, and one long text."""
    base = {k: words(k, 60) for k in range(8)}
    passage = words(99, 30)
    out = {k: " ".join(w) for k, w in base.items()}
    out[10] = out[0]  # a copy
    near = base[1].copy()
    near[30] = "changed"
    out[11] = " ".join(near)
    out[12] = " ".join(words(12, 20) + passage + words(13, 20))
    out[13] = " ".join(words(14, 10) + passage)
    out[14], out[15], out[16] = "", None, "  \t\n "
    out[17] = " ".join(words(17, 30_000))
    out[18] = "Short."
    out[19] = "Short."
    out[20] = "Ünïcode Straße ÄÖ é́ \U0001f600 123"
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    langs = ["en", "de", None]
    rows = [(k, t, langs[k % 3], "s", len(t) if t is not None else None) for k, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
