"""Documents with every odd case: nulls, empty and long texts, repeats, clashing columns."""

import random

import pytest

CLASHING = ["row", "key", "label", "n", "u", "v", "block", "epoch", "kept", "quality", "gone", "h1", "k1", "lines", "extra", "node", "sid", "tokens", "bucket", "quality_score", "sequence_id", "n_lines", "grade", "shard"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "ε", "zeta", "ETA", "theta.", "x#y", "1234", "iota", "kappa"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    base = make(120)
    near = base.split()
    near[60] = "changed"
    common = "  A line that Everyone has  "
    out = [None, "", " \n\t ", "one", "two words", "four words are here", base, base, " ".join(near), base.upper(), make(3000), make(200) + "\n" + base]
    out += [f"{common}\n{make(20)}\n{common.strip().lower()}" for _ in range(11)]
    out += [" ".join(["loop the words again"] * 60), "\n\n\n", "a b c d", "<|endoftext|> tail", "x" * 5000, ("na " * 2000).strip()]
    return out


@pytest.fixture(scope="session")
def odd_rows():
    texts = odd_texts()
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)))
    rows += [rows[6], rows[12], (None, texts[6], None, None, None), (None, None, None, None, None), (None, "no id here at all, none", "en", "s1", 22)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, *["other"] * len(CLASHING)) for r in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (6, 1, 0), (6, 0, 1), (None, 1, 1), (10, None, None), (14, 1, 0), (23, 0, 1)], "doc_id long, quality int, toxic int")
