"""The registered queries of the engine against their SQL, and small cases of the functions."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from loomery.functions.text import bigram_overlap, char_ngrams, tokens, word_ngrams
from loomery.operators.evaluate import rouge_n
from loomery.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, list | tuple):
        return f"[{','.join(map(plain, v))}]"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    columns = sorted(df.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in df.collect()) == want


def test_ngrams_of_short_and_missing_texts(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "a"), (3, ""), (4, None)], "id long, t string")
    rows = {r.id: r for r in df.select("id", char_ngrams(F.col("t"), 2).alias("c"), word_ngrams(tokens(F.col("t")), 1).alias("w")).collect()}
    assert rows[1].c == ["ab", "bc"] and rows[1].w == ["abc"]
    assert rows[2].c == [] and rows[2].w == ["a"]
    assert rows[3].c == [] and rows[3].w == []
    assert rows[4].c == [] and rows[4].w == []


def test_bigram_overlap(spark):
    df = spark.createDataFrame([("abcd", "abce"), ("a", "abc")], "a string, b string")
    assert [r.o for r in df.select(bigram_overlap(F.col("a"), F.col("b")).alias("o")).collect()] == [pytest.approx(2 / 3), 0.0]


def test_rouge_counts_each_gram_as_often_as_both_have_it(spark):
    df = spark.createDataFrame([(1, "a a b", "a b c"), (2, "", "a"), (3, None, None), (4, "x y", "x y")], "id long, c string, r string")
    got = {r.id: r.rouge for r in rouge_n(df, "id", "c", "r", 1).collect()}
    assert got == {1: pytest.approx(4 / 6), 2: 0.0, 3: 0.0, 4: 1.0}
