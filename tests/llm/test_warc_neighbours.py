import gzip
import hashlib
import os

import numpy as np
import pytest
from loomery.llm import neighbours, shared, warc
from pyspark.sql import functions as F


def test_archive_round_trip(spark):
    big, other = "é" * 700, "b" * 1000
    rows = [(1, "http://a/ b\n", big), (5, None, big), (3, "u", big), (4, "v", "small"), (9, "w", "small"), (7, "x", None), (8, "y", ""), (None, "z", big), (11, "q", other), (11, "q", other), (12, "long", "<p>\r\n\r\nWARC/1.1\r\n\r\n" * 20_000)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, path string, size int")
    index = warc.archive_pages(pages)
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.read_records(index).collect()]
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == big and page != 5
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 5 if again else None, None if again else data))
    assert sorted(found, key=str) == sorted(((*w[:5], None if w[5] is None else bytearray(w[5])) for w in want), key=str)


def test_every_record_is_a_member_and_has_a_sidecar_line(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i}" * i) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    index = warc.archive_pages(pages).orderBy("offset").collect()
    path = index[0].path.removeprefix("file:")
    path = path if os.path.exists(path) else path.removeprefix("//")
    with open(path, "rb") as f:
        for r in index:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
    with open(path + ".idx") as f:
        assert [tuple(x.split("\t")[:2]) for x in f] == [(str(r.offset), str(r.length)) for r in index]
    assert not [x for x in os.listdir(os.path.dirname(path)) if x.startswith(".part") and not x.endswith(".crc")]


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.archive_pages(pages)).count() == 0


def brute(ids, v, i, k):
    s = v @ v[i]
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
    return [(int(ids[j]), float(s[j])) for j in order]


def test_neighbours_reach_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    found = neighbours.nearest(rows, rows.where("vec_id % 20 = 0"), 20, block_rows=700, batch_queries=40).toPandas()
    data = rows.toPandas()
    ids, v = data["vec_id"].to_numpy(), np.vstack(data["embedding"]).astype(np.float64)
    hit = 0
    for q, group in found.groupby("query_id"):
        group = group.sort_values("rank")
        assert list(group["rank"]) == list(range(1, 21)) and q not in set(group["vec_id"])
        assert (np.diff(group["score"]) <= 0).all()
        at = np.searchsorted(np.sort(ids), group["vec_id"])
        assert np.allclose(v[np.argsort(ids)[at]] @ v[ids == q][0], group["score"], atol=1e-12)
        hit += len({i for i, _ in brute(ids, v, int(np.flatnonzero(ids == q)[0]), 20)} & set(group["vec_id"]))
    assert found["query_id"].nunique() == (ids % 20 == 0).sum()
    assert hit / len(found) >= 0.9


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-3.0, 1.0]), (None, [1.0, 2.0]), (20, [9.0, 9.0]), (40, []), (60, [1.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    found = neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(20, 27.0), (6, 5.0), (7, 5.0)], 20: [(0, 27.0), (6, 27.0), (7, 27.0)]}
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_large_group_of_equal_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(300)] + [(300 + i, [0.1 * i, 1.0, -0.5]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(vectors, vectors.where(F.col("vec_id") == 100), 5, block_rows=64).orderBy("rank").collect()
    data = {i: np.array(np.float32(v), dtype=np.float64) for i, v in rows}
    want = sorted(((-float(data[100] @ v), i) for i, v in data.items() if i != 100))[:5]
    assert [r.vec_id for r in found] == [i for _, i in want]


@pytest.mark.parametrize("dim", [3, 65])
def test_projections_are_unit_vectors(dim):
    p = neighbours.projections(dim, 64, 1)
    assert p.shape == (64, dim) and np.allclose((p * p).sum(axis=1), 1)


def test_a_second_attempt_in_another_order_leaves_whole_archives(spark, tmp_path, monkeypatch):
    rows = warc.with_revisits(spark.createDataFrame([(i, f"u{i}", f"{i} " * 300) for i in range(60)], "page_id long, url string, html string"))
    folder = str(tmp_path / "archives")
    lost = warc.write_archives(rows.coalesce(1).sortWithinPartitions("page_id"), folder)
    assert lost.agg({"records": "sum"}).first()[0] == 60
    kept = shared.materialize(warc.write_archives(rows.coalesce(1).sortWithinPartitions(F.desc("page_id")), folder), "second-attempt")
    assert len(list((tmp_path / "archives").glob("*.warc.gz"))) == 2 * kept.count()
    index = shared.materialize(warc.normalise(kept, str(tmp_path / "members")), "second-index")
    assert sorted(r.page_id for r in warc.read_records(index).collect()) == list(range(60))
