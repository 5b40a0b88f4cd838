"""Streams with state, keyed stores, sessions: order, replays, races and restarts."""

import pytest
from loomery.operators import corpus, ranks
from loomery.sources.store import KeyedStore, commit, latest
from loomery.streaming import flows, session_store
from loomery.streaming import state as S
from pyspark.sql import functions as F


def fed(spark, folder, slices, schema, one_more=False):
    """A stream that gets a file for each slice, in this order."""
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1)
    have = len(list(folder.glob("*"))) if folder.exists() else 0
    for i, rows in enumerate(slices):
        frame(rows).write.parquet(f"{folder}/{have + i}")
    return spark.readStream.schema(frame([]).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_tokens_come_out_in_order_once_and_silent_requests_are_closed(spark, tmp_path):
    schema = "request string, seq long, type string, content string, s long"
    t = lambda r, q, c, s, kind="token": (r, q, kind, c, s)
    slices = [
        [t("a", 1, "a1", 2), t("a", 0, "a0", 1), t("b", 2, "b2", 3), t("c", 0, "c0", 1)],
        [t("a", 3, "src", 4, "sources"), t("a", 5, None, 6, "done"), t("b", 0, "b0", 5), t("b", 0, "again", 5)],
        [t("a", 2, "a2", 7), t("a", 4, "a4", 7), t("b", 4, "x", 8, "sources")],
        [t("a", 6, "late", 9), t("a", 5, None, 9, "done"), t("d", 0, "d0", 500)],
        [t("d", 1, None, 900, "done")],
    ]
    stream = S.ordered_tokens(fed(spark, tmp_path / "in", slices[:3], schema), silence=60, late="10 seconds")
    first = flows.run_once(stream, str(tmp_path / "run"), run="r", stateful=True)
    assert {(r.request, r.place, r.type) for r in first.where("request = 'a'").collect()} == {("a", 0, "token"), ("a", 1, "token"), ("a", 2, "token"), ("a", 3, "token"), ("a", 4, "sources"), ("a", 5, "done")}
    # the second run takes the state up from the checkpoint
    stream = S.ordered_tokens(fed(spark, tmp_path / "in", slices[3:], schema), silence=60, late="10 seconds")
    rows = flows.run_once(stream, str(tmp_path / "run"), run="r", stateful=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.request, r.place)):
        got.setdefault(r.request, []).append((r.type, r.content))
    assert got["a"] == [("token", "a0"), ("token", "a1"), ("token", "a2"), ("token", "a4"), ("sources", "src"), ("done", None)]
    assert got["b"] == [("token", "b0"), ("token", "b2"), ("sources", "x"), ("done", "timeout")]
    assert got["c"] == [("token", "c0"), ("done", "timeout")]
    assert got["d"] == [("token", "d0"), ("done", None)]


def test_caches_hit_within_the_time_and_while_there_is_room(spark, tmp_path):
    schema = "shard long, seq long, query string, s long"
    asked = [(1, "x", 0), (1, " X ", 299), (1, "x", 300), (1, "y", 301), (1, "z", 302), (1, "x", 303), (1, "y", 304), (2, "x", 305), (2, "x", 310), (1, "w", 900)]
    rows = [(shard, i, q, 1000 + s) for i, (shard, q, s) in enumerate(asked)]
    # within a file and between neighbouring ones the order is no matter
    slices = [rows[2::-1], [rows[4], rows[3], rows[6]], [rows[5], rows[8], rows[7]], [rows[9], (3, 10, "end", 3000)]]
    out = lambda ttl, most, name: sorted((r.seq, r.hit) for r in flows.run_once(S.cache_lookups(spark.readStream.schema(fed(spark, tmp_path / name, slices, schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*"), ttl, most, "20 seconds"), str(tmp_path / "run"), stateful=True).collect())
    # x is entered at 0 and 300; z makes x go, the next x makes y go
    assert out(300, 2, "two") == [(0, False), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, False), (8, True), (9, False)]
    assert out(None, 50, "all") == [(0, False), (1, True), (2, True), (3, False), (4, False), (5, True), (6, True), (7, False), (8, True), (9, False)]


def test_upserts_replace_rows_and_leave_other_buckets_alone(spark, tmp_path):
    schema = "id long, v string, n int"
    store = KeyedStore(spark, f"{tmp_path}/s", "id", schema, 8)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert store.read().count() == 0
    store.upsert(rows(*[(i, "a", 0) for i in range(100)], (None, "a", 0)), F.col("n"))
    before = store.files()
    store.upsert(rows((7, "old", 1), (7, "new", 2), (200, "b", 1)), F.col("n"))
    after = store.files()
    changed = {b for b in after if before.get(b) != after[b]}
    assert 1 <= len(changed) <= 2
    got = {r.id: r.v for r in store.read().collect()}
    assert len(got) == 101 and got[7] == "new" and got[200] == "b" and got[8] == "a"
    store.remove(rows(*[(i, "", 0) for i in range(50)]))
    assert {r.id for r in store.read().collect()} == {*range(50, 100), 200}
    # a writer that has seen an older generation does not win
    with pytest.raises(FileExistsError):
        commit(spark, f"{tmp_path}/s", latest(spark, f"{tmp_path}/s")[0], {})
    assert store.upsert(rows((1, "t", 0)), F.col("n"), token=5) and not store.upsert(rows((1, "u", 0)), F.col("n"), token=5)
    assert store.read().where("id = 1").first().v == "t"
    store.remove(store.read())
    assert store.read().count() == 0 and store.files() == {}


def test_sessions_are_merged_once_expire_and_shrink(spark, tmp_path):
    schema = "session_id string, seq long, role string, content string, ts timestamp, sources array<string>"
    at = lambda s: spark.sql(f"select timestamp_seconds({s})").first()[0]
    msg = lambda sid, q, s, src=None: (sid, q, "user" if q % 2 == 0 else "assistant", f"{sid}{q}", at(s), src)
    batches = [[msg("a", 0, 0), msg("a", 1, 1, ["d1"]), msg("b", 0, 5)], [msg("a", q, 10 + q) for q in range(2, 9)], [msg("c", 0, 5000)]]
    store = session_store.open_store(spark, f"{tmp_path}/s", 4)
    frames = [spark.createDataFrame(b, schema) for b in batches]
    for i, f in enumerate(frames):
        assert session_store.add_messages(store, f, i, max_turns=3)
        assert not session_store.add_messages(store, f, i, max_turns=3)
    got = {r.session_id: r for r in store.read().collect()}
    assert [m.seq for m in got["a"].messages] == [3, 4, 5, 6, 7, 8] and got["a"].last_sources == ["d1"] and got["a"].last_access == at(18)
    text = store.read().where("session_id = 'b'").select(session_store.history(F.col("messages")).alias("h")).first().h
    assert text == "[이전 대화]\n사용자: b0\n"
    session_store.compress(store, spark.createDataFrame([("a", "so far"), ("b", "x"), ("none", "y")], "session_id string, summary string"), 2)
    got = {r.session_id: [m.content for m in r.messages] for r in store.read().collect()}
    assert got == {"a": ["[이전 대화 요약] so far", "a7", "a8"], "b": ["b0"], "c": ["c0"]}
    session_store.expire(store, F.timestamp_seconds(F.lit(3606)), 3600)
    assert sorted(r.session_id for r in store.read().collect()) == ["a", "c"]
    session_store.evict(store, 1)
    assert [r.session_id for r in store.read().collect()] == ["c"]


def test_places_are_whole_on_wide_tables(spark):
    rows = spark.range(0, 50_000, 1, 7).select((F.col("id") * 7919 % 50_000).alias("k"), F.lit("x").alias("a"), F.col("id").alias("b"))
    got = ranks.numbered(rows, F.col("k"))
    assert got.columns == ["k", "a", "b", "place"]
    assert got.agg(F.count("*"), F.sum((F.col("k") == F.col("place")).cast("int"))).first() == (50_000, 50_000)
    assert [r.k for r in corpus.every_nth(rows, 16, "k").orderBy("k").collect()] == [i * 3125 for i in range(16)]


def test_a_file_that_changes_while_it_is_processed_is_seen_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    seen = []

    def slow(df):
        (tmp_path / "in" / "a.txt").write_text("two")
        seen.append(sorted((r.name, bytes(r.content)) for r in df.collect()))

    args = (spark, f"{tmp_path}/in", f"{tmp_path}/state")
    flows.process_changes(*args, slow)
    flows.process_changes(*args, lambda df: seen.append(sorted((r.name, bytes(r.content)) for r in df.collect())))
    flows.process_changes(*args, lambda df: seen.append(df.count()))
    assert seen == [[("a.txt", b"one")], [("a.txt", b"two")], 0]


def test_a_replayed_batch_does_not_double_rows(spark, tmp_path):
    schema = "shard long, s long"
    for rows in ([(1, 0)], [(2, 1)]):
        stream = fed(spark, tmp_path / "in", [rows], schema)
        got = flows.run_once(stream, str(tmp_path / "run"), run="x")
    assert got.count() == 2
    # the last batch's commit is lost: it is run again
    (tmp_path / "run" / "state-x" / "commits" / "1").unlink()
    for crc in (tmp_path / "run" / "state-x" / "commits").glob(".1*"):
        crc.unlink()
    assert flows.run_once(fed(spark, tmp_path / "in", [[(3, 2)]], schema), str(tmp_path / "run"), run="x").count() == 3


def test_slices_of_many_files_lose_no_late_rows(spark, data):
    """a batch of some files of a slice moved the watermark past the rows of the others."""
    import duckdb
    from loomery.plans import catalog

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = sorted((r.request, r.place, r.type, r.content) for r in catalog.queries()["token_stream"](spark, data).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(con.execute(catalog.oracle_sql()["token_stream"]).fetchall(), key=key)


def test_requests_share_state_and_timers(spark, tmp_path):
    """a request had state and timers of its own, whose calls took milliseconds each."""
    from pyspark.sql.streaming import StreamingQueryListener

    class States(StreamingQueryListener):
        rows: list[int] = []

        def onQueryStarted(self, event):  # noqa: N802
            pass

        def onQueryProgress(self, event):  # noqa: N802
            self.rows.extend(o.numRowsTotal for o in event.progress.stateOperators)

        def onQueryTerminated(self, event):  # noqa: N802
            pass

    schema = "request string, seq long, type string, content string, s long"
    early = [(f"r{i}", 1, "done", None, 5) for i in range(3000)] + [("silent", 0, "token", "x", 5), ("silent", 2, "token", "z", 3), (None, 0, "token", "n", 5)]
    late = [(f"r{i}", 0, "token", f"c{i}", 4) for i in range(3000)] + [(None, 1, "done", None, 6)]
    # the watermark ends where the time of the silent one does
    fed(spark, tmp_path / "in", [early, late, [("last", 0, "token", "y", 75)]], schema)
    stream = fed(spark, tmp_path / "in", [], schema)
    spark.streams.addListener(seen := States())
    got = [tuple(r) for r in flows.run_once(S.ordered_tokens(stream, silence=60, late="10 seconds"), str(tmp_path / "run"), stateful=True).collect()]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(seen)
    want = [(f"r{i}", p, k, c) for i in range(3000) for p, k, c in ((0, "token", f"c{i}"), (1, "done", None))]
    want += [("silent", 0, "token", "x"), ("silent", 1, "token", "z"), ("silent", 2, "done", "timeout"), (None, 0, "token", "n"), (None, 1, "done", None), ("last", 0, "token", "y")]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 0 < max(seen.rows) <= 256


def test_slices_that_come_one_after_the_other_give_the_rows_of_the_sql(spark, data, monkeypatch):
    import duckdb
    from loomery.plans import catalog, streams

    monkeypatch.setattr(streams, "SLICE_ROWS", 300)
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    key = lambda r: tuple(map(str, r))
    for name in ("token_stream", "intent_cache"):
        want = con.execute(catalog.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, catalog.queries()[name](spark, data).select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_an_empty_table_gives_an_empty_stream(spark, data, tmp_path):
    from loomery.plans import catalog

    spark.read.parquet(f"{data}/events.parquet").where("false").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["token_stream"](spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["request", "place", "type", "content"]
