"""Commit log, backups, replicas and state of streams, on small tables with what can go wrong."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    from lodestone.sources.commits import CommitTable

    return CommitTable(spark, f"file://{tmp_path}/t", "id long, x string")


def some(spark, a, b, x):
    return spark.range(a, b).select("id", F.lit(x).alias("x"))


def test_a_batch_is_seen_whole_or_not_at_all(spark, table):
    from lodestone.sources.commits import Rejected

    assert table.version() == 0 and table.read().count() == 0
    assert table.insert_batch(some(spark, 0, 5, "a")) == 1
    bad = {
        "known ids": some(spark, 4, 9, "b"),
        "ids twice": some(spark, 7, 9, "b").unionByName(some(spark, 8, 9, "c")),
        "faulty rows": spark.createDataFrame([(None, "q"), (9, "r")], "id long, x string"),
    }
    for why, batch in bad.items():
        with pytest.raises(Rejected) as e:
            table.insert_batch(batch)
        assert list(e.value.problems) == [why]
    with pytest.raises(Rejected):
        table.insert_batch(some(spark, 20, 25, "short"), F.when(F.col("id") == 23, "odd"))
    broken = some(spark, 30, 40, "a").withColumn("x", F.when(F.col("id") == 35, F.raise_error(F.lit("boom"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="boom"):
        table.insert_batch(broken)
    assert table.version() == 1 and table.files.names(f"{table.base}/data") == [table.entry().folders[0].split("/")[1]]
    assert rows_of(table.read()) == [(k, "a") for k in range(5)]


def test_versions_stay_readable_and_changes_touch_few_folders(spark, table):
    for k in range(3):
        table.insert_batch(some(spark, 10 * k, 10 * k + 5, f"b{k}"))
    before = table.entry()
    assert table.change_batch(spark.createDataFrame([(11, "new"), (99, "more")], "id long, x string"), some(spark, 12, 13, "")) == 4
    after = table.entry()
    assert set(before.folders) - set(after.folders) == {before.folders[1]} and len(after.added) == 1
    want = {(k, "b0") for k in range(5)} | {(10, "b1"), (11, "new"), (13, "b1"), (14, "b1"), (99, "more")} | {(k, "b2") for k in range(20, 25)}
    assert set(rows_of(table.read())) == want and table.read(3).count() == 15 and table.read(1).count() == 5
    assert table.compact() == 5 and set(rows_of(table.read())) == want
    assert len(table.clean()) == 4 and set(rows_of(table.read())) == want


def test_writers_who_meet(spark, table):
    from lodestone.sources.commits import Conflict, Rejected

    start = table.entry()
    assert table.insert_batch(some(spark, 0, 5, "a"), before=start) == 1
    assert table.insert_batch(some(spark, 5, 9, "b"), before=start) == 2  # other ids: it goes behind
    with pytest.raises(Rejected):
        table.insert_batch(some(spark, 8, 12, "c"), before=start)
    seen = table.entry()
    table.change_batch(some(spark, 0, 1, "z"))
    with pytest.raises(Conflict):  # the same folder
        table.change_batch(some(spark, 1, 2, "z"), before=seen)
    with pytest.raises(Conflict):  # an id that has come meanwhile
        table.change_batch(some(spark, 0, 1, "y"), before=start)
    n = len(table.files.names(f"{table.base}/data"))
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda k: table.insert_batch(some(spark, 100 + 10 * k, 104 + 10 * k, "t")), range(4)))
    assert sorted(done) == [4, 5, 6, 7] and table.read().count() == 9 + 16 and len(table.files.names(f"{table.base}/data")) == n + 4


def test_checksum_sees_repeated_rows_and_places_of_nulls(spark):
    from lodestone.operators.catalog import checksum, replicas_agree

    make = lambda *x: spark.createDataFrame([(v,) for v in x], "v long")
    assert checksum(make(1, 1)).first() != checksum(make(2, 2)).first()
    assert checksum(make(1, 2, 2)).first() == checksum(make(2, 1, 2)).first()
    pair = lambda *x: spark.createDataFrame([x], "a string, b string")
    assert checksum(pair(None, "x")).first() != checksum(pair("x", None)).first()
    assert [r["agrees"] for r in replicas_agree([make(1, 1), make(2, 2)]).orderBy("replica").collect()] == [True, False]


def test_backups_write_what_changed_and_restore_any_point(spark, tmp_path):
    from lodestone.sources.backups import BackupChain

    schema = "id long, x string"
    chain = BackupChain(spark, f"file://{tmp_path}/b", schema, "id", buckets=64, fan=4)
    one = spark.createDataFrame([(k, f"v{k}") for k in range(600)] + [(7, "again"), (7, "again"), (None, "none")], schema)
    two = one.withColumn("x", F.when(F.col("id").isin(3, 4), "new").otherwise(F.col("x"))).where("id <> 9 or id is null")
    three = two.unionByName(spark.createDataFrame([(7, "again"), (1000, "added")], schema))
    made = [chain.backup(one), chain.backup(two), chain.backup(three), chain.backup(three), chain.backup(three, "differential"), chain.backup(one, "differential")]
    assert [m["kind"] for m in made] == ["full", "incremental", "incremental", "incremental", "differential", "differential"]
    assert made[0]["buckets"] == 64 and 1 <= made[1]["buckets"] <= 3 and 1 <= made[2]["buckets"] <= 2 and made[3]["buckets"] == 0 and made[5]["buckets"] == 0
    assert made[2]["buckets"] <= made[4]["buckets"] <= 5 and made[1]["bytes"] < made[0]["bytes"] / 4
    for m, want in zip(made, (one, two, three, three, three, one), strict=True):
        assert rows_of(chain.restore(m["number"])) == rows_of(want)
    gone = chain.forget(2)
    assert 2 in gone and 1 not in gone and rows_of(chain.restore(5)) == rows_of(three)
    all_gone = chain.backup(one.where("id < 0"), "incremental")
    assert chain.restore(all_gone["number"]).count() == 0
    with pytest.raises(ValueError, match="unknown kind"):
        chain.backup(one, "other")


def test_a_damaged_or_unfinished_backup_is_noticed(spark, tmp_path):
    from lodestone.sources.backups import BackupChain

    chain = BackupChain(spark, f"file://{tmp_path}/b", "id long, x string", "id", buckets=8)
    df = spark.createDataFrame([(k, "a") for k in range(50)], "id long, x string")
    chain.backup(df)
    df.limit(5).withColumn("__bucket", F.lit(0).cast("long")).write.mode("append").parquet(f"{tmp_path}/b/000001-full/rows")
    with pytest.raises(ValueError, match="digests"):
        chain.restore(1)
    chain.files.delete(f"{chain.base}/000001-full/catalogue")
    assert chain.names() == [] and chain.backup(df)["kind"] == "full" and chain.restore().count() == 50


def test_sinks_get_each_batch_once(spark, tmp_path):
    from lodestone.operators.catalog import replicas_agree
    from lodestone.streaming.replicas import Sink, catch_up, first_healthy, replicate
    from lodestone.streaming.windows import read_stream

    schema = "id long, x string"
    for k in range(4):
        some(spark, 10 * k, 10 * k + 10, "r").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    calls = []

    def shaky(rows, folder, number):
        calls.append(number)
        rows.limit(3).write.mode("overwrite").parquet(folder)  # fails when part of it is there
        if number in (1, 2) and calls.count(number) == 1:
            raise OSError("lost")
        rows.write.mode("overwrite").parquet(folder)

    a, b = Sink(spark, f"file://{tmp_path}/a", schema), Sink(spark, f"file://{tmp_path}/b", schema, shaky)
    failures = []
    replicate(read_stream(spark, f"{tmp_path}/in", a.read().schema, files=1), [a, b], f"{tmp_path}/state", failures).awaitTermination()
    assert [f[:2] for f in failures] == [(1, 1), (2, 1)] and b.batches() == [0, 3] and b.read().count() == 20
    assert not a.put(some(spark, 0, 99, "other"), 0) and a.read().count() == 40
    assert first_healthy([b, a]) is a and catch_up(a, b) == [1, 2] and catch_up(a, b) == []
    assert all(r["agrees"] for r in replicas_agree([a.read(), b.read()]).collect())


def test_a_batch_that_no_sink_takes_is_run_again(spark, tmp_path):
    from lodestone.streaming.replicas import Sink, replicate
    from lodestone.streaming.windows import read_stream

    some(spark, 0, 10, "r").coalesce(1).write.parquet(f"{tmp_path}/in")
    down = [True]

    def write(rows, folder, number):
        if down:
            raise OSError("down")
        rows.write.mode("overwrite").parquet(folder)

    s = Sink(spark, f"file://{tmp_path}/a", "id long, x string", write)
    run = lambda: replicate(read_stream(spark, f"{tmp_path}/in", s.read().schema), [s], f"{tmp_path}/state").awaitTermination()
    with pytest.raises(Exception, match="no sink took batch 0"):
        run()
    down.clear()
    run()
    assert s.read().count() == 10


def test_sessions_as_state_equal_those_of_the_closed_table(spark, tmp_path):
    from lodestone.streaming.sessions import STORE, open_sessions
    from lodestone.streaming.windows import read_stream

    rnd, t0 = random.Random(6), datetime(2024, 1, 1)
    events = [(u, t0 + timedelta(minutes=rnd.randint(0, 3000)), rnd.choice("ab")) for u in (1, 2, 3) for _ in range(40)]
    rnd.shuffle(events)
    schema = "user long, at timestamp, kind string"
    for part in (events[:50], events[50:], [(None, t0, "x"), (1, None, "x")], [(9, t0 + timedelta(days=30), "end")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        found = open_sessions(read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files=1), "user", "at", "kind", 3_600_000, "4 days")
        found.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
    want = []
    for u in (1, 2, 3):
        mine = sorted((t, k) for v, t, k in events if v == u)
        groups = [[mine[0]]]
        for e in mine[1:]:
            groups[-1].append(e) if e[0] - groups[-1][-1][0] < timedelta(hours=1) else groups.append([e])
        for g in groups:
            kinds = [k for i, (_, k) in enumerate(g) if i == 0 or g[i - 1][1] != k]
            want.append((u, g[0][0], g[-1][0], len(g), ">".join(kinds)))
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == sorted(want, key=repr)  # the session of user 9 is still open
