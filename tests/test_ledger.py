"""The commit log: replays, lost checkpoints, two writers, crashes, and the files that a merge touches."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.operators import conversations as M
from daftar.sources.ledger import Ledger
from daftar.streaming import jobs as J

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("v", T.StringType())])


class Crash(Exception):
    pass


def crash():
    raise Crash


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/t", rows_per_file=50)


def batch(spark, ids, seq, v):
    return spark.createDataFrame([(i, seq, v) for i in ids], SCHEMA), "id", "seq"


def now(ledger, **bounds):
    return {r.id: r.v for r in ledger.read("t", SCHEMA, **bounds).collect()}


def test_merges_replace_by_key_and_replays_change_nothing(spark, ledger):
    assert now(ledger) == {}
    assert ledger.upsert({"t": batch(spark, range(400), 0, "a")}, "s", 0) == 0
    assert ledger.upsert({"t": batch(spark, [3, 999, -5], 1, "b")}, "s", 1) == 1
    wanted = dict.fromkeys(range(400), "a") | dict.fromkeys([3, 999, -5], "b")
    assert now(ledger) == wanted
    for number in (0, 1):  # a batch that runs again
        assert ledger.upsert({"t": batch(spark, range(400), 9, "junk")}, "s", number) is None
    assert now(ledger) == wanted
    assert {r.id: r.v for r in ledger.read("t", SCHEMA, version=0).collect()} == dict.fromkeys(range(400), "a")
    double = spark.createDataFrame([(7, 1, "x"), (7, 3, "z"), (7, 2, "y")], SCHEMA)
    ledger.upsert({"t": (double, "id", "seq")})
    assert now(ledger) == wanted | {7: "z"}
    assert now(ledger, least=100, largest=110).keys() >= set(range(100, 111)) and len(now(ledger, least=100, largest=110)) < 200


def test_a_lost_checkpoint_leaves_all_of_the_new_run(spark, tmp_path, ledger):
    """20 rows as batch 0, two single-row batches, then batch 0 again with 20 new values and a fresh checkpoint."""
    for number, ids in enumerate([range(20), [3], [4]]):
        ledger.upsert({"t": batch(spark, ids, number, f"old{number}")}, "first", number)
    ledger.upsert({"t": batch(spark, range(20), 0, "new")}, "second", 0)
    assert now(ledger) == dict.fromkeys(range(20), "new")


def test_streams_with_kept_and_lost_checkpoints(spark, tmp_path):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    spark.range(30).selectExpr("id", "0L AS seq", "'a' AS v").repartition(3).write.parquet(source)

    def run(checkpoint, v):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        J.incremental_ingest(stream, lambda b: b.withColumn("v", F.lit(v)), store, f"{tmp_path}/{checkpoint}", "id", "seq", "t").awaitTermination()
        return now(Ledger(spark, store))

    assert run("one", "a") == dict.fromkeys(range(30), "a")
    assert run("one", "b") == dict.fromkeys(range(30), "a")  # nothing new came
    assert run("two", "c") == dict.fromkeys(range(30), "c")
    assert sorted(Ledger(spark, store).state().done.values()) == [2, 2]


def test_a_crash_before_and_after_the_log_entry(spark, ledger):
    ledger.upsert({"t": batch(spark, range(40), 0, "a")}, "s", 0)
    with pytest.raises(Crash):
        ledger.upsert({"t": batch(spark, range(20), 1, "b")}, "s", 1, before_commit=crash)
    assert now(ledger) == dict.fromkeys(range(40), "a")
    assert ledger.vacuum() == 0  # not yet old
    assert ledger.vacuum(0) == 3 and now(ledger) == dict.fromkeys(range(40), "a")  # two staged batches and the data of the one that died
    ledger.upsert({"t": batch(spark, range(20), 1, "b")}, "s", 1)
    assert ledger.upsert({"t": batch(spark, range(20), 1, "b")}, "s", 1) is None  # it died after the entry and runs again
    assert now(ledger) == dict.fromkeys(range(20), "b") | dict.fromkeys(range(20, 40), "a")


@pytest.mark.parametrize("mine, theirs, again", [(range(0, 5), range(180, 185), False), (range(0, 5), range(3, 9), True)])
def test_two_writers(spark, ledger, mine, theirs, again):
    """Another commit comes between this writer's data and its entry: on other files the same files are entered, else merged again."""
    ledger.upsert({"t": batch(spark, range(200), 0, "a")})
    merges, merged = [], ledger._merged
    ledger._merged = lambda *a: merges.append(1) or merged(*a)
    other = iter([Ledger(spark, ledger.path, 50)])

    def meanwhile():
        for rival in other:
            assert rival.upsert({"t": batch(spark, theirs, 1, "theirs")}) == 1

    assert ledger.upsert({"t": batch(spark, mine, 2, "mine")}, before_commit=meanwhile) == 2
    assert now(ledger) == dict.fromkeys(range(200), "a") | dict.fromkeys(theirs, "theirs") | dict.fromkeys(mine, "mine")
    assert len(merges) == 1 + again


def test_first_writers_of_an_empty_table(spark, ledger):
    other = iter([1])

    def meanwhile():
        for _ in other:
            Ledger(spark, ledger.path, 50).upsert({"t": batch(spark, range(50, 90), 1, "theirs")})

    ledger.upsert({"t": batch(spark, range(60), 2, "mine")}, before_commit=meanwhile)
    assert now(ledger) == dict.fromkeys(range(50, 90), "theirs") | dict.fromkeys(range(60), "mine")


def test_a_clustered_batch_rewrites_few_files(spark, ledger):
    ledger.upsert({"t": (spark.range(6000).selectExpr("id", "0L AS seq", "'a' AS v"), "id", "seq")})
    before = {f.path for f in ledger.state().tables["t"]}
    assert len(before) >= 100
    ledger.upsert({"t": batch(spark, range(3000, 3060), 1, "b")})  # 1 % of the keys, side by side
    after = {f.path for f in ledger.state().tables["t"]}
    assert len(before - after) < 0.05 * len(before)
    assert now(ledger) == dict.fromkeys(range(6000), "a") | dict.fromkeys(range(3000, 3060), "b")


def test_files_are_cut_by_bytes(spark, tmp_path):
    """few rows of long texts lie in many files, first and after a merge, so no task reads them all."""
    ledger = Ledger(spark, f"file://{tmp_path}/t", bytes_per_file=200_000)
    text = lambda sign: spark.range(400).selectExpr("id", "0L AS seq", f"repeat('{sign}', 10000) AS v")
    for sign in "ab":
        ledger.upsert({"t": (text(sign), "id", "seq")})
        files = ledger.state().tables["t"]
        assert len(files) >= 20 and max(f.bytes for f in files) <= 3 * 200_000
        assert sum(f.bytes for f in files) == 400 * (8 + 8 + 10000) and sum(f.rows for f in files) == 400
    assert now(ledger) == dict.fromkeys(range(400), "b" * 10000)
    state = ledger.state()
    before = state._replace(tables={"t": [f._replace(bytes=None) for f in state.tables["t"]]})  # as an entry of before bytes were kept says
    ledger.state = lambda version=None: before
    ledger.upsert({"t": (text("c"), "id", "seq")})
    del ledger.state
    files = ledger.state().tables["t"]
    assert len(files) >= 20 and sum(f.bytes for f in files) == 400 * (8 + 8 + 10000)


def test_string_keys_and_many_versions(spark, ledger):
    schema = T.StructType.fromDDL("k string, seq long")
    for n in range(20):
        ledger.upsert({"s": (spark.createDataFrame([(f"é{i % 40:02}", n) for i in range(n, n + 30)] + [("", n)], schema), "k", "seq")})
    state = ledger.state()
    assert state.version == 19 and any(name.endswith(".state.json") for name in ledger._names("log"))
    wanted = {}
    for n in range(20):
        wanted |= {f"é{i % 40:02}": n for i in range(n, n + 30)} | {"": n}
    assert {r.k: r.seq for r in ledger.read("s", schema).collect()} == wanted
    assert sum(f.rows for f in state.tables["s"]) == len(wanted)


def test_recreate_empties_a_table(spark, ledger):
    ledger.ensure("t")
    ledger.upsert({"t": batch(spark, range(5), 0, "a")})
    ledger.ensure("t")
    assert len(now(ledger)) == 5
    ledger.ensure("t", recreate=True)
    assert now(ledger) == {} and {r.id for r in ledger.read("t", SCHEMA, version=1).collect()} == set(range(5))


def test_turns_enter_messages_and_conversations_at_once(spark, ledger):
    turns = spark.createDataFrame([(1, 0, "q", "a", [], 5), (1, 1, "q2", "a2", ["c"], 9), (2, 0, "x", "y", ["c"], 3)], "conv_id long, turn int, question string, answer string, citations array<string>, created_at long")
    known = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "conv_id long, updated_at long")
    ledger.upsert({"conversations": (known, "conv_id", "updated_at")})

    def seen():
        times = {r.conv_id: r.updated_at for r in ledger.read("conversations", known.schema).collect()}
        messages = ledger.read("messages", T.StructType.fromDDL("conv_id long, pos int, role string, content string, citations array<string>")).collect()
        return times, sorted((r.conv_id, r.pos, r.role, r.content, r.citations) for r in messages)

    before = seen()
    with pytest.raises(Crash):
        M.commit_turns(ledger, turns, known, "chat", 0, before_commit=crash)
    assert seen() == before == ({1: 4, 2: 4, 3: 4}, [])
    for _ in range(2):
        M.commit_turns(ledger, turns, known, "chat", 0)
    times, messages = seen()
    assert times == {1: 9, 2: 4, 3: 4}
    assert messages == [(1, 0, "user", "q", None), (1, 1, "assistant", "a", None), (1, 2, "user", "q2", None), (1, 3, "assistant", "a2", ["c"]), (2, 0, "user", "x", None), (2, 1, "assistant", "y", ["c"])]
