import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import job_json as JJ
from pagemill.operators import jobs as J
from pagemill.operators import policy as P
from pagemill.schema import JOB
from pagemill.sources import job_store as S

T0 = dt.datetime(2024, 1, 1)


def job(i, state="submitted", priority=0, due=None, tags=(), created=T0, **more):
    base = dict(id=f"j{i}", state=state, source_path=f"/in/{i}.tif", profile_name=None, attachments=[], tags=list(tags), created_at=created, updated_at=None, correlation_id=None, error_message=None, priority=priority, attempt_count=0, last_attempt_at=None, due_at=due)
    return {**base, **more}


def frame(spark, *jobs):
    return spark.createDataFrame([tuple(j[c.split()[0]] for c in JOB.split(", ")) for j in jobs], JOB)


NOW = lambda: F.lit(T0).cast("timestamp_ntz")


def test_policy_text():
    p = P.parse("within-minutes=120 priority=50\nwithin-minutes=60,priority=80\nminutes=15 priority=95 ; urgent\nOVERDUE=110\nescalate-overdue=false\n# note")
    assert p.windows == [(7200, 50), (3600, 80), (900, 95)] and p.overdue == 110 and not p.escalate_overdue
    for bad in ("within=5", "priority=1", "within priority=3", "hello", "within=-1 priority=3", "overdue", "escalate-overdue=maybe", "within=5 priority=99999999999"):
        with pytest.raises(P.PolicyError, match="line 1"):
            P.parse(bad)


def test_policy_layers(tmp_path):
    (tmp_path / "00-base.policy").write_text("within-minutes=120 priority=40\noverdue=90\n")
    (tmp_path / "05-disable.cfg").write_text("no-overdue-escalation\n")
    (tmp_path / "10-urgent.policy").write_text("within-minutes=30 priority=80\nescalate-overdue=true\n")
    (tmp_path / "readme.md").write_text("within-minutes=1 priority=100\n")
    (tmp_path / ".hidden.policy").write_text("overdue=1")
    p = P.load([str(tmp_path)])
    assert p.windows == [(7200, 40), (1800, 80)] and p.overdue == 90 and p.escalate_overdue
    (tmp_path / "last.txt").write_text("overdue=120")
    stacked = P.load([str(tmp_path), str(tmp_path / "last.txt")])
    assert stacked.overdue == 120 and stacked.windows[:2] == p.windows and stacked.escalate_overdue


def test_windows_of_a_table(spark):
    rng = random.Random(5)
    windows = [(rng.randint(1, 5000), rng.randint(0, 99)) for _ in range(1500)]  # some are equal
    jobs = frame(spark, *[job(i, due=T0 + dt.timedelta(seconds=rng.randint(-50, 5200))) for i in range(300)])
    got = {r.id: r.target for r in P.escalate_by_table(jobs, spark.createDataFrame(windows, "within_seconds bigint, priority int"), NOW(), 7).collect()}
    policy = P.Policy(windows, 7)
    want = {r.id: r.t for r in jobs.select("id", P.target_priority(policy, P.remaining_seconds(F.col("due_at"), NOW())).alias("t")).collect() if r.t is not None}
    assert got == want


def test_escalation(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    jobs = frame(spark, job(0, priority=5, due=at(90)), job(1, due=at(20)), job(2, due=at(3)), job(3, due=at(-1)), job(4, priority=80, due=at(2)), job(5, state="completed", due=at(-9)), job(6))
    out = {r.id: r.priority for r in P.escalate(jobs, P.Policy([(1800, 25), (300, 75)], 100), NOW()).collect()}
    assert out == {"j0": 5, "j1": 25, "j2": 75, "j3": 100, "j4": 80, "j5": 0, "j6": 0}


def test_part_seconds_are_cut_towards_zero(spark):
    due = [T0 + dt.timedelta(milliseconds=m) for m in (900, -900, 1900, -1900)]
    jobs = frame(spark, *[job(i, due=d) for i, d in enumerate(due)])
    got = [r.s for r in jobs.orderBy("id").select(P.remaining_seconds(F.col("due_at"), NOW()).alias("s")).collect()]
    assert got == [0, 0, 1, -1]


def test_queue_order_and_claims(spark):
    late, early = T0 + dt.timedelta(days=2), T0 + dt.timedelta(days=1)
    jobs = frame(spark, job(0), job(1, priority=5), job(2, priority=3), job(3, priority=3, due=late), job(4, priority=3, due=early), job(5, state="cancelled", priority=99))
    assert [r.id for r in J.claim(jobs, 9, NOW()).orderBy(*J.queue_order()).collect()] == ["j1", "j4", "j3", "j2", "j0"]
    assert {r.id: r.r for r in J.ranked(jobs, "r").collect()} == {"j5": 1, "j1": 2, "j4": 3, "j3": 4, "j2": 5, "j0": 6}
    assert J.ranked(jobs.limit(0), "r").count() == 0


def test_tags(spark):
    jobs = frame(spark, job(0, tags=["alpha", "beta"], correlation_id="b1"), job(1, tags=["alpha"], state="completed", correlation_id="b1"), job(2, tags=["gamma"]))
    ids = lambda *a: sorted(r.id for r in J.with_tags(jobs, *a).collect())
    assert ids(["alpha"]) == ids(["alpha", "alpha"]) == ["j0", "j1"] and ids(["alpha", "beta"]) == ["j0"] and ids(["delta"]) == []
    assert ids(["alpha"], "completed") == ["j1"] and ids(["beta"], None, "b1") == ["j0"] and len(ids([])) == 3
    out = {r.id: r for r in J.add_item(jobs, "tags", F.lit(True), "alpha", NOW()).collect()}
    assert out["j2"].tags == ["gamma", "alpha"] and out["j0"].updated_at is None and out["j2"].updated_at == T0


def test_summary_of_nothing_and_purge(spark):
    empty = J.summarize(frame(spark)).first()
    assert empty.total == empty.outstanding == 0 and empty.next_due is None
    a, b = T0, T0 + dt.timedelta(microseconds=2)
    jobs = frame(spark, job(0, "completed", updated_at=a), job(1, "completed", updated_at=b))
    assert [r.id for r in J.purge(jobs, "completed", F.lit(a + dt.timedelta(microseconds=1)).cast("timestamp_ntz")).collect()] == ["j1"]


def test_json_round_trip_and_rejects(spark):
    odd = job('q"1', priority=-5, attempt_count=3, correlation_id="back\\slash", profile_name="two\nlines", tags=["é"], due_at=dt.datetime(2024, 5, 6, 7, 8, 9, 123456))
    jobs = frame(spark, odd, job(2))
    assert sorted(JJ.from_json(JJ.with_json(jobs)).filter("valid").drop("valid").collect()) == sorted(jobs.collect())
    array = spark.createDataFrame([(JJ.array_text(jobs.orderBy("id")),)], "value string")
    assert JJ.from_json_array(array).count() == 2
    bad = ['{"id":"a","payload":{"source_path":""}}', '{"id":"a"}', '{"id":"a","payload":{"source_path":"x"},"state":"gone"}', '{"id":"a","payload":{"source_path":"x"},"due_at":"yesterday"}', "no json"]
    rows = JJ.from_json(spark.createDataFrame([(b,) for b in bad], "json string")).collect()
    assert not any(r.valid for r in rows)
    with pytest.raises(Exception, match="invalid"):
        JJ.from_json_array(spark.createDataFrame([("[" + bad[0] + "]",)], "value string")).collect()


def test_snapshot_store(spark, tmp_path):
    s = S.SnapshotStore(spark, str(tmp_path / "store"))
    assert s.jobs().count() == 0
    s.upsert(frame(spark, job(0), job(1, priority=3)), NOW())
    assert {r.updated_at for r in s.jobs().collect()} == {T0}
    claimed = s.claim(1, NOW()).collect()
    assert [r.id for r in claimed] == ["j1"] and claimed[0].attempt_count == 1 and [r.id for r in s.claim(5, NOW()).collect()] == ["j0"] and s.claim(1, NOW()).count() == 0
    with pytest.raises(S.Conflict):
        s.commit(s.jobs(), 0)
    s.remove(s.jobs().filter("id = 'j0'"))
    assert [r.id for r in s.jobs().collect()] == ["j1"]


def test_text_files_and_old_layouts(spark, tmp_path):
    for j in (job("a b", tags=['say "x"', "two"], due_at=T0 + dt.timedelta(microseconds=5)), job(2, attachments=["/p/q.tif"])):
        (tmp_path / S.safe_name(j["id"])).write_text(S.job_text(j))
    (tmp_path / "broken.job").write_text("id=\n")
    (tmp_path / "other.txt").write_text("id=\"x\"")
    got = {r.id: r for r in S.read_text(spark, str(tmp_path)).collect()}
    assert set(got) == {"ja b", "j2"} and got["ja b"].tags == ['say "x"', "two"] and got["ja b"].due_at.microsecond == 5 and got["j2"].attachments == ["/p/q.tif"]
    old = spark.createDataFrame([("x", "submitted", "/a", T0)], "id string, state string, source_path string, created_at timestamp_ntz")
    new = S.migrated(old)
    assert new.first().tags == [] and new.first().priority == 0 and S.migrated(new).collect() == new.collect()


def test_streamed_states(spark, tmp_path):
    from pagemill.streaming import events as E

    (tmp_path / "in").mkdir()
    rows = [("2024-01-01T00:00:01Z", "a", "submitted"), ("2024-01-01T00:00:03Z", "a", "completed"), ("2024-01-01T00:00:02Z", "a", "rendering"), ("2024-01-01T00:00:05Z", "b", "submitted")]
    (tmp_path / "in" / "1.json").write_text("\n".join(f'{{"ts":"{t}","job_id":"{j}","state":"{s}"}}' for t, j, s in rows))
    q = E.job_states(E.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.job_id, r.state) for r in spark.table("states").collect()} == {("a", "completed"), ("b", "submitted")}


def test_two_writers_and_a_crash(spark, tmp_path):
    root = str(tmp_path / "store")
    a, b = S.SnapshotStore(spark, root), S.SnapshotStore(spark, root)
    a.upsert(frame(spark, job(0), job(1)), NOW())
    at, seen = b.version(), b.jobs()
    a.apply(lambda d: J.set_priority(d, F.lit(True), 5, NOW()))
    with pytest.raises(S.Conflict):  # b's snapshot is complete, but another of its number is there
        b.commit(J.set_priority(seen, F.lit(True), 7, NOW()), at)
    assert {r.priority for r in b.jobs().collect()} == {5}
    # a writer that wins the look at the version but not the publication
    late = S.SnapshotStore(spark, root)
    version = late.version()
    late.version = lambda: version
    a.apply(lambda d: J.set_priority(d, F.lit(True), 6, NOW()))
    with pytest.raises(S.Conflict):
        late.commit(seen, version)
    # a writer that dies before it publishes leaves the state as it was
    files = S._Files(spark, root)
    seen.write.parquet(f"{root}/snapshot-dead")
    files.write(f"{root}/next-dead.json", "{")
    assert {r.priority for r in a.jobs().collect()} == {6} and a.apply(lambda d: d) == version + 2


def test_a_claim_is_one_commit(spark, tmp_path):
    s = S.SnapshotStore(spark, str(tmp_path / "store"))
    s.upsert(frame(spark, job(0, error_message="old"), job(1)), NOW())
    at = s.version()
    got = s.claim(1, NOW())
    assert s.version() == at + 1 and got.first().error_message is None
    rows = {r.id: r for r in s.jobs().collect()}
    assert rows["j0"].state == "validating" and rows["j0"].error_message is None and rows["j1"].state == "submitted"
    assert s.claim(5, NOW()).count() == 1 and s.claim(5, NOW()).count() == 0 and s.version() == at + 2


def test_changes_send_events(spark, tmp_path):
    seen = []
    s = S.SnapshotStore(spark, str(tmp_path / "store"), lambda e: seen.append(sorted((r.job_id, r.state, r.message) for r in e.collect())))
    s.upsert(frame(spark, job(0), job(1), job(2)), NOW())
    s.claim(1, NOW())
    s.apply(lambda d: J.transition(d, F.col("id") == "j0", "exception", NOW(), F.lit("jam")))
    s.apply(lambda d: J.add_item(d, "tags", F.col("id") == "j2", "x", NOW()), "tag added: x")
    s.remove(s.jobs().filter("id = 'j1'"))
    assert seen == [[("j0", "submitted", None), ("j1", "submitted", None), ("j2", "submitted", None)], [("j0", "validating", None)], [("j0", "exception", "jam")], [("j2", "submitted", "tag added: x")], []]
    folder = S.SnapshotStore(spark, str(tmp_path / "store"), S.event_folder(str(tmp_path / "events")))
    folder.apply(lambda d: J.retry(d, F.col("id") == "j0", NOW()))
    assert [(r.job_id, r.state) for r in spark.read.json(str(tmp_path / "events")).collect()] == [("j0", "submitted")]


def test_text_values_with_newlines_and_repeated_keys(spark, tmp_path):
    odd = job("n", profile_name='two\nlines\r and \\n "quoted"', tags=["a\nb", "back\\"])
    (tmp_path / "n.job").write_text(S.job_text(odd) + 'priority=9\nid="last"\n')
    got = S.read_text(spark, str(tmp_path)).first()
    assert (got.id, got.priority, got.profile_name, got.tags) == ("last", 9, odd["profile_name"], odd["tags"]) and got.source_path == odd["source_path"]


def test_database_tables(spark, tmp_path):
    from pagemill.sources import job_tables as T

    jobs = frame(spark, job(0, tags=["a", "b"], attachments=["/x", "/y", "/z"], due_at=T0 + dt.timedelta(microseconds=7)), job(1, state="completed", error_message="why"))
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    T.write_jdbc(jobs, url, "overwrite", **options)
    assert sorted(T.read_jdbc(spark, url, **options).collect()) == sorted(jobs.collect())
    assert [r.id for r in T.read_jdbc(spark, url, "completed", pushDownPredicate="false", **options).collect()] == ["j1"]
    assert [r.id for r in T.in_created_order(T.read_jdbc(spark, url, **options)).collect()] == ["j0", "j1"]


def test_the_store_that_is_asked_for(spark, tmp_path):
    from pagemill.sources import job_tables as T

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    T.write_jdbc(frame(spark, job(0)), url, "overwrite", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    (tmp_path / "1.job").write_text(S.job_text(job(1)))
    asked = {"text": str(tmp_path), "jdbc": url, "path": str(tmp_path / "s")}
    try:
        assert S.open_store(spark).count() == 0
        spark.conf.set("pagemill.store.text", asked["text"])
        assert [r.id for r in S.open_store(spark).collect()] == ["j1"]
        spark.conf.set("pagemill.store.jdbc", asked["jdbc"])
        assert [r.id for r in S.open_store(spark).collect()] == ["j0"]
        spark.conf.set("pagemill.store.path", asked["path"])
        assert S.open_store(spark).version() == 0
    finally:
        for k in asked:
            spark.conf.unset(f"pagemill.store.{k}")
