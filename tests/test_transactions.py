"""Commits of several writers, queues that are consumed once, uploads with broken lines, bounded queues."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from labelaudit.operators import queues
from labelaudit.sources import files, queue
from labelaudit.sources.commits import CommitLog
from labelaudit.sources.transactions import DuplicateKeyError, Table


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/x"


def rows(spark, low, high, status="a"):
    return spark.range(low, high).select("id", F.lit(status).alias("status"), F.lit(int(status > "a")).alias("n"))


def held(table):
    return {r.id: r.status for r in table.read().collect()}


def test_a_commit_is_one_writers(spark, path):
    logs = [CommitLog(spark, path) for _ in range(6)]
    won = []

    def write(k):
        for version in range(5):
            if logs[k].put(version, {"by": k}):
                won.append((version, k))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(v for v, _ in won) == list(range(5))
    assert {v: e["by"] for v, e in logs[0].since(-1)} == dict(won) and logs[0].versions() == list(range(5))


def test_insert_upsert_delete(spark, path):
    table = Table(spark, path, "id", 4)
    assert table.read() is None
    assert table.insert(rows(spark, 0, 20)) == 0 and table.insert(rows(spark, 20, 30)) == 1
    for bad in (rows(spark, 29, 35), rows(spark, 40, 42).union(rows(spark, 41, 43))):
        with pytest.raises(DuplicateKeyError):
            table.insert(bad)
    assert sorted(held(table)) == list(range(30))
    table.insert(rows(spark, 29, 31), unique=False)
    assert table.read().count() == 32
    table.upsert(rows(spark, 25, 40, "b"), "n")
    table.delete(rows(spark, 0, 5))
    assert held(table) == {i: "b" if i >= 25 else "a" for i in range(5, 40)}
    assert sorted(r.id for r in table.read(0).collect()) == list(range(20))  # as of the first commit
    table.delete(rows(spark, 0, 100))
    assert table.read().count() == 0 and table.insert(rows(spark, 3, 4)) > 0


def test_the_slower_writer_goes_on_from_the_faster(spark, path, monkeypatch):
    """Another commit comes between reading and committing: no row is lost, and a key is still unique."""
    table, other = Table(spark, path, "id", 2), Table(spark, path, "id", 2)
    table.insert(rows(spark, 0, 10))
    put, between = table.log.put, []

    def late(version, entry):
        if between:
            between.pop()()
        return put(version, entry)

    monkeypatch.setattr(table.log, "put", late)
    between.append(lambda: other.insert(rows(spark, 10, 20)))
    table.insert(rows(spark, 20, 30))
    between.append(lambda: other.upsert(rows(spark, 0, 3, "b"), "n"))
    table.upsert(rows(spark, 2, 5, "c"), "n")
    assert held(table) == {i: "c" if 2 <= i < 5 else "b" if i < 2 else "a" for i in range(30)}
    between.append(lambda: other.insert(rows(spark, 50, 60)))
    with pytest.raises(DuplicateKeyError):
        table.insert(rows(spark, 59, 65))
    assert len(held(table)) == 40 and not between


def test_two_writers_at_once(spark, path):
    Table(spark, path, "id", 4).insert(rows(spark, 0, 1))
    threads = [threading.Thread(target=lambda k=k: Table(spark, path, "id", 4).insert(rows(spark, 10 * k, 10 * k + 10))) for k in range(1, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(held(Table(spark, path, "id", 4))) == [0, *range(10, 40)]


def jobs(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("job"))


def numbers(frame):
    return [int(r.value.split(":")[1][:-1]) for r in frame.orderBy("place").collect()]


def test_what_is_popped_is_gone(spark, path):
    assert queue.length(spark, path) == 0 and queue.pop(spark, path).count() == 0
    queue.push(jobs(spark, 0, 50), path, "job")
    queue.push(jobs(spark, 50, 60), path, "job")
    assert numbers(queue.peek(spark, path, 3)) == [0, 1, 2] and queue.length(spark, path) == 60
    first = queue.pop(spark, path, 5)
    assert numbers(first) == [0, 1, 2, 3, 4] == numbers(first)  # taken once, read as often as one likes
    assert numbers(queue.pop(spark, path, 47)) == list(range(5, 52))  # over the end of a segment
    assert numbers(queue.pop(spark, path, 2, consumer="other")) == [0, 1]
    assert numbers(queue.pop(spark, path, 100)) == list(range(52, 60)) and queue.length(spark, path) == 0
    assert queue.push(jobs(spark, 60, 61), path, once="p") == queue.push(jobs(spark, 60, 61), path, once="p")
    assert numbers(queue.pop(spark, path, 100)) == [60]


def test_consumers_of_one_name_share(spark, path):
    queue.push(jobs(spark, 0, 40), path, "job")
    got = []
    threads = [threading.Thread(target=lambda: got.append(numbers(queue.pop(spark, path, 10)))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(x for g in got for x in g) == list(range(40)) and all(len(g) == 10 for g in got)


def test_queue_as_a_stream(spark, path):
    """A stream goes on where it stopped, and one that writes commits each batch once."""
    target = path + "-2"

    def run(sink):
        q = queue.stream(spark, path).select("value").writeStream.foreachBatch(sink).option("checkpointLocation", path + "-c").trigger(availableNow=True).start()
        assert q.awaitTermination(90)

    queue.push(jobs(spark, 0, 30), path, "job")
    sink = queue.push_batches(target, "copy")
    run(sink)
    queue.push(jobs(spark, 30, 37), path, "job")
    run(lambda batch, number: (sink(batch, number), sink(batch, number)) and None)
    run(sink)
    assert queue.length(spark, target) == 37
    spark.dataSource.register(queue.QueueSource)
    assert sorted(r.place for r in spark.read.format("labelqueue").load(target).collect()) == list(range(37))


def test_uploads_with_broken_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('seller_id,product_name\ns1,"a ""b"",\nc"\ns2,\ns3\ns4,x,y\n'.encode() + b"s5,\xff\n")
    (tmp_path / "b.csv").write_bytes(b"seller_id,product_name\n")
    (tmp_path / "c.txt").write_bytes(b"seller_id,product_name\nno,upload\n")
    good = {tuple(r) for r in files.read_batch_csv(spark, str(tmp_path)).collect()}
    assert good == {("s1", 'a "b",\nc', "", ""), ("s2", "", "", "")}
    assert ("s2", "nan", "", "") in {tuple(r) for r in files.read_batch_csv(spark, str(tmp_path), blank="nan").collect()}
    bad = {(r.file, r.line.strip(), r.reason) for r in files.rejected_csv(spark, str(tmp_path)).collect()}
    assert bad == {("a.csv", "s3", "number of cells"), ("a.csv", "s4,x,y", "number of cells"), ("a.csv", "s5,�", "not UTF-8")}


@pytest.mark.parametrize("highest", [True, False])
def test_a_queue_that_drives_out_one_at_each_arrival(spark, highest):
    rng = random.Random(4)
    jobs_ = [(i, f"u{rng.randrange(60)}" + "/" * (i % 2), rng.randrange(6)) for i in range(150)]
    held_, seen = [], set()
    for i, url, priority in jobs_:
        url = url.rstrip("/")
        if url in seen:
            continue
        if len(held_) == 10:
            held_.remove(max(held_, key=lambda x: (x[2] if highest else -x[2], x[0])))
        seen.add(url)
        held_.append((i, url, priority))
    frame = spark.createDataFrame(jobs_, "job_id long, url string, priority int")
    assert {tuple(r) for r in queues.arriving_queue(frame, 10, highest).select("job_id", "url", "priority").collect()} == set(held_)
    assert queues.arriving_queue(frame.limit(0), 10).count() == 0 and queues.arriving_queue(frame.limit(1), 10).count() == 1
