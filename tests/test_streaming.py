"""Streams: files as they come, each once, and groups batch by batch."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from kindred.operators.groups import components_of
from kindred.operators.similarity import hamming_edges
from kindred.streaming import incremental as T


def test_watched_files_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"1")
    (tmp_path / "in" / "b.txt").write_bytes(b"2")

    def collect():
        writer = T.watch_files(spark, f"file://{tmp_path}/in").select("path", "length").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        T.run_now(writer)
        return sorted(r["path"].rsplit("/", 1)[-1] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert collect() == ["a.png"]
    (tmp_path / "in" / "c.png").write_bytes(b"3")
    assert collect() == ["a.png", "c.png"]


def test_delivered_again_within_the_watermark(spark, tmp_path):
    rows = [("p", dt.datetime(2024, 1, 1)), ("p", dt.datetime(2024, 1, 1, 1)), ("q", dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "path string, mtime timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = T.once_each(spark.readStream.schema("path string, mtime timestamp").parquet(f"{tmp_path}/in"))
    T.run_now(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check"))
    assert sorted(r["path"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["p", "q"]


def test_new_modified_and_deleted_files(spark, tmp_path):
    """Listings as they come: each change once, a deletion when the time has gone on without the file, and a file that comes back is new."""
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    root, lists = tmp_path / "files", f"{tmp_path}/lists"
    (root / "sub").mkdir(parents=True)
    for name in ("a.png", "sub/b.png", "c.png"):
        (root / name).write_bytes(b"1")
    T.record_listing(spark, str(root), lists, hour(0))
    schema = "path string, length long, mtime timestamp, seen_at timestamp"

    def changes():
        stream = T.watch_changes(spark.readStream.schema(schema).parquet(lists))
        T.run_now(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check"))
        return sorted((r["path"].rsplit("/", 1)[-1], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = [("a.png", "new"), ("b.png", "new"), ("c.png", "new")]
    assert changes() == first
    (root / "a.png").write_bytes(b"22")
    (root / "sub/b.png").unlink()
    T.record_listing(spark, str(root), lists, hour(0.5))
    assert changes() == sorted([*first, ("a.png", "modified")])  # b may still be listed again
    (root / "d.png").write_bytes(b"")
    T.record_listing(spark, str(root), lists, hour(1.4))
    assert changes() == sorted([*first, ("a.png", "modified"), ("d.png", "new"), ("b.png", "deleted")])
    (root / "sub/b.png").write_bytes(b"1")
    T.record_listing(spark, str(root), lists, hour(2))
    assert changes() == sorted([*first, ("a.png", "modified"), ("d.png", "new"), ("b.png", "deleted"), ("b.png", "new")])


def test_batches_equal_one_run(spark, tmp_path):
    """A late row bridges two groups; rows delivered again change nothing."""
    rows = [(None, 0, "a", 0b0), (None, 1, "b", 0b1), (None, 2, "c", (1 << 30) - 1), (None, 3, "d", (1 << 31) - 1), (None, 4, "e", (1 << 12) - 1), (None, 5, "f", (1 << 21) - 1), (None, 1, "b", 0b1)]
    schema = "scope string, ord long, md5 string, h long"
    for i, part in enumerate((rows[:4], rows[4:6], rows[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        T.run_now(T.incremental_groups(stream, f"file://{tmp_path}/state", f"{tmp_path}/check", threshold=11))
        known = spark.createDataFrame(sum((rows[:4], rows[4:6], rows[6:])[: i + 1], []), schema).dropDuplicates(["ord"])
        want = {tuple(r) for r in components_of(hamming_edges(known, 11)).collect()}
        assert {tuple(r) for r in T.current_members(spark, f"file://{tmp_path}/state").collect()} == want


def _state_rows(seed: int, n: int) -> list[tuple]:
    """Hashes of a few families: near ones, equal ones of one digest or several, copies under two hashes, two scopes."""
    rng = random.Random(seed)
    base = [rng.getrandbits(40) for _ in range(8)]
    rows = []
    for i in range(n):
        h = rng.choice(base)
        for _ in range(rng.randrange(4)):
            h ^= 1 << rng.randrange(40)
        rows.append((rng.choice([None, "a"]), i, f"m{rng.randrange(n // 2)}", h))
    rng.shuffle(rows)
    return rows


def _expected(spark, rows):
    return {tuple(r) for r in components_of(hamming_edges(spark.createDataFrame(rows, T.ROWS), 4)).collect()}


def test_every_batch_equals_a_full_run_and_writes_what_it_touched(spark, tmp_path):
    rows = _state_rows(3, 120)
    state = T.State(spark, f"file://{tmp_path}/state")
    batches = [rows[:70], rows[70:], [(None, 900, "far", 1 << 60)], [(None, 901, "far2", 1 << 60), (None, 900, "far", 1 << 60)]]
    for number, part in enumerate(batches):
        T.add_batch(state, spark.createDataFrame(part, T.ROWS), number, 4)
        known = list({r[1]: r for b in batches[: number + 1] for r in b}.values())
        assert {tuple(r) for r in T.current_members(spark, state.directory).collect()} == _expected(spark, known)
    written = [spark.read.parquet(f"{state.directory}/labels/batch={n}").count() for n in range(4)]
    assert written[2:] == [0, 1] and state.committed() == list(range(4))
    T.add_batch(state, spark.createDataFrame(rows, T.ROWS), 2, 4)  # finished: nothing happens
    assert state.committed() == list(range(4))


def test_a_file_with_a_smaller_number_renames_its_group(spark, tmp_path):
    state = T.State(spark, f"file://{tmp_path}/state")
    T.add_batch(state, spark.createDataFrame([(None, 10, "a", 0), (None, 11, "b", 1), (None, 20, "c", 255 << 20), (None, 21, "d", 254 << 20)], T.ROWS), 0, 2)
    T.add_batch(state, spark.createDataFrame([(None, 1, "e", 0)], T.ROWS), 1, 2)
    assert {tuple(r) for r in T.current_members(spark, state.directory).collect()} == {(1, 1), (10, 1), (11, 1), (20, 20), (21, 20)}
    assert spark.read.parquet(f"{state.directory}/labels/batch=1").count() == 2


@pytest.mark.parametrize("fails_at", ["labels", "commit"])
def test_an_interrupted_batch_has_not_happened(spark, tmp_path, monkeypatch, fails_at):
    """A stream fails between two writes of its second batch; readers see the first only, and the next run goes on."""
    rows = _state_rows(4, 60)
    for k, part in enumerate((rows[:30], rows[30:])):
        spark.createDataFrame(part, T.ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    at, check = f"file://{tmp_path}/state", f"{tmp_path}/check"
    stream = spark.readStream.schema(T.ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    write, commit = T.State.write, T.State.commit

    def failing_write(self, df, table, batch):
        if batch == 1 and table == fails_at:
            raise RuntimeError("lost")
        write(self, df, table, batch)

    def failing_commit(self, batch, **counts):
        if batch == 1 and fails_at == "commit":
            raise RuntimeError("lost")
        commit(self, batch, **counts)

    monkeypatch.setattr(T.State, "write", failing_write)
    monkeypatch.setattr(T.State, "commit", failing_commit)
    with pytest.raises(Exception, match="lost"):
        T.run_now(T.incremental_groups(stream, at, check, threshold=4))
    state = T.State(spark, at)
    assert state.committed() == [0]
    first = [tuple(r) for r in state.read("hashes", T.ROWS).collect()]
    assert len(first) == 30 and {tuple(r) for r in T.current_members(spark, at).collect()} == _expected(spark, first)
    monkeypatch.undo()
    T.run_now(T.incremental_groups(stream, at, check, threshold=4))
    assert state.committed() == [0, 1] and state.read("hashes", T.ROWS).count() == 60
    assert {tuple(r) for r in T.current_members(spark, at).collect()} == _expected(spark, rows)


def test_a_blank_picture_of_many_files_costs_a_row_each(spark, tmp_path):
    """Files of one hash are no pairs: the batch's links hold different hashes only."""
    state = T.State(spark, f"file://{tmp_path}/state")
    rows = [(None, i, f"m{i}", 0) for i in range(3000)] + [(None, 5000, "x", 1)]
    T.add_batch(state, spark.createDataFrame(rows, T.ROWS), 0)
    assert state.read("edges", T.EDGES).count() == 1 and state.read("labels", T.LABELS).count() == 2
    members = T.current_members(spark, state.directory)
    assert members.count() == 3001 and members.filter("first_ord <> 0").count() == 0


def test_links_of_files_hold_those_under_one_hash(spark, tmp_path):
    """Different files of one hash are linked, copies are not, in whatever batch they come."""
    state = T.State(spark, f"file://{tmp_path}/state")
    rows = [(None, 0, "a", 0), (None, 1, "a", 0), (None, 2, "b", 0), (None, 3, "a", 1), (None, 4, None, 3), ("z", 5, "c", 0), ("z", 6, "d", 0), (None, 7, "e", 1 << 40)]
    for number, part in enumerate((rows[:2], rows[2:5], rows[5:])):
        T.add_batch(state, spark.createDataFrame(part, T.ROWS), number, 2)
    want = {tuple(r) for r in hamming_edges(spark.createDataFrame(rows, T.ROWS), 2).collect()}
    found = [tuple(r) for r in T.current_file_edges(spark, state.directory).collect()]
    assert len(found) == len(want) and set(found) == want and {(0, 2, 0), (1, 2, 0), (5, 6, 0)} <= want
