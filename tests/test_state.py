"""State across batches, restarts and checkpoints: each message once, each count once, late rows apart."""

import json

import pytest

from briefwell.operators.history import COUNTS
from briefwell.sources import files
from briefwell.streaming import state

ENTRY = "update_id long, text string, created_at timestamp, is_feedback boolean"
COUNT = f"source_key string, {', '.join(f'{c} int' for c in COUNTS)}, last_selected_at string, last_seen_at string"


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def entry(k, at="2024-01-01T00:00:00Z", feedback=True):
    return {"update_id": k, "text": f"t{k}", "created_at": at, "is_feedback": feedback}


def sync(spark, tmp_path, name="c", **how):
    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    state.sync_feedback(stream, str(tmp_path / "table"), str(tmp_path / name), flag="is_feedback", **how).awaitTermination()
    return sorted(r.update_id for r in state.feedback_entries(spark, str(tmp_path / "table")).collect()), state.feedback_mark(spark, str(tmp_path / "table"))


@pytest.mark.parametrize("how", [{}, {"at": "created_at"}])
def test_feedback_once(spark, tmp_path, how):
    land(tmp_path / "in", "a.json", [entry(1), entry(2), entry(2), entry(3, feedback=False), {"text": "no id"}])
    assert sync(spark, tmp_path, **how) == ([1, 2], 3)  # the mark moves past what is skipped
    land(tmp_path / "in", "b.json", [entry(2), entry(5), entry(4), entry(9, feedback=False)])
    assert sync(spark, tmp_path, **how) == ([1, 2, 4, 5], 9)
    assert sync(spark, tmp_path, **how) == ([1, 2, 4, 5], 9)  # nothing new
    land(tmp_path / "in", "c.json", [entry(7), entry(12)])
    assert sync(spark, tmp_path, "other", **how) == ([1, 2, 4, 5, 12], 12)  # a new checkpoint passes over ids up to the mark


def test_feedback_batch_that_fails_is_taken_again(spark, tmp_path, monkeypatch):
    land(tmp_path / "in", "a.json", [entry(1), entry(2)])
    write, failed = state._write, []

    def once(rows, folder):
        if "/marks/" in folder and not failed:
            failed.append(folder)
            raise RuntimeError("lost")
        write(rows, folder)

    monkeypatch.setattr(state, "_write", once)
    with pytest.raises(Exception, match="lost"):
        sync(spark, tmp_path)
    land(tmp_path / "in", "b.json", [entry(3)])
    assert sync(spark, tmp_path) == ([1, 2, 3], 3) and failed


def test_feedback_empty_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(ENTRY).json(str(tmp_path / "in"))
    state.sync_feedback(stream, str(tmp_path / "table"), str(tmp_path / "c")).awaitTermination()
    assert state.feedback_entries(spark, str(tmp_path / "table")) is None and state.feedback_mark(spark, str(tmp_path / "table")) is None


def test_feedback_messages(spark, tmp_path):
    said = lambda k, text, **more: {"update_id": k, "message": {"text": text, "message_id": k, "date": 1700000000, "chat": {"id": 5}, "from": {"username": "u" if k % 2 else "", "first_name": "f" if k < 6 else ""}} | more}
    rows = [said(1, "x #Feedback good"), said(2, "Phản hồi: hay"), said(3, "feedbacks"), said(4, "yes", reply_to_message={"from": {"is_bot": True}}), said(5, ""), {"update_id": 6}, said(7, "hi @Brief"), said(8, "hi @briefer"), {"update_id": 9, "edited_message": said(9, "feedback - new")["message"]}]
    land(tmp_path / "in", "a.json", rows)
    got = {r.update_id: r for r in files.feedback_messages(spark.read.json(str(tmp_path / "in")), "brief").collect()}
    assert {k for k, r in got.items() if r.is_feedback} == {1, 2, 4, 7, 9} and len(got) == 9
    assert (got[2].text, got[2].user_name, got[9].text, got[8].user_name) == ("hay", "f", "new", "unknown")
    assert [r.update_id for r in files.feedback_updates(spark.read.json(str(tmp_path / "in")), 4).orderBy("update_id").collect()] == [9]


def counts(key, n=1, seen="", selected=""):
    return {"source_key": key, **{c: n for c in COUNTS}, "last_selected_at": selected, "last_seen_at": seen}


def keep(spark, tmp_path, name="c", **how):
    stream = spark.readStream.schema(COUNT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    state.keep_source_history(stream, str(tmp_path / "table"), str(tmp_path / name), **how).awaitTermination()
    return {r.source_key: (r.runs_seen, r.skipped_weak, r.last_selected_at, r.last_seen_at) for r in state.newest_source_history(spark, str(tmp_path / "table")).collect()}


def test_history_batches_touch_their_own_sources(spark, tmp_path):
    usual = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    land(tmp_path / "in", "a.json", [counts("s", 2, "2024-01-01", "2024-01-01"), counts("s"), counts("t"), {"source_key": "u"}, {"source_key": None, "runs_seen": 5}])
    assert keep(spark, tmp_path) == {"s": (3, 3, "2024-01-01", "2024-01-01"), "t": (1, 1, "", ""), "u": (0, 0, "", "")}
    land(tmp_path / "in", "b.json", [counts("s", 4, "2023-01-01", "2023-06-01")])
    assert keep(spark, tmp_path)["s"] == (7, 7, "2024-01-01", "2024-01-01")  # restarted from its checkpoint
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == usual
    written = spark.read.parquet(str(tmp_path / "table/totals"))
    assert {(r.batch, r.source_key) for r in written.collect()} == {(0, "s"), (0, "t"), (0, "u"), (1, "s")}
    again = keep(spark, tmp_path, "other")  # a new checkpoint reads all files again and goes on from the totals
    assert again["s"][0] == 14 and again["t"][0] == 2


def test_history_batch_that_fails_counts_once(spark, tmp_path, monkeypatch):
    land(tmp_path / "in", "a.json", [counts("s", 1), counts("t", 1)])
    keep(spark, tmp_path)
    write, failed = state._write, []

    def once(rows, folder):
        if "/totals/" in folder and not failed:
            failed.append(folder)
            raise RuntimeError("lost")
        write(rows, folder)

    monkeypatch.setattr(state, "_write", once)
    land(tmp_path / "in", "b.json", [counts("s", 10)])
    with pytest.raises(Exception, match="lost"):
        keep(spark, tmp_path)
    assert {k: v[0] for k, v in keep(spark, tmp_path).items()} == {"s": 11, "t": 1} and failed


def test_late_rows_go_apart(spark, tmp_path):
    land(tmp_path / "in", "a.json", [counts("s", 1, "2024-01-10T00:00:00Z"), counts("s", 1, "2024-01-01T00:00:00Z")])  # of one batch: none is late
    keep(spark, tmp_path, lateness=86400.0)
    land(tmp_path / "in", "b.json", [counts("s", 100, "2024-01-08T23:00:00Z"), counts("s", 1, "2024-01-09T01:00:00Z"), counts("s", 1), counts("t", 5, "2020-01-01")])
    assert {k: v[0] for k, v in keep(spark, tmp_path, lateness=86400.0).items()} == {"s": 4, "t": 5}
    assert [(r.source_key, r.runs_seen) for r in state.late_source_rows(spark, str(tmp_path / "table")).collect()] == [("s", 100)]
