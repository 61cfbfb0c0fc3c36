"""State of comments over batches, replays and restarts; sessions that close."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from strataloom.streaming import state

SCHEMA = "audit_id long, comment_id long, kind string, seq long, target string, mentions array<string>, status string, user_id long, vote int"


def _events(seed: int, n: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    for seq in range(n):
        audit, comment = rng.randrange(2), rng.randrange(4)
        kind = rng.choice(["comment", "status", "vote", "vote", "unvote"])
        text = kind == "comment"
        out.append((audit, comment, kind, seq, f"T{seq}" if text else None, rng.sample(["M1", "M2", "M3"], 2) if text else None, rng.choice(["hidden", "active", "resolved"]) if kind == "status" else None, rng.randrange(3) if "vote" in kind else None, rng.choice([-1, 1]) if kind == "vote" else None))
    return out


def _plain(events: list[tuple]) -> dict:
    """The state by the greatest seq of each comment, status and user."""
    out = {}
    for key in {e[:2] for e in events}:
        mine = sorted({(e[3], e[2], e[4], tuple(e[5] or ()), *e[6:]) for e in events if e[:2] == key})
        texts, changes, votes = [e for e in mine if e[1] == "comment"], [e for e in mine if e[1] == "status"], {}
        for e in mine:
            if "vote" in e[1]:
                votes[e[5]] = e[6] if e[1] == "vote" else 0
        target, status = texts[-1][2] if texts else None, changes[-1][4] if changes else "active"
        up, down = sum(v > 0 for v in votes.values()), sum(v < 0 for v in votes.values())
        out[key] = (target, status, target is not None and status != "hidden", sorted({m for e in texts for m in e[3]}), up - down, up, down, mine[-1][0])
    return out


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    state.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def _put(folder, name: str, events: list[tuple]) -> None:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    pdf = pd.DataFrame(events, columns=names).astype({"user_id": "Int64", "vote": "Int32"})
    pdf.to_parquet(folder / f"{name}.parquet")


def test_replays_and_restarts_change_nothing(rocks, tmp_path):
    spark, folder, base = rocks, tmp_path / "events", str(tmp_path / "run")
    folder.mkdir()
    events = _events(3, 60)
    random.Random(4).shuffle(events)

    def run() -> dict:
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        state.write_by_audit(state.comment_updates(source), base)
        return {(r.audit_id, r.comment_id): tuple(r)[2:] for r in state.latest(spark, base).collect()}

    _put(folder, "1", events[:20])
    _put(folder, "2", events[20:40])
    assert run() == _plain(events[:40])
    _put(folder, "3", events[:30])  # a replay of what was there
    assert {k: v for k, v in run().items()} == _plain(events[:40])
    _put(folder, "4", events[40:] + events[10:15])  # after a restart from the checkpoint, with some rows again
    assert run() == _plain(events)
    assert run() == _plain(events)  # nothing new
    one = {(r.audit_id, r.comment_id) for r in state.latest(spark, base, audit_id=1).collect()}
    assert one == {k for k in _plain(events) if k[0] == 1}


def test_sessions_close_and_late_rows_go(spark, tmp_path):
    folder, base = tmp_path / "visits", str(tmp_path / "run")
    folder.mkdir()

    def put(name: str, rows: list[tuple]) -> None:
        pd.DataFrame([(u, pd.Timestamp(t)) for u, t in rows], columns=["user_id", "ts"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / f"{name}.parquet")

    def run() -> list:
        source = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(str(folder))
        state.write_by_audit(state.closed_sessions(source, gap="1 hour", late="1 hour"), base, mode="append")
        rows = state._written(spark, base, "audit_id long, start timestamp, end timestamp, n long").collect()
        return sorted((r.audit_id, r.start.strftime("%d %H:%M"), r.n) for r in rows)

    put("1", [(1, "2024-01-01 00:00"), (1, "2024-01-01 00:30"), (2, "2024-01-01 00:10"), (1, "2024-01-01 05:00")])
    first = run()
    assert first in ([], [(1, "01 00:00", 2), (2, "01 00:10", 1)])  # closed once the watermark has moved on
    put("2", [(1, "2024-01-01 00:45"), (3, "2024-01-02 00:00")])  # the first row is later than the watermark
    run()
    put("3", [(3, "2024-01-03 00:00")])
    assert run() == [(1, "01 00:00", 2), (1, "01 05:00", 1), (2, "01 00:10", 1), (3, "02 00:00", 1)]
