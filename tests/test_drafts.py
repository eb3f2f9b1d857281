"""The life of drafts: table against stream against stated rules, and a stream that is stopped and started again."""

import datetime as dt
import random

from rowloom.streaming import drafts


def commands():
    rng, start, rows = random.Random(12), dt.datetime(2024, 1, 1), []
    for i in range(300):
        kind = rng.choice(["CREATE", "EDIT", "READ", "CONFIRM", "CONFIRM", "PREFER", "READ"] + ["DISCARD"] * (i % 3 == 0))
        at = start + dt.timedelta(minutes=7 * i)
        rows.append((f"d{rng.randrange(25)}", at, i, kind, at + dt.timedelta(minutes=rng.choice([200, 700, 5000])) if kind == "CREATE" and rng.random() < 0.8 else None, f"p{i}"))
    return rows


def test_lifecycle(spark, tmp_path):
    rows = commands()
    found = {r.seq: r for r in drafts.outcomes(spark.createDataFrame(rows, drafts.COMMANDS)).collect()}
    state = {}
    for draft, at, seq, command, expires, payload in rows:
        s, r = state.get(draft), found[seq]
        if command == "CREATE":
            expected = "DRAFT_EXISTS" if s else "OK"
            s = s or {"status": "NEW", "payload": payload, "until": expires, "prefer": None, "confirmed": None}
        elif s is None:
            expected = "DRAFT_NOT_FOUND"
        elif s["status"] == "DISCARDED":
            expected = "DRAFT_DISCARDED"
        elif s["until"] and s["until"] < at:
            expected = "DRAFT_EXPIRED"
        else:
            expected = "OK"
            if command == "EDIT":
                s |= {"status": "EDITING", "payload": payload}
            elif command == "CONFIRM" and s["status"] != "CONFIRMED":
                s |= {"status": "CONFIRMED", "confirmed": at}
            elif command == "DISCARD":
                s["status"] = "DISCARDED"
            elif command == "PREFER":
                s["prefer"] = payload
        if s:
            state[draft] = s
        assert r.outcome == expected, (r, expected)
        assert r.status == ("EXPIRED" if expected == "DRAFT_EXPIRED" else s and s["status"])
        assert (r.payload, r.preferences, r.confirmed_at) == ((s["payload"], s["prefer"], s["confirmed"]) if s else (None, None, None))
    assert {r.outcome for r in found.values()} == {"OK", "DRAFT_EXISTS", "DRAFT_NOT_FOUND", "DRAFT_DISCARDED", "DRAFT_EXPIRED"}

    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder, out = str(tmp_path / "in"), str(tmp_path / "out")
        for part in (rows[:120], rows[120:200], rows[200:]):
            spark.createDataFrame(part, drafts.COMMANDS).coalesce(1).write.mode("append").parquet(folder)
            source = spark.readStream.schema(drafts.COMMANDS).parquet(folder)
            query = drafts.stream_outcomes(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", out).trigger(availableNow=True).start()
            query.awaitTermination()
        got = {r.seq: r for r in spark.read.parquet(out).collect()}
    finally:
        spark.conf.unset(name)
    assert set(got) == set(found)
    for seq, r in found.items():
        assert (got[seq].outcome, got[seq].status, got[seq].confirmed_at) == (r.outcome, r.status, r.confirmed_at), (r, got[seq])
        if r.outcome == "OK":
            assert (got[seq].payload, got[seq].preferences) == (r.payload, r.preferences)
