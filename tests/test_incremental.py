"""Incremental extracts: cursors, nested cursors, waits, stops and batches that die."""

import datetime as dt
import json
import os

import pytest

from tradewind.sources import incremental as x
from tradewind.sources.paged import Retryable
from tradewind.streaming.consumer import Consumer


def service(folder):
    """A client over a folder: records.json and a mark for each call that was refused once."""
    os_, json_, retryable = os, json, Retryable

    class Client:
        def _records(self):
            with open(f"{folder}/records.json") as f:
                return json_.load(f)

        def _refuse_once(self, *call):
            mark = f"{folder}/refused-{'-'.join(map(str, call)).replace('/', '_')}"
            if not os_.path.exists(mark):
                open(mark, "w").close()
                raise retryable("slow down", 0.001)

        def newest(self):
            with open(f"{folder}/newest") as f:
                return f.read()

        def page(self, since, until, cursor):
            self._refuse_once("page", since, until, cursor)
            rows = [r for r in self._records() if since <= r["updated"] < until]
            at = int(cursor or 0)
            out = [{**r, "items": r["items"][:2], "items_cursor": "2" if len(r["items"]) > 2 else None} for r in rows[at : at + 3]]
            return out, str(at + 3) if at + 3 < len(rows) else None

        def nested(self, record, field, cursor):
            self._refuse_once("nested", record["id"], cursor)
            items = next(r["items"] for r in self._records() if r["id"] == record["id"] and r["updated"] == record["updated"])
            at = int(cursor)
            return items[at : at + 2], str(at + 2) if at + 2 < len(items) else None

    return Client()


def stamp(minutes):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)).strftime(x.FORMAT)


def put(folder, n, newest):
    data = [{"id": i, "updated": stamp(7 * i), "items": [f"{i}.{k}" for k in range(i % 7)], "note": None if i % 3 else "n"} for i in range(n)]
    (folder / "records.json").write_text(json.dumps(data))
    (folder / "newest").write_text(stamp(newest))
    return data


def test_a_stopped_extract_goes_on(spark, tmp_path):
    base = f"file://{tmp_path}"
    client = service(str(tmp_path))
    spark.dataSource.register(x.source("shop", client, "id int, updated string, items array<string>, note string", stamp(0), 30, 5, {"items": "items_cursor"}))
    sizes = []
    c = Consumer(spark, f"{base}/out", lambda df: df.selectExpr("*", "cast(null as array<string>) as failures"))
    take = c.take

    def counting(batch, number):
        take(batch, number)
        sizes.append(number)
        if len(sizes) == 2:
            raise RuntimeError("stopped")

    c.take = counting

    def run():
        q = c.start(spark.readStream.format("shop").load(), f"{base}/checkpoint", "0 seconds")
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    data = put(tmp_path, 40, 7 * 20)  # the newest half isn't settled yet
    run()
    assert c.state()["done"] == 20
    data = put(tmp_path, 60, 7 * 60)
    with pytest.raises(Exception, match="stopped"):
        run()
    run()
    run()
    got = sorted((r.id, r.updated, tuple(r.items), r.note) for r in c.good.read().collect())
    assert got == [(r["id"], r["updated"], tuple(r["items"]), r["note"]) for r in data]
    assert max(sizes) >= 2 and any("nested" in f for f in os.listdir(tmp_path))


def test_waits_and_cursors():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise Retryable("wait", [3.0, None, 900.0][len(calls) - 1])
        return "ok"

    assert x.patient(call, sleep=waits.append) == "ok" and waits == [3.0, 1.0, 60.0]
    with pytest.raises(Retryable):
        x.patient(lambda: (_ for _ in ()).throw(Retryable("never")), tries=2, sleep=waits.append)

    class Loops:
        def page(self, since, until, cursor):
            return [{"id": 1}], "same"

    with pytest.raises(ValueError, match="twice"):
        list(x.records(Loops(), "a", "b", {}))
