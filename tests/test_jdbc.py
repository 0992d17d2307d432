"""Reads of a database by several connections at one moment, against Derby in memory."""

import threading
import time

import pytest

from tradewind.sources import registry

URL = "jdbc:derby:memory:shop;create=true"
DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


@pytest.fixture
def table(spark):
    spark._jvm.java.lang.Class.forName(DRIVER)
    c = spark._jvm.java.sql.DriverManager.getConnection(URL)
    s = c.createStatement()
    s.execute("CREATE TABLE orders (id BIGINT, note VARCHAR(20))")
    for at in range(0, 3000, 500):
        s.execute("INSERT INTO orders VALUES " + ", ".join(f"({i}, 'n{i}')" for i in range(at, at + 500)))
    s.execute("INSERT INTO orders VALUES (NULL, 'no key')")
    yield c
    s.execute("DROP TABLE orders")
    c.close()


def test_rows_inserted_meanwhile_stay_out(spark, table):
    """A writer adds pairs (one row at each end) all the while; a mixed read would have one of a pair."""
    stop, added = threading.Event(), []

    def write():
        c = spark._jvm.java.sql.DriverManager.getConnection(URL)
        c.setAutoCommit(False)
        s = c.createStatement()
        n = 0
        while not stop.is_set():
            n += 1
            try:
                s.execute(f"INSERT INTO orders VALUES ({-n}, 'low'), ({3000 + n}, 'high')")
                c.commit()
                added.append(n)
            except Exception:  # noqa: BLE001  a writer may wait in vain; what it wrote is gone whole
                c.rollback()
            time.sleep(0.001)
        c.close()

    x = threading.Thread(target=write)
    x.start()
    try:
        while len(added) < 5:
            time.sleep(0.05)
        got = []
        for _ in range(3):
            got.append(registry.jdbc_at_once(spark, URL, "orders", "id BIGINT, note STRING", "id", 5, hold="LOCK TABLE orders IN SHARE MODE", driver=DRIVER))
            time.sleep(0.5)
    finally:
        stop.set()
        x.join()
    sizes = []
    for df in got:
        low, high, rest = (df.filter(c).count() for c in ("note = 'low'", "note = 'high'", "note not in ('low', 'high')"))
        assert low == high and rest == 3001 and df.filter("id is null").count() == 1
        sizes.append(low)
    assert sizes == sorted(sizes) and 0 < sizes[-1] <= len(added)


def test_small_tables(spark, table):
    read = lambda: registry.jdbc_at_once(spark, URL, "orders", "id BIGINT, note STRING", "id", 4, driver=DRIVER)
    s = table.createStatement()
    s.execute("DELETE FROM orders WHERE id IS NOT NULL")
    assert [tuple(r) for r in read().collect()] == [(None, "no key")]
    s.execute("DELETE FROM orders")
    assert read().count() == 0
    s.execute("INSERT INTO orders VALUES (7, 'one')")
    assert [tuple(r) for r in read().collect()] == [(7, "one")]
    one = registry.jdbc_snapshot(spark, URL, "orders", "id BIGINT, note STRING", driver=DRIVER)
    assert [tuple(r) for r in one.collect()] == [(7, "one")]
