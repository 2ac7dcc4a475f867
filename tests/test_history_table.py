"""The stored history: changes show whole or not at all, pages equal sorting everything."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from urlrisk.operators import history as H, history_table as T, versions as V
from urlrisk.session import new_folder

START = dt.datetime(2024, 1, 1)


def entries(spark, n, minutes=40, same=0):
    """Rows over some days, some without a time, some without an id; ``same`` more of one instant."""
    rows = [(None if i % 17 == 5 else f"{i:05d}", f"text {i}", None if i % 23 == 7 else START + dt.timedelta(minutes=minutes * i)) for i in range(n)]
    rows += [(f"s{i:05d}", "same", START + dt.timedelta(minutes=30)) for i in range(same)]
    return spark.createDataFrame(rows, "id string, content string, analyzedAt timestamp").select(
        "id", "content", F.lit("text").alias("contentType"), F.lit("safe").alias("threatLevel"), F.lit(0.5).alias("score"), F.lit(False).alias("isPhishing"),
        "analyzedAt", F.lit("{}").alias("response"), F.to_date("analyzedAt").alias("date"))


def held(df):
    return sorted(((r["id"], r["content"]) for r in df.collect()), key=str)


@pytest.fixture
def table(spark):
    root = new_folder(spark, "history")
    rows = entries(spark, 120)
    T.append(rows.where("content < 'text 5'"), root, "one")
    T.append(rows.where("content >= 'text 5'"), root, "two")
    return root, rows


def test_append_is_named(spark, table):
    root, rows = table
    assert held(T.read(spark, root)) == held(rows) and T.total(spark, root) == 120
    assert T.append(rows, root, "two") is False
    assert held(T.read(spark, root)) == held(rows)


def test_delete_completes_the_table(spark, table):
    root, rows = table
    before = {(r["day"], r["attempt"]) for r in V.live(spark, root).collect()}
    assert T.delete_entry(spark, root, "nowhere") is False
    assert T.delete_entry(spark, root, "00040") is True
    assert held(T.read(spark, root)) == held(rows.where("id IS DISTINCT FROM '00040'"))
    after = {(r["day"], r["attempt"]) for r in V.live(spark, root).collect()}
    assert len(before - after) == 1 and len(after - before) == 1  # one day was written anew
    assert T.delete_entry(spark, root, "00040") is False and T.total(spark, root) == 119


def test_failing_write_leaves_the_table(spark, table):
    root, rows = table
    fail = lambda r: r.withColumn("content", F.when(F.col("id") == "00041", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(PySparkException):
        V.replace(spark, root, T.SCHEMA, lambda r: r.where("id = '00040'"), fail, "broken")
    assert held(T.read(spark, root)) == held(rows)
    assert V.replace(spark, root, T.SCHEMA, lambda r: r.where("id = '00040'"), lambda r: r, "broken") is True
    assert held(T.read(spark, root)) == held(rows)


def test_rows_appended_during_a_deletion_stay(spark, table):
    root, rows = table
    late = rows.where("id = '00041'").withColumns({"id": F.lit("late"), "content": F.lit("late")})
    def change(current):
        T.append(late, root, "three")
        return H.delete(current, "00040")
    V.replace(spark, root, T.SCHEMA, lambda r: r.where("id = '00040'"), change, "four")
    assert held(T.read(spark, root)) == held(rows.where("id IS DISTINCT FROM '00040'").unionByName(late))


def test_expiry(spark, table):
    root, rows = table
    assert T.expire(spark, root, 0, "2024-01-03T12:00:00") is False
    assert T.expire(spark, root, 1, "2024-01-03T12:00:00") is True
    assert held(T.read(spark, root)) == held(H.unexpired(rows, 1, "2024-01-03 12:00:00"))


def test_compact_keeps_rows(spark):
    root = new_folder(spark, "history")
    rows = entries(spark, 30)
    for i in range(4):
        T.append(rows.where(f"pmod(hash(content), 4) = {i}"), root, f"part-{i}")
    assert T.compact(spark, root, most=2) is True and T.compact(spark, root, most=2) is False
    assert held(T.read(spark, root)) == held(rows)
    assert V.live(spark, root).groupBy("day").count().agg(F.max("count")).first()[0] <= 2


def test_empty_table(spark):
    root = new_folder(spark, "history")
    V.create(spark, root)
    V.create(spark, root)
    assert T.read(spark, root).count() == 0 == T.total(spark, root)
    assert T.append(entries(spark, 0), root, "none") is True and V.committed(spark, root, "none")
    assert T.page(spark, root, 10, 5).count() == 0 and T.delete_entry(spark, root, "1") is False


@pytest.mark.parametrize("fine", [1, 30, 10**6])
def test_pages_equal_sorting(spark, fine):
    """Through days, hours, minutes, one instant of many rows, and rows without a time."""
    root = new_folder(spark, "history")
    rows = entries(spark, 160, minutes=13, same=90).where("id IS NOT NULL")
    T.append(rows, root, "all")
    ordered = [r["id"] for r in H.list_newest(rows).collect()]
    for limit, offset in ((10, 0), (7, 50), (20, 140), (5, len(ordered) - 12), (30, len(ordered) - 3), (4, len(ordered) + 5), (len(ordered), 0)):
        assert [r["id"] for r in T.page(spark, root, limit, offset, fine=fine).collect()] == ordered[offset:offset + limit]


def test_pages_by_key(spark):
    root = new_folder(spark, "history")
    rows = entries(spark, 60, minutes=90, same=20).where("id IS NOT NULL")
    T.append(rows, root, "all")
    ordered, got, stored = [r["id"] for r in H.list_newest(rows).collect()], [], T.read(spark, root)
    page = H.list_newest(stored, 15).collect()
    while page:
        got += [r["id"] for r in page]
        page = T.page_after(stored, 15, page[-1]["analyzedAt"], page[-1]["id"]).collect()
    assert got == ordered


def test_page_reads_its_days_only(spark, table):
    root, _ = table
    plan = T.page(spark, root, 5, 60)._jdf.queryExecution().toString()
    days = {d for d in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04") if f"day#" in plan and f"{d}" in plan.split("PartitionFilters", 1)[1].split("\n", 1)[0]}
    assert len(days) == 1


def test_delete_keeps_rows_without_id(spark):
    rows = spark.createDataFrame([("1",), (None,), ("2",)], "id string")
    assert H.delete(rows, "1").count() == 2
