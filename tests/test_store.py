"""Materialised cases: whole or not at all, by case and key, with failed and repeated runs."""

import pytest
from pyspark.sql import functions as F

from callgrid.sources import store

ROWS = "case_id string, n long"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def rows(df):
    return None if df is None else sorted((r["case_id"], r["n"]) for r in df.collect())


def test_publish(spark, path):
    """Cases are replaced one by one, others stay; null is the case ''; a case without rows becomes empty; '1' and '01' are two."""
    assert store.read(spark, path, "a", 1) is None and store.manifest(spark, path).count() == 0
    first = frame(spark, ("1", 10), ("01", 11), (None, 12), ("2", 20), ("2", 21))
    assert store.publish(spark, path, "r1", 1, {"a": lambda: first, "b": lambda: first.where("n > 20")}, first)
    assert rows(store.read(spark, path, "a", 1)) == [("", 12), ("01", 11), ("1", 10), ("2", 20), ("2", 21)]
    assert rows(store.read(spark, path, "a", 1, "1")) == [("1", 10)] and rows(store.read(spark, path, "a", 1, "")) == [("", 12)]
    assert rows(store.read(spark, path, "b", 1, "1")) == [] and store.read(spark, path, "b", 1, "9") is None and store.read(spark, path, "a", 2) is None
    second = frame(spark, ("2", 30), ("7", 70))
    assert store.publish(spark, path, "r2", 1, {"a": lambda: second}, frame(spark, ("2", 0), ("1", 0)))
    assert rows(store.read(spark, path, "a", 1)) == [("", 12), ("01", 11), ("2", 30)]
    assert rows(store.read(spark, path, "b", 1)) == [("2", 21)]
    got = {(r["key"], r["case_id"]): (r["run"], r["rows"]) for r in store.manifest(spark, path).collect()}
    assert got == {("a", ""): ("r1", 1), ("a", "01"): ("r1", 1), ("a", "1"): ("r2", 0), ("a", "2"): ("r2", 1), ("b", ""): ("r1", 0), ("b", "01"): ("r1", 0), ("b", "1"): ("r1", 0), ("b", "2"): ("r1", 1)}


def test_a_failed_run_is_invisible(spark, path):
    """A run that fails between two tables changes nothing; the same run then succeeds; once more it does nothing."""
    old = frame(spark, ("1", 1))
    store.publish(spark, path, "r1", 1, {"a": lambda: old, "b": lambda: old}, old)
    new = frame(spark, ("1", 2))

    def broken():
        return new.withColumn("n", F.raise_error(F.lit("executor lost")).cast("long"))

    with pytest.raises(Exception, match="executor lost"):
        store.publish(spark, path, "r2", 1, {"a": lambda: new, "b": broken}, new)
    assert rows(store.read(spark, path, "a", 1)) == [("1", 1)] and rows(store.read(spark, path, "b", 1)) == [("1", 1)]
    assert store.publish(spark, path, "r2", 1, {"a": lambda: new, "b": lambda: new}, new)
    assert not store.publish(spark, path, "r2", 1, {"a": broken, "b": broken}, new)
    assert rows(store.read(spark, path, "a", 1)) == rows(store.read(spark, path, "b", 1)) == [("1", 2)]


def test_versions_and_read_through(spark, path):
    """Tables of another version count as absent and are made anew."""
    made = []

    def build():
        made.append(1)
        return frame(spark, ("1", len(made)))

    read = lambda run, version: rows(store.read_through(spark, path, run, version, "a", build, "1"))
    assert read("r1", 1) == [("1", 1)] and read("r2", 1) == [("1", 1)]
    assert read("r3", 2) == [("1", 2)] and read("r4", 2) == [("1", 2)] and store.read(spark, path, "a", 1) is None


def test_tidy(spark, path):
    """Runs that no kept state needs go, those of a failed run among them; what is valid stays readable."""
    for i in range(3):
        store.publish(spark, path, f"r{i}", 1, {"a": lambda i=i: frame(spark, ("1", i))}, frame(spark, ("1", 0)))
    store.publish(spark, path, "other", 1, {"a": lambda: frame(spark, ("2", 5))}, frame(spark, ("2", 0)))
    with pytest.raises(ZeroDivisionError):
        store.publish(spark, path, "failed", 1, {"a": lambda: 1 / 0}, frame(spark, ("1", 0)))
    assert store.tidy(spark, path) == ["failed", "r0", "r1"]
    assert rows(store.read(spark, path, "a", 1)) == [("1", 2), ("2", 5)] and store.tidy(spark, path) == []
    with pytest.raises(ValueError):
        store.publish(spark, path, "../x", 1, {}, frame(spark, ("1", 0)))
