import threading
import time

import pytest

from tenura.operators.publish import Publication


def put(spark, publication, value, uses=()):
    with publication.writing(f"{value:012d}") as version:
        spark.createDataFrame([(value,)] * 3, "v int").coalesce(1).write.parquet(f"{publication.folder(version)}/t")
        publication.commit(version, {"value": value, "uses": list(uses)})
    return version


def value_of(spark, publication, version):
    rows = spark.read.schema("v int").parquet(f"{publication.folder(version)}/t").collect()
    assert len(rows) == 3 and {r["v"] for r in rows} == {publication.manifest(version)["value"]}
    return rows[0]["v"]


def test_a_reader_never_fails_during_a_hundred_promotions(spark, tmp_path):
    publication = Publication(spark, str(tmp_path / "p"))
    put(spark, publication, 0)
    seen, wrong, done = [], [], threading.Event()

    def read():
        own = Publication(spark, str(tmp_path / "p"))
        while not done.is_set():
            try:
                with own.reading() as version:
                    seen.append(value_of(spark, own, version))
            except Exception as e:  # noqa: BLE001
                wrong.append(e)
                return

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 101):
        put(spark, publication, k)
        publication.clean(keep=1)
    done.set()
    reader.join()
    assert not wrong and seen == sorted(seen) and len(set(seen)) > 10
    publication.clean(keep=1)
    assert publication.commits() == publication._names("versions") == [publication.current()]


@pytest.mark.parametrize("step", ["claimed", "write", "write_report", "_empty", "after"])
def test_a_crash_leaves_the_old_or_the_new(spark, tmp_path, monkeypatch, step):
    from tenura.operators import publish

    root = str(tmp_path / "p")
    put(spark, Publication(spark, root), 1)
    publication = Publication(spark, root)

    def fail(*_, **__):
        raise RuntimeError("injected")

    if step == "write_report":
        monkeypatch.setattr(publish, "write_report", fail)
    elif step == "_empty":
        plain = publication._empty
        monkeypatch.setattr(publication, "_empty", lambda at: fail() if "/commits/" in at else plain(at))
    elif step == "claimed":
        monkeypatch.setattr(publication, "claimed", fail)
    with pytest.raises(RuntimeError):
        with publication.writing("2") as version:
            spark.range(3).selectExpr("2 AS v").write.parquet(f"{publication.folder(version)}/t")
            if step == "write":
                fail()
            publication.commit(version, {"value": 2})
            fail()
    monkeypatch.undo()
    after = Publication(spark, root)
    with after.reading() as version:
        assert value_of(spark, after, version) == (2 if step == "after" else 1)
    assert len(after._names("versions")) == len(after.commits())
    put(spark, after, 3)
    assert value_of(spark, after, after.current()) == 3


def test_leases_and_used_folders_stay(spark, tmp_path):
    publication = Publication(spark, str(tmp_path / "p"))
    with pytest.raises(FileNotFoundError):
        with publication.reading():
            pass
    first = put(spark, publication, 1)
    with publication.reading() as held:
        second = put(spark, publication, 2)
        third = put(spark, publication, 3, uses=[second])
        assert publication.clean(keep=1) == [] and publication.current() == third
        assert held == first and value_of(spark, publication, held) == 1
    assert publication.clean(keep=1) == [first] and value_of(spark, publication, second) == 2
    put(spark, publication, 4)
    with publication.reading(seconds=0):
        put(spark, publication, 5)
        time.sleep(1.1)
        publication.clean(keep=1)  # the lease has run out
    assert publication._names("versions") == [publication.current()]


def test_two_writers_get_two_numbers(spark, tmp_path):
    publication = Publication(spark, str(tmp_path / "p"))
    with publication.writing("a") as one, publication.writing("b") as two:
        assert one[:8] != two[:8]
        for version, value in ((two, 2), (one, 1)):
            spark.range(3).selectExpr(f"{value} AS v").write.parquet(f"{publication.folder(version)}/t")
            publication.commit(version, {"value": value})
    assert publication.current() == two  # the higher number, whoever commits first
    with pytest.raises(OSError):
        publication.commit(one, {})
