from types import SimpleNamespace

import pytest

from rowloom.session import materialise, remove_scratch, scratch_path, shared_dir


@pytest.fixture
def elsewhere(monkeypatch, tmp_path):
    """A shared folder of its own, so that nobody else's data is removed."""
    monkeypatch.setattr("rowloom.session.shared_dir", lambda spark: f"file://{tmp_path}")
    return tmp_path


def test_scratch_lies_in_the_shared_folder_and_can_be_removed(spark, elsewhere):
    stored = materialise(spark.range(3), "some")
    assert stored.count() == 3 and scratch_path(spark, "x") != scratch_path(spark, "x")
    own = spark.sparkContext.applicationId
    assert [p.name for p in (elsewhere / "rowloom").iterdir()] == [own]
    (elsewhere / "rowloom" / "local-1").mkdir()
    assert remove_scratch(spark, older_than_ms=3_600_000) == []  # too young
    assert remove_scratch(spark, "*") == ["local-1"]
    assert remove_scratch(spark) == [own] and remove_scratch(spark) == []
    assert list((elsewhere / "rowloom").iterdir()) == []


def test_only_a_local_session_may_do_without_a_shared_folder():
    def session(master, folder=None):
        context = SimpleNamespace(master=master, applicationId=f"app of {master}")
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default=None: folder))

    local = session("local[2]")
    assert shared_dir(local) == shared_dir(local) != shared_dir(session("local"))
    assert shared_dir(session("yarn", "hdfs://n/x/")) == "hdfs://n/x"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://n:7077"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
