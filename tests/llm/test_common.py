"""The memory of the driver's JVM."""

from siteloom.llm import common


def test_stored_steps_tidy_a_driver_whose_heap_has_grown(spark, monkeypatch):
    trims = []
    monkeypatch.setattr(common, "_trim", trims.append, raising=False)
    monkeypatch.setattr(common, "_settled", 0, raising=False)
    common.stored(spark.range(10), "tidied")  # far below its share
    assert not trims
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0, raising=False)
    rows = common.stored(spark.range(10), "tidied")
    assert len(trims) == 1
    assert sorted(r.id for r in rows.collect()) == list(range(10))
    monkeypatch.setattr(common, "_settled", spark._jvm.java.lang.Runtime.getRuntime().maxMemory(), raising=False)
    common.stored(spark.range(10), "tidied")  # it has not grown since
    assert len(trims) == 1
