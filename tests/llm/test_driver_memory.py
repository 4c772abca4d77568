"""The driver gives back what its JVM has freed outside of the heap."""

from cytolake.llm import shared


def test_the_driver_gives_memory_back(spark, monkeypatch):
    assert shared.trim_driver(spark)
    seen = []
    monkeypatch.setattr(shared, "trim_driver", seen.append)
    shared.Tables(spark).free()
    assert seen == [spark]
