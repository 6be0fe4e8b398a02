from tracemill.llm import runtime


def test_what_is_dropped_goes_back_to_the_machine(monkeypatch):
    """Only when a worker turns to another operator, and after the caches are cleared."""
    seen, cache = [], {"a": 1}
    monkeypatch.setattr(runtime, "_caches", [("one", cache.clear)])
    monkeypatch.setattr(runtime, "_entered", "one")
    real = runtime.give_back
    monkeypatch.setattr(runtime, "give_back", lambda: (seen.append(dict(cache)), real()))
    runtime.enter("one")
    assert cache and not seen
    runtime.enter("two")
    runtime.enter("two")
    assert seen == [{}]
