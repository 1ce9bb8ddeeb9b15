from __future__ import annotations

import numpy as np

from fundtrace.llm import op7_toxicity_crf as op7
from fundtrace.llm import store


def test_the_stage_gives_the_training_memory_back_before_it_goes_on(monkeypatch):
    steps = []
    monkeypatch.setattr(op7, "documents", lambda *a: None)
    monkeypatch.setattr(op7, "training_rows", lambda *a: None)
    monkeypatch.setattr(op7, "fit", lambda *a: steps.append("fit"))
    give_back = op7.give_back
    monkeypatch.setattr(op7, "give_back", lambda: (give_back(), steps.append("given back")))
    monkeypatch.setattr(op7, "keep_below", lambda *a: steps.append("filter"))
    op7.stage(None, None, "")
    assert steps == ["fit", "given back", "filter"]


def test_freed_arrays_go_back_to_the_system():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    # A small block at the end of the heap keeps the freed ones before it with the process.
    arrays = [np.ones(12_000) for _ in range(3000)]
    pin = np.ones(12_000)
    before = resident()
    arrays = None
    store.trim()
    assert pin[0] == 1 and resident() < before - 200
