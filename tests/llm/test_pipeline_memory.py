"""The pipeline's packing runs where other stages' memory is still held."""

import corpus_pipeline


def test_pipelines_tables_are_small(monkeypatch):
    seen = {}
    monkeypatch.setattr(corpus_pipeline, "pack", lambda *a, **more: seen.update(more))
    corpus_pipeline.packing(None, None, "")
    assert seen["chunks"] <= 50_000
