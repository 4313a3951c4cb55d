import json

import pytest

from tarnwell.config import BatchConfig, ChunkConfig, EngineConfig, IndexConfig, PipelineConfig


def test_index_limits():
    assert IndexConfig(dim=4, m=8, m_max0=0).m_max0 == 16 and IndexConfig(dim=4, m=8).m_max0 == 64
    for bad in ({"dim": 0}, {"dim": 4, "m": 256}, {"dim": 4, "m_max0": 256}, {"dim": 4, "m": 1}, {"dim": 4, "metric": "cos"}, {"dim": 4, "nprobe": 0}):
        with pytest.raises(ValueError):
            IndexConfig(**bad)


def test_chunks_that_would_stand_still_are_refused():
    for bad in ((0, 0), (4, 3), (8, -1)):
        with pytest.raises(ValueError):
            ChunkConfig(*bad)
    with pytest.raises(ValueError):
        ChunkConfig(separator="")
    with pytest.raises(ValueError):
        PipelineConfig(top_k=0)
    with pytest.raises(ValueError):
        BatchConfig(max_batch_size=0)


def test_json(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"hnsw_m": 16, "embed_dim": 64, "top_k": 7, "chunk_size": 100, "chunk_overlap": 10, "llm_rate_limit": 5, "unknown": 1, "api_key": "k"}))
    c = EngineConfig.load(str(f))
    assert (c.index.m, c.index.dim, c.index.ef_search, c.pipeline.top_k, c.pipeline.top_n, c.chunk.chunk_size, c.batch.llm_rate_limit, c.api_key) == (16, 64, 200, 7, 3, 100, 5, "k")
    assert EngineConfig() == EngineConfig.of({})
    f.write_text("{")
    for path in (f, tmp_path / "none"):
        with pytest.raises(RuntimeError):
            EngineConfig.load(str(path))
