"""Settings, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

#: The default prompt: what the answer is to rest on, the passages, the question.
PROMPT = "\n\n".join(("Answer the question based on the following context.", "Context:\n{context}", "Question: {query}", "Answer:"))
METRICS = ("l2", "ip")


@dataclass(frozen=True)
class IndexConfig:
    """Of a vector index. m_max0 = 0 stands for 2 * m; cells and nprobe are those of the inverted-file index."""

    dim: int
    m: int = 32
    m_max0: int = 64
    ef_construct: int = 200
    ef_search: int = 200
    metric: str = "l2"
    seed: int = 42
    cells: int = 16
    nprobe: int = 4

    def __post_init__(self) -> None:
        if self.m_max0 == 0:
            object.__setattr__(self, "m_max0", 2 * self.m)
        if self.dim < 1:
            raise ValueError("dim must be positive")
        if not (2 <= self.m <= 255 and 1 <= self.m_max0 <= 255):
            raise ValueError("m must be 2..255 and m_max0 1..255")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        if self.nprobe < 1 or self.cells < 1:
            raise ValueError("cells and nprobe must be positive")


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in tokens of four characters. An overlap over half a chunk could make chunks stand still, so it's refused."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    separator: str = "\n\n"

    def __post_init__(self) -> None:
        if self.chunk_size < 1 or self.chunk_overlap < 0 or 2 * self.chunk_overlap > self.chunk_size:
            raise ValueError("chunk_size must be positive and chunk_overlap at most half of it")
        if not self.separator:
            raise ValueError("separator must not be empty")


@dataclass(frozen=True)
class PipelineConfig:
    """Of retrieval and generation. max_context_tokens cuts the context at four characters a token; None: no cut."""

    top_k: int = 10
    top_n: int = 3
    enable_rerank: bool = False
    max_context_tokens: int | None = None
    prompt_template: str = PROMPT
    system_message: str = ""

    def __post_init__(self) -> None:
        if self.top_k < 1 or self.top_n < 0:
            raise ValueError("top_k must be positive and top_n not negative")


@dataclass(frozen=True)
class BatchConfig:
    """Of request batching and calls to a language model."""

    max_batch_size: int = 32
    max_wait_us: int = 5000
    max_concurrent_llm_calls: int = 8
    llm_rate_limit: float = 60.0
    llm_rate_burst: float = 10.0

    def __post_init__(self) -> None:
        if self.max_batch_size < 1 or self.max_concurrent_llm_calls < 1:
            raise ValueError("batch size and concurrency must be positive")


@dataclass(frozen=True)
class EngineConfig:
    """All settings, with the flat names that a JSON file uses."""

    index: IndexConfig = field(default_factory=lambda: IndexConfig(dim=768))
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    pipeline: PipelineConfig = field(default_factory=PipelineConfig)
    batch: BatchConfig = field(default_factory=BatchConfig)
    embed_api_base: str = "https://api.openai.com/v1"
    embed_model: str = "text-embedding-3-small"
    llm_api_base: str = "https://api.openai.com/v1"
    llm_model: str = "gpt-4o-mini"
    api_key: str = ""

    @classmethod
    def of(cls, values: dict) -> EngineConfig:
        """From flat keys. Keys that aren't known are ignored, missing ones keep their default."""
        names = {"hnsw_m": "m", "hnsw_ef_construct": "ef_construct", "hnsw_ef_search": "ef_search", "embed_dim": "dim"}
        values = {names.get(k, k): v for k, v in values.items()}
        out = cls()
        parts = {}
        for part in ("index", "chunk", "pipeline", "batch"):
            own = getattr(out, part)
            parts[part] = replace(own, **{f.name: values[f.name] for f in fields(own) if f.name in values})
        own = {f.name: values[f.name] for f in fields(cls) if f.name in values and f.name not in parts}
        return replace(out, **parts, **own)

    @classmethod
    def load(cls, path: str) -> EngineConfig:
        """From a JSON file; RuntimeError if it can't be read or parsed."""
        try:
            with open(path, encoding="utf-8") as f:
                values = json.load(f)
        except (OSError, ValueError) as e:
            raise RuntimeError(f"no configuration in {path}: {e}") from e
        return cls.of(values)
