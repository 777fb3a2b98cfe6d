"""Job options. Defaults are the documented defaults of each step."""

from __future__ import annotations

from dataclasses import dataclass, field

from millrace.constants import EXCLUDED_SUBSTRINGS, LANGUAGE_BY_EXTENSION


@dataclass(frozen=True)
class ScanOptions:
    extensions: tuple[str, ...] = tuple(LANGUAGE_BY_EXTENSION)
    exclude: tuple[str, ...] = EXCLUDED_SUBSTRINGS
    exclude_mode: str = "substring"  # or "glob": of the path or of one of its parts
    max_size_kb: float = 500
    min_lines: int = 5


@dataclass(frozen=True)
class ChunkOptions:
    chunk_size: int = 1024
    overlap: int = 128

    def __post_init__(self):
        if self.chunk_size < 1:
            raise ValueError("chunk_size must be positive")
        if self.overlap >= self.chunk_size:
            raise ValueError("overlap must be smaller than chunk_size")

    @property
    def step(self) -> int:
        return self.chunk_size - self.overlap


@dataclass(frozen=True)
class SplitOptions:
    train: float = 0.9
    validation: float = 0.05
    seed: int = 42


@dataclass(frozen=True)
class BuildOptions:
    chunks: ChunkOptions = field(default_factory=ChunkOptions)
    split: SplitOptions = field(default_factory=SplitOptions)
    template: str = "instruction"
    merge_key: str = "hash"  # or "prefix"


@dataclass(frozen=True)
class TokenOptions:
    vocabulary_size: int = 32_768
    max_length: int = 2048
    stats_sample: int | None = None
    batch_size: int = 4


@dataclass(frozen=True)
class GenerationDefaults:
    max_new_tokens: int = 512
    temperature: float = 0.7
    top_p: float = 0.95
    top_k: int = 50
    repetition_penalty: float = 1.1
    do_sample: bool = True
    language: str = "python"
    complete_max_new_tokens: int = 256
    explain_max_new_tokens: int = 300
    explain_temperature: float = 0.3
