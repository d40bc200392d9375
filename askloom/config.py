"""Parameters, passed to each call; nothing reads module globals at run time."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 650
    overlap: int = 120
    min_length: int = 40

    def __post_init__(self):
        if self.overlap >= self.size:
            raise ValueError(f"overlap {self.overlap} must be less than size {self.size}")


@dataclass(frozen=True)
class ParentChildConfig:
    parent: ChunkConfig = ChunkConfig(1100, 220, 160)
    child: ChunkConfig = ChunkConfig(500, 120, 40)


@dataclass(frozen=True)
class CleanerConfig:
    min_length: int = 20
    trim_incomplete: bool = True


@dataclass(frozen=True)
class ExtractorConfig:
    max_sentence_words: int = 60
    position_weight: float = 0.1
    max_answer_sentences: int = 2


@dataclass(frozen=True)
class RetrievalConfig:
    k_dense: int = 40
    k_bm25: int = 20
    k_rerank: int = 10
    k_context: int = 8
    k_rrf: int = 60
    min_rerank_score: float = 0.05


#: Sizes of single-level chunks.
SINGLE_LEVEL = ChunkConfig(500, 120, 40)
