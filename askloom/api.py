"""The names that jobs usually need, in one place."""

from .config import (
    ChunkConfig,
    CleanerConfig,
    ExtractorConfig,
    ParentChildConfig,
    RetrievalConfig,
)
from .functions.text import clean_chunk, clean_text, split_sentences
from .models import (
    EMBEDDERS,
    GENERATORS,
    MODELS,
    RERANKERS,
    TRACERS,
    BatchGenerator,
    ExtractiveGenerator,
    HashingEmbedder,
    JsonTracer,
    ModelError,
    OverlapReranker,
    Remote,
    RemoteEmbedder,
    RemoteGenerator,
    RemoteReranker,
    Tracer,
    Validator,
    create,
    model_name,
    observed,
)
from .operators.agent import rewritten_by, run_agent
from .operators.chunking import build_chunks
from .operators.dense import dense_topk
from .operators.extract import extract_answers
from .operators.index import build_index, dedup_first
from .operators.lexical import bm25_topk, build_lexical_index
from .operators.pruned import bm25_pruned_topk, build_impacts
from .operators.sparse import build_sparse_index, sparse_topk
from .plans.batches import answer_in_batches
from .plans.evaluation import analyze_answers, evaluate_answers
from .plans.retrieval import hybrid_search, retrieve, run_pipeline
from .sources.documents import page_elements
from .sources.store import KeyedTable, StoreError, VectorStore, store_search
from .sources.tables import (
    DocumentLoadError,
    load_document,
    load_documents,
    load_elements,
    load_index,
    save_index,
)
from .tracing import SpanTracer

__all__ = [
    "BatchGenerator", "ChunkConfig", "CleanerConfig", "DocumentLoadError", "EMBEDDERS", "ExtractiveGenerator", "ExtractorConfig",
    "GENERATORS", "HashingEmbedder", "JsonTracer", "KeyedTable", "MODELS", "ModelError", "OverlapReranker", "ParentChildConfig",
    "RERANKERS", "Remote", "RemoteEmbedder", "RemoteGenerator", "RemoteReranker", "RetrievalConfig", "SpanTracer", "StoreError",
    "TRACERS", "Tracer", "Validator", "VectorStore", "analyze_answers", "answer_in_batches", "bm25_pruned_topk", "bm25_topk",
    "build_chunks", "build_impacts", "build_index", "build_lexical_index", "build_sparse_index", "clean_chunk", "clean_text", "create",
    "dedup_first", "dense_topk", "evaluate_answers", "extract_answers", "hybrid_search", "load_document", "load_documents",
    "load_elements", "load_index", "model_name", "observed", "page_elements", "retrieve", "rewritten_by", "run_agent", "run_pipeline",
    "save_index", "sparse_topk", "split_sentences", "store_search",
]
