"""All parameters of the engine, with their defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Config:
    # The names and defaults of the parameters, and the stored tables' names below.
    input_folder: str = ""
    api_key: str = ""
    cache_root: str = ".cache"
    preprocess_workers: int = 1
    extract_workers: int = 1
    retry_limit: int = 1
    retry_initial_delay: float = 1.0
    retry_max_delay: float = 30.0
    api_base: str | None = None
    model: str = "gpt-4o-mini"
    temperature: float = 0.1
    qa_api_key: str | None = None
    qa_api_base: str | None = None
    qa_model: str = "gpt-4o"
    qa_temperature: float = 1.0
    db_path: str | None = None
    task_vectors_path: str | None = None
    dataset_vectors_path: str | None = None
    graph_path: str | None = None
    graph_processed_path: str | None = None
    graph_tasks_path: str | None = None
    strong_similarity_threshold: float = 0.8
    keyword_overlap_threshold: float = 0.7
    weak_similarity_threshold: float = 0.6
    task_max_merge: int = 10
    dataset_merge_k_neighbors: int = 10
    dataset_merge_similarity_threshold: float = 0.7
    llm_retries: int = 3
    llm_retry_delay: float = 10.0
    qa_search_rate: float = 2.0
    top_k_datasets: int = 5
    initial_k: int = 2
    similarity_threshold: float = 0.85
    min_seed_similarity: float = 0.6
    pagerank_alpha: float = 0.85
    other_seed_weight: float = 0.001
    score_offset: float = 0.1
    embedding_batch: int = 100
    embedding_dimension: int = 1536
    #: Injected services; None takes the deterministic built-in one.
    extractor: Callable | None = field(default=None, repr=False)
    #: The text of a PDF from its bytes.
    pdf_text: Callable[[bytes], str] | None = field(default=None, repr=False)
    embedder: Callable | None = field(default=None, repr=False)
    judge: Callable | None = field(default=None, repr=False)
    answerer: Callable | None = field(default=None, repr=False)

    def __post_init__(self):
        at = self.cache_root.rstrip("/")
        for name, last in {"db_path": "store", "task_vectors_path": "task_vectors", "dataset_vectors_path": "dataset_vectors", "graph_path": "original_kg", "graph_processed_path": "processed_kg", "graph_tasks_path": "tasks_kg"}.items():
            if getattr(self, name) is None:
                setattr(self, name, f"{at}/{last}")
        self.qa_api_key = self.qa_api_key or self.api_key
        self.qa_api_base = self.qa_api_base or self.api_base
        self.qa_search_rate = max(1.0, self.qa_search_rate)
