"""Registered constants of the ranking, calibration, judging and serving rules."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any

# These must equal the published method for results to match.
DENSE_DIM = 384
INT8_SCALE = 127
SENTINEL_THRESHOLD = 1_000_000.0
CALIBRATION_METHOD = "cross-file-null-v3+offtopic-v1"
CALIBRATION_SEED = 20260926
CALIBRATION_QUERIES = 2000
CALIBRATION_LENGTHS = (2, 3, 4, 5)
CALIBRATION_QUANTILE = 0.9
REQUIRED_PERCENT = 80
TOP_OF_FILE = "(top of file)"
BLOCK_ID = "Q1"
PROMPT_ID = "answerability-judge-v1"
PROMPT_SHA256 = "24b244d230c465505b92fdf6c4be90be8e967897ad3d0aa8aeaf23bf5a159427"
BEST_SCORE_THRESHOLD = 0.67
ANSWERABLE = "ANSWERABLE"
NOT_ANSWERABLE = "NOT_ANSWERABLE"
JUDGE_ERROR = "JUDGE_ERROR"
NOTHING = "nothing to search for"


@dataclass(frozen=True)
class DenseParams:
    """Identity of the embedding model plus the constants of the dense list."""

    model: str = "BAAI/bge-small-en-v1.5"
    revision: str = "5c38ec7c405ec4b44b94cc5a9bb96e735b38267a"
    onnx_sha256: str = "828e1496d7fabb79cfa4dcd84fa38625c0d3d21da474a00f08db0f559940cf35"
    vocab_sha256: str = "07eced375cec144d27c900241f3e339478dec958f92fddbc551f295c992038a3"
    offtopic_sha256: str | None = None
    dim: int = DENSE_DIM
    pooling: str = "cls"
    normalize: bool = True
    max_tokens: int = 512
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    quantization: str = "int8-127"
    fusion: str = "rrf"
    rrf_k: int = 60
    fusion_depth: int = 100
    confidence: str = "dense-null-v3"


# These may differ between two stored indexes; every other parameter must match.
IDENTITY_FIELDS = ("model", "revision", "onnx_sha256", "vocab_sha256", "offtopic_sha256")


@dataclass(frozen=True)
class RankParams:
    tokenizer: str = "v2"
    stopwords: str = "nltk-english-179"
    stemmer: str = "porter-1980"
    ranking: str = "file-rrf-v1"
    k1: float = 1.2
    b: float = 0.75
    heading_weight: int = 2
    path_weight: int = 1
    top_k: int = 5
    per_file_cap: int = 2
    confidence: str = "none"
    embedding: DenseParams = field(default_factory=DenseParams)

    def as_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    def fingerprint(self) -> dict[str, Any]:
        """The part two indexes must share to be comparable."""
        out = self.as_dict()
        out["embedding"] = {k: v for k, v in out["embedding"].items() if k not in IDENTITY_FIELDS}
        return out


@dataclass(frozen=True)
class RerankParams:
    model: str = "cross-encoder/ms-marco-MiniLM-L6-v2"
    revision: str = "233902d25c440f23af6f7d6e94d2946bac0bee0a"
    candidates: int = 20
    max_tokens: int = 512
    max_question_tokens: int = 64
    scoring: str = "ce-maxp-shown-v1"


@dataclass(frozen=True)
class LimitParams:
    """Admission and spend rules of the question service."""

    max_question_chars: int = 500
    max_body_bytes: int = 16_384
    admitted_per_hour: int = 10
    retrievals_per_hour: int = 30
    window_seconds: int = 3600
    max_keys: int = 50_000
    clicks_per_hour: int = 60
    max_output_tokens: int = 1024
    framing_tokens: int = 64
    max_attempts: int = 2
    price_in_nano: int = 2000
    price_out_nano: int = 10_000
    max_reply_bytes: int = 4096
    max_question_bytes: int = 4096
    result_ttl_seconds: int = 600
    result_entries: int = 1000


DEFAULT_RANK = RankParams()
DEFAULT_RERANK = RerankParams()
DEFAULT_LIMITS = LimitParams()
