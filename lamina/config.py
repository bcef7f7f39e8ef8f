"""Settings with their defaults; environment variables with the prefix LAMINA_ override them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1800
    child_size: int = 800
    child_overlap: int = 100
    repetition_share: float = 0.7
    most_blank_lines: int = 2
    spaced_share: float = 0.4
    pdf_min_chars: int = 50
    pdf_scanned_share: float = 0.5
    pdf_sample_pages: int = 10
    embedding_dim: int = 1024
    embedding_batch: int = 32
    top_k: int = 5
    threshold: float = 0.3
    rrf_k: int = 60
    pool: int = 60
    children: int = 20
    rerank_top: int = 3
    facts_chars: int = 12000
    text_config: str = "spanish"
    #: Names of standard rules that are left out, separated by commas.
    rules_off: str = ""

    @staticmethod
    def from_env() -> Settings:
        named = {f.name: os.environ.get(f"LAMINA_{f.name.upper()}") for f in fields(Settings)}
        out = Settings(**{k: type(getattr(Settings, k))(v) for k, v in named.items() if v is not None})
        if out.text_config not in ("simple", "spanish") or not 1 <= out.rerank_top <= 10 or not 0 <= out.threshold <= 1 or out.child_overlap >= out.child_size or min(out.chunk_size, out.child_size, out.embedding_dim) < 1:
            raise ValueError(f"settings out of range: {out}")
        return out
