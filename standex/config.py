"""The engine's parameters, in one place for those who want to read them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from .functions import lexicons as lex
from .operators import index, neighbours, rank, search


@dataclass(frozen=True)
class Settings:
    """Values the operators use; as_dict() is what the introspection calls give."""

    dense_candidates: int = search.DENSE_K
    bm25_candidates: int = search.BM25_K
    rrf_constant: int = search.RRF_K
    default_k: int = search.TOP_K
    base_semantic_weight: float = search.SEMANTIC
    base_bm25_weight: float = search.LEXICAL
    bm25_k1: float = index.K1
    bm25_b: float = index.B
    bm25_epsilon: float = index.EPSILON
    neighbours_per_term: int = neighbours.TOP
    expansion_cap: str = "2x query length"
    rerank_candidates: int = rank.CANDIDATES
    rerank_chars: int = rank.MAX_CHARS
    number_boost: float = 1.2
    part_boost: tuple[float, float] = (1.1, 0.95)
    min_results: int = rank.LEAST
    max_truncated: int = rank.MOST
    gap_share: float = rank.GAP
    padding_share: float = rank.PAD
    max_results: int = rank.RESULTS
    lexicon_sizes: dict[str, int] = field(
        default_factory=lambda: {
            "abbreviations": len(lex.ABBREVIATIONS),
            "expansion_map": len(lex.EXPANSIONS),
            "category_signals": len(lex.CATEGORY_SIGNALS),
            "domain_hints": len(lex.DOMAIN_HINTS),
        }
    )

    def as_dict(self) -> dict[str, object]:
        return asdict(self)
