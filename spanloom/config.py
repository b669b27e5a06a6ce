"""Constants of the summariser. Values marked fixed decide results and are the same in every deployment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Sizes, weights and thresholds of every step."""

    chunk_chars: int = 1200
    chunk_overlap: int = 1
    chunk_ceiling: int = 2400
    top_k: int = 8
    top_k_max: int = 32
    dense_weight: float = 0.65
    flat_range: float = 1e-9
    summary_ratio: float = 0.25
    summary_least: int = 3
    summary_most: int = 15
    aspect_floor: float = 0.25
    mmr_lambda: float = 0.7
    min_sentence: int = 40
    align_threshold: float = 0.45
    align_dense_weight: float = 0.5
    align_spans: int = 3
    align_margin: float = 0.08
    min_quote: int = 12
    block_rows: int = 100
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    verified_tokens: int = 4096
    verified_escalations: int = 2
    verified_ceiling: int = 16384
    api_tokens: int = 8000
    local_tokens: int = 1024
    remote_tokens: int = 2048
    retries: int = 12
    longest_wait: float = 90.0
    least_wait: float = 8.0
    longest_daily_wait: float = 7200.0
    timeout: float = 120.0


SETTINGS = Settings()

#: Most sentences of an extractive summary by length preset; None leaves it to the ratio.
LENGTH_SENTENCES = {"brief": 4, "standard": 8, "full": None}
DEFAULT_LENGTH = "full"

#: Aspect queries by preset.
ASPECTS = {
    "generic": [
        "main topic, purpose and central claim",
        "key findings, results and figures",
        "background, context and prior work",
        "methods, process and how it was done",
        "conclusions, recommendations and next steps",
        "limitations, risks, caveats and exceptions",
    ],
    "clinical": [
        "patient age, sex, and presenting complaint",
        "history of present illness and symptom timeline",
        "past medical history, medications and allergies",
        "physical examination findings and vital signs",
        "laboratory results, imaging and diagnostic tests",
        "diagnosis and differential diagnosis",
        "treatment, procedures, medications given",
        "clinical course, outcome, and discharge disposition",
    ],
}

#: Words whose period ends no sentence.
ABBREVIATIONS = frozenset("""
dr drs mr mrs ms prof st mt sr jr
vs etc eg ie cf al fig figs ref refs dept approx est vol ch pp sec
jan feb mar apr jun jul aug sep sept oct nov dec
inc ltd co corp univ hosp assn
""".split())

#: Languages and splits of the paired corpus archives.
LANGUAGES = ("en", "es", "fr", "pt")


def aspect_queries(aspects: str | list[str]) -> list[str]:
    """A preset by name, or the caller's own queries. An unknown name is a KeyError."""
    return list(ASPECTS[aspects]) if isinstance(aspects, str) else list(aspects)


def sentence_cap(max_sentences: int | None, length: str | None) -> int | None:
    """An explicit cap wins (0 counts as none), then the preset's; None leaves the ratio to decide."""
    name = length or DEFAULT_LENGTH
    if name not in LENGTH_SENTENCES:
        raise ValueError(f"length is one of {sorted(LENGTH_SENTENCES)}, not {name!r}")
    return max_sentences or LENGTH_SENTENCES[name]
