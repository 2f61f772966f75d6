"""Settings of a run: typed defaults, values from the environment, overrides per document, and the rules they must keep.

Every field can be set as ``FACTLOOM_<NAME>``. ``Settings`` are frozen; ``with_overrides`` gives new ones
(None leaves a field as it is), checked again as a whole.
"""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from factloom.functions import fixed


class SettingsError(ValueError):
    """All broken rules at once, joined by semicolons."""


_AGENTS = ("image_analyzer", "reference_extractor", "summarizer", "densifier", "decontextualizer", "concept_extractor", "community_summarizer", "profile_generator", "synthesizer", "critic", "entity_normalizer", "relation_normalizer")
_CHOICES = {
    "oversize_strategy": ("reject", "truncate", "sample"), "chunking_strategy": ("structural", "semantic"), "tool_use": ("auto", "always", "never"), "critic_strictness": ("low", "medium", "high"),
    "chunk_output_mode": ("files_only", "files_and_vectordb", "files_and_graphdb", "files_and_both_db"), "graph_merge_strategy": ("incremental", "replace"), "output_format": ("markdown", "json", "both"),
    "log_level": ("DEBUG", "INFO", "WARNING", "ERROR"), "log_format": ("json", "text"), "consolidator_trigger": ("on_ingestion", "scheduled", "manual"),
    "vector_store": ("none", "parquet"), "graph_store": ("none", "parquet"),
}


@dataclass(frozen=True)
class Settings:
    # models: provider:model; empty means the phase's, then the default
    model_default: str = "stub:default"
    model_temperature: float = 0.2
    model_max_tokens: int = 4096
    model_phases: dict[str, str] = field(default_factory=dict)
    model_agents: dict[str, str] = field(default_factory=dict)
    embedding_model: str = "stub:hash"
    embedding_dimensions: int = 128
    # documents
    max_document_size_mb: int = 50
    max_document_pages: int = 2000
    max_document_tokens: int = 500_000
    oversize_strategy: str = "reject"
    # chunks
    chunking_strategy: str = "structural"
    chunk_target_size: int = 2000
    chunk_overlap: int = 0
    chunk_output_mode: str = "files_only"
    # analysis
    decontextualization_enabled: bool = True
    tool_use: str = "auto"
    tool_confidence: float = 0.7
    density_iterations: int = 5
    confidence_threshold: float = 0.6
    critic_enabled: bool = False
    critic_strictness: str = "medium"
    # facts and graph
    entity_similarity: float = 0.85
    taxonomy_extensible: bool = True
    confidence_boost: bool = True
    community_resolution: float = 1.0
    community_min_size: int = 3
    profile_min_relations: int = 2
    community_summaries: bool = True
    profiles: bool = True
    weight_confidence: float = 0.3
    weight_salience: float = 0.3
    weight_freshness: float = 0.2
    weight_corroboration: float = 0.2
    corroboration_cap: int = 5
    graph_exports: tuple[str, ...] = ("graphml",)
    graph_store: str = "none"
    graph_merge_strategy: str = "incremental"
    # cache
    cache_enabled: bool = True
    cache_path: str = "cache"
    simhash_distance: int = 3
    # output
    output_path: str = "out"
    output_format: str = "both"
    batch_root: str = ""
    batch_recursive: bool = True
    batch_formats: tuple[str, ...] = tuple(fixed.FORMATS)
    # log
    log_level: str = "INFO"
    log_format: str = "json"
    log_file: str = ""
    log_rotation: str = "10MB"
    log_retention: int = 30
    # retrieval
    vector_store: str = "none"
    retrieval_enabled: bool = False
    retrieval_agents: tuple[str, ...] = tuple(sorted(fixed.ENRICHED))
    top_k_communities: int = fixed.TOP_K["community"]
    top_k_entities: int = fixed.TOP_K["entity"]
    top_k_chunks: int = fixed.TOP_K["chunk"]
    chunk_fallback: float = 0.6
    composite_weight: float = 0.3
    pagerank_teleport: float = 0.15
    context_tokens: int = fixed.CONTEXT_TOKENS
    corpus_in_context: bool = True
    # corpus
    consolidator_enabled: bool = False
    consolidator_trigger: str = "on_ingestion"
    consolidator_schedule: str = "0 3 * * 0"
    consolidator_passes: tuple[str, ...] = ("linking", "clustering", "inference", "decay", "contradiction")
    consolidator_half_life_days: float = fixed.CORPUS_HALF_LIFE_DAYS
    consolidator_least_confidence: float = 0.6
    consolidator_discount: float = 0.8
    consolidator_prune: float = 0.2
    consolidator_min_cluster: int = 3

    def __post_init__(self):
        if broken := list(self.broken_rules()):
            raise SettingsError("; ".join(broken))

    def broken_rules(self):
        for name, allowed in _CHOICES.items():
            if getattr(self, name) not in allowed:
                yield f"{name} must be one of {', '.join(allowed)}"
        vectors, graph = self.vector_store != "none", self.graph_store != "none"
        both = self.chunk_output_mode == "files_and_both_db"
        if (both or self.chunk_output_mode == "files_and_vectordb") and not vectors:
            yield "V-01: chunk_output_mode needs a vector store"
        if (both or self.chunk_output_mode == "files_and_graphdb") and not graph:
            yield "V-02: chunk_output_mode needs a graph store"
        if self.retrieval_enabled and not vectors and not graph:
            yield "V-03: retrieval needs a vector store or a graph store"
        if self.consolidator_enabled and not graph:
            yield "V-04: the consolidator needs a graph store"
        if not 0 <= self.chunk_overlap < self.chunk_target_size:
            yield "V-05: chunk_overlap must be at least 0 and under chunk_target_size"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "FACTLOOM_") -> Settings:
        """Fields from the environment; lists by commas, agents and phases as MODEL_AGENT_<NAME> and MODEL_PHASE_<NAME>."""
        env = os.environ if env is None else env
        values: dict = {}
        for f in dataclasses.fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                values[f.name] = _read(raw, str(f.type), f.name)
        for name, start in (("model_agents", "MODEL_AGENT_"), ("model_phases", "MODEL_PHASE_")):
            found = {k[len(prefix + start) :].lower(): v for k, v in env.items() if k.startswith(prefix + start) and v}
            if found:
                values[name] = found
        return cls(**values)

    def with_overrides(self, overrides: Mapping | None) -> Settings:
        """New settings in which the overrides that aren't None win."""
        given = {k: v for k, v in (overrides or {}).items() if v is not None}
        if unknown := sorted(set(given) - {f.name for f in dataclasses.fields(self)}):
            raise SettingsError(f"unknown settings: {', '.join(unknown)}")
        return dataclasses.replace(self, **given) if given else self

    def model_for(self, agent: str, phase: str = "") -> tuple[str, str]:
        """(provider, model) of an agent: its own setting, its phase's, the default."""
        chosen = self.model_agents.get(agent) or self.model_phases.get(phase) or self.model_default
        provider, _, model = chosen.partition(":")
        return provider, model


def _read(raw: str, kind: str, name: str):
    try:
        if kind == "bool":
            low = raw.strip().lower()
            if low not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
                raise ValueError(raw)
            return low in ("1", "true", "yes", "on")
        if kind == "int":
            return int(raw)
        if kind == "float":
            return float(raw)
    except ValueError as e:
        raise SettingsError(f"{name} is no {kind}: {raw}") from e
    if kind.startswith("tuple"):
        return tuple(x.strip() for x in raw.split(",") if x.strip())
    return raw
