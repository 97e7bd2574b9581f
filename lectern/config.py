"""Settings and their YAML file."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class FieldWeights:
    example: float = 0.5
    remarks: float = 1.0
    signature: float = 5.0
    symbol_name: float = 10.0


@dataclass(frozen=True)
class Config:
    db_path: str = "index"
    doc_sources: dict = field(default_factory=dict)
    chunk_max_chars: int = 2000
    top_k_default: int = 10
    candidate_expand_factor: int = 4
    rrf_k: int = 30
    rrf_bm25_weight: float = 2.0
    reranker_max_candidates: int = 30
    reranker_score_gap_threshold: float = 0.15
    code_boost_ratio: float = 1.2
    code_boost_triggers: tuple = ("how to", *"setup implement write sample example create".split())
    ref_expansion_max: int = 5
    query_rewrite_max_variants: int = 3
    context_max_tokens: int = 6000
    embed_dims: int = 64
    full_fields: bool = False  # True: example and remarks are searched as fields of their own
    metric: str = "l2sq"
    weights: FieldWeights = field(default_factory=FieldWeights)


def load_config(path: str | None = None) -> Config:
    """Defaults where the file has no value; relative paths are relative to the file."""
    import yaml

    base = Config()
    if path is None:
        return base
    file = Path(path)
    given = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
    known = {f.name for f in fields(Config)}
    values = {k: v for k, v in given.items() if k in known and k != "weights"}
    if "code_boost_triggers" in values:
        values["code_boost_triggers"] = tuple(values["code_boost_triggers"])
    weights = replace(base.weights, **{k: float(v) for k, v in (given.get("weights") or {}).items() if k in {f.name for f in fields(FieldWeights)}})
    at = lambda p: str(p if Path(p).is_absolute() or "://" in str(p) else file.parent / p)
    values["db_path"] = at(values.get("db_path", base.db_path))
    values["doc_sources"] = {k: at(v) for k, v in (values.get("doc_sources") or {}).items()}
    return replace(base, **values, weights=weights)


def save_config(config: Config, path: str) -> None:
    import yaml

    out = asdict(config)
    out["code_boost_triggers"] = list(config.code_boost_triggers)
    Path(path).write_text(yaml.safe_dump(out, sort_keys=False, allow_unicode=True), encoding="utf-8")
