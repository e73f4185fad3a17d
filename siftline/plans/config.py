"""Settings of a selection, validated and fingerprinted."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    max_experience: int = 2
    max_projects: int = 3
    max_skills: int = 6
    max_education_extra: int = 1
    max_highlights: int = 4
    max_keywords: int = 10
    use_reranker: bool = True
    use_stemming: bool = True
    channel_depth: int = 50
    rerank_depth: int = 30
    rrf_k: int = 15
    sparse_weight: float = 1.0
    dense_weight: float = 1.0
    keyword_weight: float = 0.5
    mmr_balance: float = 0.7
    critical_frequency: int = 2
    max_coverage_swaps: int = 3
    negation_factor: float = 0.3
    cache_hours: float = 24.0
    lines_per_page: int = 45
    custom_keywords: tuple[str, ...] = ()

    def errors(self) -> list[str]:
        """What is out of range, as messages."""
        out = [f"{n} must be 0 or more" for n in ("max_experience", "max_projects", "max_skills", "max_education_extra", "max_highlights", "max_keywords", "max_coverage_swaps") if getattr(self, n) < 0]
        out += [f"{n} must be 1 or more" for n in ("channel_depth", "rerank_depth", "rrf_k", "critical_frequency", "lines_per_page") if getattr(self, n) < 1]
        out += [f"{n} must not be negative" for n in ("sparse_weight", "dense_weight", "keyword_weight") if getattr(self, n) < 0]
        out += [f"{n} must lie within 0 and 1" for n in ("mmr_balance", "negation_factor") if not 0 <= getattr(self, n) <= 1]
        if not self.sparse_weight + self.dense_weight + self.keyword_weight:
            out.append("one channel's weight must be above 0")
        return out

    def fingerprint(self) -> str:
        """SHA-256 over the settings that a selection depends on, in canonical JSON."""
        return canonical_hash({k: v for k, v in asdict(self).items() if k not in ("cache_hours", "lines_per_page")})


def canonical_hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Defaults, under the file's values, under SIFTLINE_<NAME> of the environment; unknown names are dropped."""
    known, values = {f.name: f for f in fields(Settings)}, {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            values |= {k: v for k, v in json.load(f).items() if k in known}
    for name in known:
        if (raw := (os.environ if environment is None else environment).get(f"SIFTLINE_{name.upper()}")) is not None:
            values[name] = json.loads(raw) if name != "custom_keywords" else [x.strip() for x in raw.split(",") if x.strip()]
    if "custom_keywords" in values:
        values["custom_keywords"] = tuple(values["custom_keywords"])
    return replace(Settings(), **values)


def save(settings: Settings, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, ensure_ascii=False, indent=2)
