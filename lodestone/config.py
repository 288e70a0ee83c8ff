"""The configuration of an index: defaults, validation, and one JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from lodestone.plans.ingest import SCOPES


@dataclass(frozen=True)
class Embedding:
    provider: str = "stub"
    model_id: str = "stub"
    dim: int = 8


@dataclass(frozen=True)
class Chunking:
    target_chars: int = 900
    overlap_chars: int = 150


@dataclass(frozen=True)
class Retrieval:
    top_n: int = 40
    top_k: int = 5
    min_score: float = 0.0


@dataclass(frozen=True)
class Config:
    """All settings; made only if they are valid."""

    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    default_scope: str = "global"
    audit: bool = True

    def __post_init__(self) -> None:
        positive = {"embedding.dim": self.embedding.dim, "chunking.target_chars": self.chunking.target_chars, "retrieval.top_n": self.retrieval.top_n, "retrieval.top_k": self.retrieval.top_k}
        wrong = [name for name, value in positive.items() if not _whole(value) or value < 1]
        if not _whole(self.chunking.overlap_chars) or self.chunking.overlap_chars < 0:
            wrong.append("chunking.overlap_chars")
        if isinstance(self.retrieval.min_score, bool) or not isinstance(self.retrieval.min_score, int | float) or not 0 <= self.retrieval.min_score <= 1:
            wrong.append("retrieval.min_score")
        if self.default_scope not in SCOPES:
            wrong.append("default_scope")
        if not isinstance(self.audit, bool):
            wrong.append("audit")
        wrong += [f"embedding.{n}" for n in ("provider", "model_id") if not isinstance(getattr(self.embedding, n), str) or not getattr(self.embedding, n)]
        if wrong:
            raise ValueError(f"invalid settings: {', '.join(wrong)}")


def _whole(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def load_or_init(path: str) -> Config:
    """The settings of a file, which is written with the defaults if it isn't there; unknown or invalid ones are an error."""
    file = Path(path)
    if not file.exists():
        save(Config(), path)
        return Config()
    try:
        raw = json.loads(file.read_text(encoding="utf-8"))
        return Config(**{name: {"embedding": Embedding, "chunking": Chunking, "retrieval": Retrieval}[name](**value) if isinstance(value, dict) else value for name, value in raw.items()})
    except (ValueError, TypeError, AttributeError, KeyError) as wrong:
        raise ValueError(f"{path}: {wrong}") from wrong


def save(config: Config, path: str) -> None:
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(asdict(config), indent=2) + "\n", encoding="utf-8")
