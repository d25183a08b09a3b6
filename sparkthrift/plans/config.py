"""Settings of the request lifecycle, checked when they are made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "SPARKTHRIFT_"


@dataclass(frozen=True)
class Config:
    """Flags of ``lifecycle.outcomes``; a value that cannot work raises ValueError."""

    cache: bool = True
    ttl: float = 86_400.0
    salt: str = ""
    nocache: tuple[str, ...] = ()
    bypass_on_secret: bool = True
    lossless: bool = True
    filler: bool = False
    aggressive: bool = False
    structured: bool = False
    multi_tenant: bool = False
    allowed: tuple[str, ...] = ()
    rate: float = 0.0
    burst: float = 0.0
    verify_sample: float = 1.0
    similarity: bool = False
    similarity_threshold: float = 0.97
    similarity_embedder: str = "local"
    similarity_allow_lexical: bool = False
    similarity_entries: int = 2048
    learned_ratio: float = 0.5
    elide: bool = False
    elide_keep_recent: int = 4
    dedup: bool = False
    dedup_min_chars: int = 200
    memory: str = "off"
    memory_keep_recent: int = 4
    memory_retrieve: int = 3
    memory_summary_items: int = 5
    memory_min_messages: int = 8
    inject: bool = False
    inject_repeat_aware: bool = True
    inject_window: float = 300.0
    inject_least_tokens: int = 0
    encryption_key: bytes | None = None
    shredded: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        checks = {
            "rate and burst must not be negative": self.rate >= 0 and self.burst >= 0,
            "verify_sample and similarity_threshold lie in [0, 1]": 0 <= self.verify_sample <= 1 and 0 <= self.similarity_threshold <= 1,
            "learned_ratio lies in (0, 1]": 0 < self.learned_ratio <= 1,
            "an encryption key has 32 bytes": self.encryption_key is None or len(self.encryption_key) == 32,
            "shredded tenants need encryption and tenants": not self.shredded or (self.encryption_key is not None and self.multi_tenant),
            "the similarity embedder is local or hashing": not self.similarity or self.similarity_embedder in ("local", "hashing"),
            "a lexical embedder gives false hits and must be allowed": not self.similarity or self.similarity_embedder != "hashing" or self.similarity_allow_lexical,
            "memory is off, ingest, summary or retrieval": self.memory in ("off", "ingest", "summary", "retrieval"),
            "an allow-list needs tenants": not self.allowed or self.multi_tenant,
        }
        for told, holds in checks.items():
            if not holds:
                raise ValueError(told)

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> Config:
        """Reads SPARKTHRIFT_<NAME>; lists are separated by commas, keys are hex."""
        read = {"bool": lambda x: x.strip().lower() in ("1", "true", "yes", "on"), "float": float, "int": int, "str": str, "tuple[str, ...]": lambda x: tuple(y.strip() for y in x.split(",") if y.strip()), "bytes | None": bytes.fromhex}
        return cls(**{f.name: read[f.type](env[PREFIX + f.name.upper()]) for f in fields(cls) if PREFIX + f.name.upper() in env})
