"""Settings of privatized queries."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field, fields, replace

# Fixed value: the odd constant that seeds and hashes are mixed with.
MAGIC = 2983746509182734091
MASK64 = (1 << 64) - 1


@dataclass
class PrivacyConfig:
    privacy_mode: str = "pac"  # or dp_elastic
    pac_mi: float = 1 / 128  # bound on mutual information; 0 gives deterministic answers without noise
    privacy_seed: int | None = None
    privacy_noise: bool | None = None
    privacy_min_group_count: float | None = None
    pac_diffcols: str | None = None
    dp_epsilon: float = 1.0
    dp_delta: float | None = None
    dp_sum_bound: float | None = None
    pac_check: bool = True
    pac_rewrite: bool = True
    pac_join_elimination: bool = True
    pac_conservative_mode: bool = True
    pac_categorical: bool = True
    pac_select: bool = True
    pac_pushdown_topk: bool = True
    pac_topk_expansion: float = 1.0
    pac_hash_repair: bool = False
    pac_ctas: bool = True
    pac_ptracking: bool = True
    pac_ptracking_partitions: int = 1  # tasks with a posterior each, which share the bound
    pac_clip_support: int | None = None
    pac_clip_scale: bool = False
    pac_hash: str = "xxhash64"  # or md5, which other engines can reproduce
    secret: int = field(default_factory=lambda: secrets.randbits(64), repr=False)  # seeds what no privacy_seed does
    salt: int = 0  # of one query, so that no two queries share draws

    def set(self, name: str, value) -> None:
        if name not in {f.name for f in fields(self)} - {"secret", "salt"}:
            raise ValueError(f"Unknown setting '{name}'")
        if name == "privacy_mode":
            value = str(value).strip().lower()
            if value not in ("pac", "dp_elastic"):
                raise ValueError("privacy_mode must be 'pac' or 'dp_elastic'")
        setattr(self, name, value)

    def for_query(self, fingerprint: int) -> PrivacyConfig:
        """The settings as one query sees them. Deterministic answers (a bound of 0) have no draws to keep apart."""
        exact = self.pac_mi <= 0 if self.privacy_mode == "pac" else self.privacy_noise is False
        return replace(self, salt=0 if exact else fingerprint)

    @property
    def seed(self) -> int:
        """The set one; else a secret one, or a fixed one where nothing is drawn."""
        if self.privacy_seed is not None:
            return int(self.privacy_seed)
        return 42 if self.pac_mi <= 0 else self.secret

    @property
    def query_hash(self) -> int:
        """Unsigned 64-bit; chooses the secret world, scrambles key hashes and seeds the draws. Retries and repeats of a query
        have the same one, other queries have others."""
        salted = (self.salt * 0x9E3779B97F4A7C15) & MASK64
        return ((self.seed * MAGIC) ^ MAGIC ^ salted ^ salted >> 29) & MASK64

    @property
    def query_hash_signed(self) -> int:
        return signed(self.query_hash)

    @property
    def secret_world(self) -> int:
        return self.query_hash % 64


def signed(x: int) -> int:
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x
