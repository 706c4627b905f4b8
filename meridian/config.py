"""Node configuration from TOML or from flags, checked when it is made."""

from __future__ import annotations

import argparse
import tomllib
from dataclasses import dataclass, fields

from meridian.operators.placement import VNODES


@dataclass(frozen=True)
class Config:
    node_id: int
    listen_addr: str = "0.0.0.0:7000"
    advertise_addr: str | None = None
    data_dir: str = "data"
    wal_batch_ms: int = 0
    snapshot_wal_mb: int = 128
    vnodes: int = VNODES

    def __post_init__(self):
        if self.vnodes <= 0:
            raise ValueError("vnodes must be positive")
        if self.snapshot_wal_mb <= 0:
            raise ValueError("snapshot_wal_mb must be positive")

    @property
    def advertise(self) -> str:
        """The address that others use, a host name or the one listened on."""
        return self.advertise_addr or self.listen_addr

    @classmethod
    def from_toml(cls, text: str) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in tomllib.loads(text).items() if k in known})

    @classmethod
    def from_flags(cls, args: list[str]) -> Config:
        p = argparse.ArgumentParser()
        for f in fields(cls):
            p.add_argument("--" + f.name.replace("_", "-"), type=int if "int" in str(f.type) else str, default=None)
        return cls(**{k: v for k, v in vars(p.parse_args(args)).items() if v is not None})
