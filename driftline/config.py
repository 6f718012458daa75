"""Options of the engine."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, fields

from driftline.errors import InvalidInputError


@dataclass(frozen=True)
class Config:
    """``buffer_capacity`` counts in the statistics; ``tie`` is who wins at equal times; ``envelope`` as in radius queries."""

    buffer_capacity: int = 100
    tie: str = "last"
    envelope: str = "reference"
    replay_batches: int = 2

    def __post_init__(self) -> None:
        if self.buffer_capacity < 1 or self.replay_batches < 1:
            raise InvalidInputError("capacities must be positive")
        if self.tie not in ("last", "first") or self.envelope not in ("reference", "exact"):
            raise InvalidInputError("unknown tie or envelope mode")

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise InvalidInputError(f"unknown options: {sorted(unknown)}")
        return cls(**values)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls.from_dict(json.loads(text))

    @classmethod
    def from_toml(cls, text: str) -> Config:
        return cls.from_dict(tomllib.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self))
