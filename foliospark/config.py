"""Run options; unknown keys and values are refused."""

from __future__ import annotations

from dataclasses import dataclass, fields
from hashlib import sha256
from json import dumps

CHOICES = {"page_furniture": ("off", "drop", "extract"), "overlaid_text": ("auto", "keep", "drop")}


@dataclass(frozen=True)
class RunConfig:
    page_furniture: str = "drop"
    overlaid_text: str = "auto"
    include_source_path: bool = False
    debug: bool = False
    render: bool = True

    def __post_init__(self) -> None:
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        for f in fields(self):
            if f.name not in CHOICES and not isinstance(getattr(self, f.name), bool):
                raise TypeError(f"{f.name} must be true or false")

    @classmethod
    def of(cls, options: dict) -> RunConfig:
        unknown = set(options) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**options)

    @property
    def digest(self) -> str:
        return sha256(dumps({f.name: getattr(self, f.name) for f in fields(self)}).encode()).hexdigest()
