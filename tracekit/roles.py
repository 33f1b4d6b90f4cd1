"""Column roles of a table (what the configuration files of a dataset declare)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RoleSpec:
    metadata: tuple[str, ...] = ()
    timeseries: tuple[str, ...] = ()
    timestamp: str | None = None
    discrete: tuple[str, ...] = ()
    target: str | None = None
    session: str | None = None
    extra: dict = field(default_factory=dict)

    def require_timestamp(self) -> str:
        if self.timestamp is None:
            raise ValueError("this operator needs a timestamp column in the roles")
        return self.timestamp

    def numeric(self, columns: list[str]) -> list[str]:
        skip = set(self.discrete) | {self.target, self.session}
        return [c for c in columns if c not in skip]
