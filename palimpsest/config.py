"""Options of a replica, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

MODES = ("auto", "review", "push", "pull")


@dataclass(frozen=True)
class SyncConfig:
    """Who we are, what is synchronised and within which limits."""

    user_id: str = "u0"
    room: str = "default"
    mode: str = "auto"
    sync_metadata: bool = True
    sync_tags: bool = True
    sync_notes: bool = True
    sync_selections: bool = True
    sync_transcriptions: bool = True
    sync_lists: bool = False
    sync_photo_adjustments: bool = False
    sync_deletions: bool = False
    add_wins: bool = False
    # fixed values: limits in UTF-16 units, entries and days
    max_note_size: int = 1_048_576
    max_metadata_size: int = 65_536
    max_backup_size: int = 10_485_760
    flood_minimum: int = 20
    flood_ratio: float = 0.5
    fuzzy_threshold: float = 0.5
    tombstone_days: int = 30
    max_failures: int = 3
    activity_kept: int = 200

    @classmethod
    def from_options(cls, options: dict) -> SyncConfig:
        """Options as they come (strings for numbers and booleans, unknown names, nulls) made typed."""
        known = {f.name: f for f in fields(cls)}
        out = {}
        for name, value in options.items():
            if name not in known or value is None:
                continue
            default = known[name].default
            if isinstance(default, bool):
                out[name] = value.strip().lower() in ("true", "1", "yes") if isinstance(value, str) else bool(value)
            elif isinstance(default, int | float):
                try:
                    out[name] = type(default)(float(value))
                except (TypeError, ValueError):
                    continue
            else:
                out[name] = str(value)
        if out.get("mode", "auto") not in MODES:
            out["mode"] = "auto"
        return cls(**out)

    @property
    def pushes(self) -> bool:
        return self.mode != "pull"

    @property
    def applies(self) -> bool:
        return self.mode == "auto"
