"""Options of operators and writers, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RenderConfig:
    """What writers put out: speakers, word times (None: the format's custom), translation first."""

    include_speaker: bool = True
    word_level: bool | None = None
    translation_first: bool = False


@dataclass(frozen=True)
class StandardizationConfig:
    """Limits of standardised cues; seconds and characters."""

    min_duration: float = 0.8
    max_duration: float = 7.0
    min_gap: float = 0.08
    max_lines: int = 2
    max_chars_per_line: int = 42
    optimal_cps: float = 17.0
    start_margin: float | None = None
    end_margin: float | None = None
    margin_collision_mode: str = "trim"

    def __post_init__(self) -> None:
        wrong = [
            name
            for name, bad in (
                ("min_duration", self.min_duration <= 0),
                ("max_duration", self.max_duration <= self.min_duration),
                ("min_gap", self.min_gap < 0),
                ("max_lines", self.max_lines < 1),
                ("max_chars_per_line", self.max_chars_per_line < 10),
                ("start_margin", self.start_margin is not None and self.start_margin < 0),
                ("end_margin", self.end_margin is not None and self.end_margin < 0),
                ("margin_collision_mode", self.margin_collision_mode not in ("trim", "gap")),
            )
            if bad
        ]
        if wrong:
            raise ValueError(f"out of bounds: {', '.join(wrong)}")


@dataclass(frozen=True)
class VTTConfig:
    align: str | None = None
    vertical: str | None = None
    settings: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.align not in (None, "start", "center", "end", "left", "right"):
            raise ValueError(f"align: {self.align!r}")
        if self.vertical not in (None, "rl", "lr"):
            raise ValueError(f"vertical: {self.vertical!r}")


@dataclass(frozen=True)
class FrameRate:
    """Frames a second, and whether frame numbers are dropped."""

    fps: float = 25.0
    drop_frame: bool = False

    def __post_init__(self) -> None:
        if self.fps <= 0 or self.drop_frame and round(self.fps, 2) not in (29.97, 59.94):
            raise ValueError(f"no such rate: {self.fps} drop={self.drop_frame}")
