"""Settings of a preparation, checked on the driver before any file is read."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

FILTERS = ("nearest", "triangle", "catmull-rom", "gaussian", "lanczos3", "max-pool")
ALIASES = {"catmull": "catmull-rom", "catmullrom": "catmull-rom", "maxpool": "max-pool", "lanczos": "lanczos3"}
PADDINGS = ("zero", "top-left", "bottom-right", "center")
HANDLERS = ("keep", "central-slice", "max-intensity", "interpolate", "laplacian-mip")


def filter_name(name: str) -> str:
    name = ALIASES.get(name.lower(), name.lower())
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name!r}")
    return name


@dataclass(frozen=True)
class Handler:
    """What happens to the frames of a volume."""

    kind: str = "keep"
    skip_start: int = 0
    skip_end: int = 0
    target_frames: int | None = None
    mip_weight: float = 1.5
    projection: str = "parallel-beam"

    def __post_init__(self) -> None:
        if self.kind not in HANDLERS:
            raise ValueError(f"unknown handler {self.kind!r}")
        if self.projection not in ("parallel-beam", "central-slice"):
            raise ValueError(f"unknown projection {self.projection!r}")
        if min(self.skip_start, self.skip_end) < 0:
            raise ValueError("skipped frames can't be negative")
        if self.kind == "interpolate" and (self.target_frames is None or self.target_frames < 1):
            raise ValueError("interpolation needs target_frames of 1 or more")


@dataclass(frozen=True)
class Preprocessor:
    """Crop, size or spacing, padding, volume handling, windowing."""

    crop: bool = True
    crop_max: bool = True
    components: bool = False
    border: float | None = None
    size: tuple[int, int] | None = None
    spacing: tuple[float, float, float | None] | None = None
    filter: str = "triangle"
    padding: str = "zero"
    use_padding: bool = True
    handler: Handler = field(default_factory=Handler)
    voi: str | tuple[float, float] = "default"
    strict: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "filter", filter_name(self.filter))
        if self.size is not None and self.spacing is not None:
            raise ValueError("give a size or a spacing, not both")
        if self.size is not None and min(self.size) < 1:
            raise ValueError("a size is 1 or more")
        if self.spacing is not None and not all(s is None or (math.isfinite(s) and s > 0) for s in self.spacing):
            raise ValueError("spacings are finite and above 0")
        if self.border is not None and not (math.isfinite(self.border) and 0 <= self.border <= 0.5):
            raise ValueError("a border lies in 0..0.5")
        if self.padding not in PADDINGS:
            raise ValueError(f"unknown padding {self.padding!r}")
        if not (self.voi in ("default", "normalize") or isinstance(self.voi, tuple) and len(self.voi) == 2):
            raise ValueError("voi is default, normalize or (centre, width)")
