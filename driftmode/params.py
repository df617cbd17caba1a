"""Parameters of the filter and the segmentation, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Bandwidths are in pixels (``sigma_s``) and in LUV units (``sigma_r``)."""

    sigma_s: float = 7.0
    sigma_r: float = 6.5
    min_region: int = 20
    #: A centre has converged when the squared length of its shift is below this.
    epsilon: float = 0.01
    #: Window means that a pixel gets at most.
    limit: int = 100
    #: Past squared lengths that end a limit cycle: 0, 4 or 8.
    cycle_slots: int = 8
    #: Pixels belong to one region if every LUV channel differs by less than this.
    luv_threshold: float = 1.0
    #: Centres brighter than ``bright`` weigh differences of L fourfold.
    bright: float = 80.0
    #: Region modes closer than this (squared, in bandwidths) are fused.
    fuse_below: float = 0.25
    #: Edges of regions stronger than this part them, where edges have strengths.
    strength_below: float = 1.0
    #: The last pixel of a row touches the first one of the next row, as index arithmetic has it.
    wrap_rows: bool = True
    #: Fusion passes; None repeats them until nothing changes.
    fuse_passes: int | None = 2
    #: Bound of the pruning loop.
    prune_limit: int = 200
    edge_value: int = 0
    background_value: int = 255


DEFAULT = Params()
