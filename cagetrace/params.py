"""Run parameters as frozen dataclasses (never column metadata)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CleanParams:
    """Cleaning and derivation options of the clean-and-derive job."""

    fps: int = 20
    rm_z_outlier: bool = False
    z_threshold: float = 3.0
    rm_cage_outlier: bool = False
    cage_scale_threshold: float = 1.1
    cage_width: float = 380.0
    cage_height: float = 225.0
    ids: tuple[int, ...] = (1, 2, 3, 4)

    def __post_init__(self):
        if self.fps < 1:
            raise ValueError("fps must be a positive row count")
        if len(set(self.ids)) != len(self.ids) or len(self.ids) < 2:
            raise ValueError("ids must be at least two distinct subject ids")

    @property
    def z_rows(self) -> int:
        """Centred z window: two seconds of frames."""
        return 2 * self.fps


@dataclass(frozen=True)
class SweepParams:
    """Grid of the batch sweep: windows x bin widths x thresholds."""

    windows: tuple[float, ...] = (30, 60, 90)
    bin_within: float = 90
    bin_widths: tuple[int, ...] = (5, 10, 15, 30)
    thresholds: tuple[float, ...] = (20,)
    activity: bool = True
    distance: bool = True
    interaction: bool = True

    def __post_init__(self):
        if any(w != int(w) or w < 1 for w in self.bin_widths):
            raise ValueError("bin widths must be whole minutes")   # 2 and 2.5 would share a column value
        for w in self.bin_widths:
            if self.bin_within < w:
                # the reference would emit a bin at -w here
                raise ValueError(f"bin width {w} exceeds bin_within {self.bin_within}")
        if not self.windows or not self.bin_widths or not self.thresholds:
            raise ValueError("windows, bin_widths and thresholds must be non-empty")

    def regular_bins(self, width: int) -> list[int]:
        """Bin starts every subject gets: 0, w, ... up to (within div w - 1) * w."""
        last = (int(self.bin_within // width) - 1) * width
        return list(range(0, last + 1, width))


@dataclass(frozen=True)
class StudyDesign:
    """Two-group comparison: column, the two values, optional pair key."""

    comp_col: str
    comparison: tuple[str, str]
    paired_col: str | None = None

    def __post_init__(self):
        if len(self.comparison) != 2:
            raise ValueError(f"two groups are compared, not {len(self.comparison)}")
        if self.comparison[0] == self.comparison[1]:
            raise ValueError("the two groups must differ")


# Parameters of the fixture views derived from the driver tables
# (FIXTURES.md section 4): 0.5 s frames, fps 10 as a row count.
FIXTURE_CLEAN = CleanParams(fps=10)
FIXTURE_SWEEP = SweepParams(
    windows=(2, 4), bin_within=4, bin_widths=(1, 2), thresholds=(20, 40)
)
FIXTURE_UNPAIRED = StudyDesign("line", ("A", "B"))
FIXTURE_PAIRED = StudyDesign("drug", ("CNO", "SAL"), paired_col="mouse")
