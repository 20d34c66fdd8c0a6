"""Run-time settings of a load analysis.

One frozen record replaces the parameter file of the original tool; every
operator takes the fields it needs as arguments, so a job never reads global
state. Defaults are ours (the original ships no parameter file).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Resolution codes understood by the resampler and the period operators.
PERIODS = ("H", "D", "W", "M", "Q", "Y")


@dataclass(frozen=True)
class LoadConfig:
    # grid the readings are resampled to on load: a period code or "<N>min"
    time_resolution: str = "H"
    # "energy" -> readings are summed per bin, "power" -> averaged
    input_type: str = "energy"
    # the stamp of a reading marks the END of its interval
    measurement_is_before_index: bool = True
    # wide layout: one row per day, 96 quarter-hour columns
    custom_data_load: bool = False
    # if False, a reading of exactly 0 counts as missing
    zero_values_are_ok: bool = True
    # interpolate + forward fill missing readings before resampling
    fill_zero_energy_to_previous: bool = False
    # also back fill (the spreadsheet ingest policy)
    back_fill: bool = False
    # how a bin sum treats missing readings: "skip" (delimited-file policy)
    # or "propagate" (spreadsheet policy and re-sampling of a loaded series)
    null_sum: str = "skip"
    # drop zero readings from the filtered view
    drop_zero_energy: bool = False
    # distribution over loads on the timestamps common to all loads
    same_count: bool = True
    # business calendar: weekdays (Mon=0) and [start, end) hours
    business_days: tuple[int, ...] = (0, 1, 2, 3, 4)
    business_hours: tuple[int, int] = (8, 16)
    number_of_rows_to_print_for_head: int = 5
    # sink policy
    results_overwrite: bool = True
    type_of_tabular_output_file: str = "csv"
    # comparison formulas: "reference" reproduces the original tool's
    # (inconsistent) percent formulas and labels, "consistent" uses
    # (a-b)/(eps+a)*100 everywhere with matching labels
    percent_mode: str = "reference"
    # block used to split one series for the fill windows (see operators.fill)
    fill_block: str = "day"
    # largest per-series / per-key side that is broadcast after a check of its
    # rows and bytes (64 a row: about 32 MB)
    broadcast_max_rows: int = 500_000

    def with_(self, **kw) -> "LoadConfig":
        return replace(self, **kw)

    def __post_init__(self):
        if self.input_type not in ("energy", "power"):
            raise ValueError(f"input_type must be 'energy' or 'power', got {self.input_type!r}")
        if self.null_sum not in ("skip", "propagate"):
            raise ValueError(f"null_sum must be 'skip' or 'propagate', got {self.null_sum!r}")
        if self.percent_mode not in ("reference", "consistent"):
            raise ValueError(f"percent_mode must be 'reference' or 'consistent', got {self.percent_mode!r}")


DEFAULT = LoadConfig()
