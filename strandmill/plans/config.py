"""Parameters of the assembly plan (defaults are fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    k: int = 21
    c: int = 11
    min_read_length: int = 1000
    min_overlap: int = 500
    quality_cutoff: float = 90.0
    high_frequency_share: int = 100_000
    high_frequency_floor: int = 100
    max_in_read: int = 500
    use_snpmers: bool = True
    strict_identity_pct: float = 100.0
    lax_identity_pct: float = 99.0
    strict_error: float = 0.0
    lax_error: float = 0.025
    contain_subsample: int = 4
    absolute_cut_ratio: float = 8.0
    relative_cut_ratio: float = 5.0
    long_overlap: int = 20_000
    small_bubble: int = 50_000
    tip_length: int = 20_000
    tip_reads: int = 3
    maximal_end_fuzz: int = 300
    reduction_fuzz: int = 750
    min_polish_quality: float = 75.0
    min_reads_contig: int = 1
    singleton_coverage: float = 3.0
    secondary_coverage: float = 1.0
    absolute_coverage: float | None = None
    derep_identity_pct: float = 99.0
    derep_length: int = 500_000
    hifi: bool = False
    slack: int = 20
    chain_gap: int = 200
    chain_double_gap: int = 10_000
    chain_min_anchors: int = 3
    min_chain_score: int = 150
    depth_sampling: int = 10
    depth_block: int = 50_000
    end_fuzz: int = 200
    hang_limit: int = 350
    window: int = 405
    window_overlap: int = 205
    polish_top: int = 75
    beam: int = 10

    @classmethod
    def nano_r9(cls) -> Config:
        return cls(k=17, c=7, lax_error=0.05, contain_subsample=2, absolute_cut_ratio=50.0, relative_cut_ratio=10.0, min_reads_contig=2)

    @classmethod
    def hifi_reads(cls) -> Config:
        return cls(hifi=True, slack=10)
