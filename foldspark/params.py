"""The engine's options, with their defaults and checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Params:
    # Input and output
    mm: tuple[str, ...] = ()
    output: str = "deconvolved.json"
    processors: int = 0
    whitelist: str | None = None
    shape: bool = False
    output_raw_n_clusters: bool = False
    log_level: str = "warn"
    # Mutation filtering
    min_base_coverage: int = 100
    min_base_mutations: int = 2
    min_mutation_freq: float = 0.005
    max_mutation_freq: float = 0.35
    min_read_mutations: int = 2
    # Detection of the number of clusters
    max_clusters: int = 1 << 30
    min_filtered_reads: int = 100
    min_permutations: int = 10
    max_permutations: int = 100
    ignore_first_eigengap: bool = False
    eigengap_cum_rel_thresh: float = 0.10
    eigengap_abs_thresh: float = 0.03
    alpha: float = 0.01
    beta: float = 0.2
    min_null_stdev: float = 0.025
    extra_permutations: int = 50
    min_win_bases: int = 10
    lookahead_eigengaps: int = 0
    save_eigengap_data: bool = False
    eigengap_data_out: str = "./eigengap_data"
    # Graph cut
    min_cluster_fraction: float = 0.005
    soft_clustering_inits: int = 500
    soft_clustering_iters: int = 50
    soft_clustering_weight_module: float = 0.005
    # Windows
    win_len: float = 100
    win_len_frac_rna_len: float = 0.0
    win_offset: float = 0.01
    max_ignore_wins: int = 0
    min_ext_wins: int = 6
    non_informative_to_surround: bool = False
    all_non_informative_to_one: bool = False
    report_non_informative: bool = False
    assignments_dump_dir: str | None = None
    skip_ambiguous_assignments: bool = False
    min_windows_overlap: float = 1.0
    # Not an option of a run's meaning: the seed of everything random.
    seed: int = 0

    def __post_init__(self):
        if self.max_clusters < 1:
            raise ValueError("max_clusters must be at least 1")
        if 1 < self.win_len < self.min_win_bases:
            raise ValueError("win_len must not be below min_win_bases")
        if not 0 < self.soft_clustering_weight_module <= 1:
            raise ValueError("soft_clustering_weight_module must be in (0, 1]")
        if self.log_level not in ("trace", "debug", "info", "warn", "error"):
            raise ValueError("log_level must be trace, debug, info, warn or error")
        if self.min_permutations > self.max_permutations:
            raise ValueError("min_permutations must not exceed max_permutations")

    def named(self) -> dict:
        """Every option under the name it has in the result document: in camel case, without the seed."""
        words = {name: name.split("_") for name in asdict(self) if name != "seed"}
        return {first + "".join(w.capitalize() for w in rest): getattr(self, name) for name, (first, *rest) in words.items()}

    def to_json(self) -> str:
        return json.dumps(self.named())
