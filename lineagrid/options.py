"""All parameters of a lineage assignment, with their checks."""

from __future__ import annotations

from dataclasses import dataclass, fields

MODES = ("progressive", "average")


@dataclass(frozen=True)
class LineageOptions:
    """Distances, grouping, column names and naming. Column keys that are None are looked up (X:0, then X).

    precluster groups the sequences of a group around centroids of at least preclustering_threshold identity first;
    preclustering_key is the column that is compared (None: the CDR3). Only sequences of one precluster are linked.
    """

    distance_cutoff: float = 0.35
    shared_mutation_bonus: float = 0.35
    length_penalty_multiplier: float = 2.0
    group_by_v: bool = True
    group_by_j: bool = True
    group_by_light_chain_vj: bool = True
    id_key: str | None = None
    vgene_key: str | None = None
    jgene_key: str | None = None
    cdr3_key: str | None = None
    mutations_key: str | None = None
    locus_key: str | None = None
    light_vgene_key: str | None = None
    light_jgene_key: str | None = None
    mutation_delimiter: str = "|"
    ignore_likely_allelic_variants: bool = False
    allelic_variant_threshold: float = 0.35
    min_seqs_for_allelic_variants: int = 200
    restrict_to_igh: bool = False
    precluster: bool = False
    preclustering_threshold: float = 0.65
    preclustering_key: str | None = None
    mnemonic_names: bool = True
    name_seed: int | None = None
    word_list: str | None = None
    mode: str = "progressive"
    max_pairs_per_bucket: int | None = None
    lineage_field: str = "lineage"
    lineage_size_field: str = "lineage_size"
    validate_ids: bool = True

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}: {self.mode}")
        if not self.mutation_delimiter:
            raise ValueError("mutation_delimiter must not be empty")
        if self.max_pairs_per_bucket is not None and self.max_pairs_per_bucket < 1:
            raise ValueError("max_pairs_per_bucket must be positive")
        if not 0 <= self.preclustering_threshold <= 1:
            raise ValueError("preclustering_threshold must be between 0 and 1")
        if self.length_penalty_multiplier <= 0 and self.mode == "average":
            raise ValueError("average mode needs a positive length_penalty_multiplier")

    @classmethod
    def of(cls, options: LineageOptions | None = None, **given) -> LineageOptions:
        known = {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise TypeError(f"unknown option: {', '.join(sorted(unknown))}")
        return cls(**({f: getattr(options, f) for f in known} if options else {}) | given)
