"""DataFrame operators (DataFrame in, DataFrame out)."""

from legation.operators.bootstrap import share_intervals
from legation.operators.clean import (
    assign_names,
    conform_types,
    count_cast_failures,
    decode,
    duplicate_keys,
    filter_appointments,
    normalise_keys,
    profile,
    unmatched_codes,
)
from legation.operators.intervals import (
    in_post,
    join_as_of,
    tenure_spells,
    validity,
)
from legation.operators.joins import (
    active_members,
    complete,
    enrich,
    enrich_both,
    inactive_members,
)
from legation.operators.keys import keys_and_dependencies
from legation.operators.maintained import fold_batches, maintained_counts, record_changes, signed_changes
from legation.operators.matching import suggested_matches
from legation.operators.measures import (
    bilateral_matrix,
    count_by,
    crosstab,
    distinct_partners,
    marginals,
    melt,
    parity_ratio,
    rollup_counts,
    share_by,
)
from legation.operators.quantiles import quantiles_by
from legation.operators.versions import (
    diff_versions,
    latest_per_key,
    merge_versions,
    whole_row_changes,
)
from legation.operators.windows import (
    change_over,
    rank_within,
    share_of_total,
    top_k,
    top_n_per_group,
)

__all__ = [
    "active_members",
    "assign_names",
    "bilateral_matrix",
    "change_over",
    "complete",
    "conform_types",
    "count_by",
    "count_cast_failures",
    "crosstab",
    "decode",
    "diff_versions",
    "distinct_partners",
    "duplicate_keys",
    "enrich",
    "enrich_both",
    "filter_appointments",
    "fold_batches",
    "in_post",
    "inactive_members",
    "join_as_of",
    "keys_and_dependencies",
    "latest_per_key",
    "maintained_counts",
    "marginals",
    "melt",
    "merge_versions",
    "normalise_keys",
    "parity_ratio",
    "profile",
    "quantiles_by",
    "rank_within",
    "record_changes",
    "rollup_counts",
    "share_by",
    "share_intervals",
    "share_of_total",
    "signed_changes",
    "suggested_matches",
    "tenure_spells",
    "top_k",
    "top_n_per_group",
    "unmatched_codes",
    "validity",
    "whole_row_changes",
]
