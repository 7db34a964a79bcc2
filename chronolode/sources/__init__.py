"""Readers, writers and the shared scratch folder."""

from chronolode.sources.observations import (
    USUAL_NULLS,
    nan_to_null,
    read_observations,
    with_month_start,
    with_timestamp,
)
from chronolode.sources.scratch import checkpoint_folder, materialise
from chronolode.sources.tables import load, to_table, write_table

__all__ = [
    "USUAL_NULLS",
    "checkpoint_folder",
    "load",
    "materialise",
    "nan_to_null",
    "read_observations",
    "to_table",
    "with_month_start",
    "with_timestamp",
    "write_table",
]
