"""Data profiling on Spark: one automatic profile of every table and column of a dataset."""

from siftwell.plans.profile import DatasetProfile, ProfileOptions, profile_dataset, profile_table
from siftwell.sources.constraints import Constraints, ForeignKey, UniqueKey
from siftwell.sources.dataset import Dataset

__all__ = [
    "Constraints",
    "Dataset",
    "DatasetProfile",
    "ForeignKey",
    "ProfileOptions",
    "UniqueKey",
    "profile_dataset",
    "profile_table",
]
