"""Status expressions over landed payloads and status words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from replipulse.model import NONE_FOUND, NOT_AVAILABLE, OKAY, WARNING


def any_other_than(words: Column, healthy: str) -> Column:
    """True when an array of words holds anything but the healthy word.

    ``array_remove`` keeps NULLs, so a missing word counts as unhealthy, and the
    test needs neither an explode nor a lambda.
    """
    return F.size(F.array_remove(words, healthy)) > 0


def list_status(records: Column, bad: Column, empty: str) -> Column:
    """Status of one array from its record count and whether any record is bad.

    A NULL count means that nothing was landed for the array; ``empty`` is the
    status of an array that answered with an empty list.
    """
    return (
        F.when(records.isNull(), F.lit(NOT_AVAILABLE))
        .when(records == 0, F.lit(empty))
        .when(bad, F.lit(WARNING))
        .otherwise(F.lit(OKAY))
    )


def empty_connections_word(empty_as_na: bool) -> str:
    return NOT_AVAILABLE if empty_as_na else NONE_FOUND


def rolled_up(status: Column) -> Column:
    """Aggregate: any Warning wins, then all N/A (or no rows at all), else Okay."""
    return (
        F.when(F.bool_or(status == WARNING), F.lit(WARNING))
        .when(F.coalesce(F.bool_and(status == NOT_AVAILABLE), F.lit(True)), F.lit(NOT_AVAILABLE))
        .otherwise(F.lit(OKAY))
    )
