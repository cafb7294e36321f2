"""Every registered query of the library's own operators, and its SQL where SQL can state it."""

from __future__ import annotations

from . import controls, entities, features, files, matching, ranking, sequences, tensors
from .common import Query

QUERIES: dict[str, Query] = {**sequences.QUERIES, **ranking.QUERIES, **features.QUERIES, **matching.QUERIES, **entities.QUERIES, **controls.QUERIES, **tensors.QUERIES, **files.QUERIES}
SQL: dict[str, str] = {**sequences.SQL, **ranking.SQL, **features.SQL, **matching.SQL, **entities.SQL, **controls.SQL, **tensors.SQL, **files.SQL}
