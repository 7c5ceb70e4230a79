"""The frames that the operators read together."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Store:
    """postings, companies, locations (a row per posting and place), tech (a row per posting and tag), verdicts, track_verdicts, flags (the user's marks), texts (posting_id, title, company_name, tech, description)."""

    postings: DataFrame
    companies: DataFrame
    locations: DataFrame
    tech: DataFrame
    verdicts: DataFrame
    track_verdicts: DataFrame
    flags: DataFrame
    texts: DataFrame | None = None

    def with_(self, **frames: DataFrame) -> Store:
        return replace(self, **frames)
