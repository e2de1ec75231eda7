"""All queries of the release-risk engine and their SQL."""

from __future__ import annotations

from . import distances, release, utility

QUERIES = {**release.QUERIES, **distances.QUERIES, **utility.QUERIES}
SQL = {**release.SQL, **distances.SQL, **utility.SQL}
