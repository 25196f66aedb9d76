"""Registered queries: each pairs a DataFrame job with the SQL that checks it."""

from catalog.base import ORACLES, QUERIES

import catalog.ingest  # noqa: E402,F401
import catalog.preparation  # noqa: E402,F401
import catalog.spectra  # noqa: E402,F401
import catalog.dispersion  # noqa: E402,F401
import catalog.resampling  # noqa: E402,F401
import catalog.statistics  # noqa: E402,F401
import catalog.evaluation  # noqa: E402,F401

__all__ = ["QUERIES", "ORACLES"]
