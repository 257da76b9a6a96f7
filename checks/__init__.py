"""Registered queries and the SQL that each one is compared with."""

from checks import (  # noqa: F401
    q_accounts,
    q_aggregates,
    q_cleaning,
    q_forecasts,
    q_io,
    q_models,
    q_recommend,
    q_reports,
    q_series,
    q_tables,
    q_text,
)
from checks.base import ORACLES, QUERIES  # noqa: F401
