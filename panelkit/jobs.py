"""The registered queries of the panel, risk and valuation jobs."""

from panelkit.plans import covariance_study, file_jobs, more_jobs, portfolio_study, risk_jobs, scenario_study, series_jobs, strategies, table_jobs, value_study  # noqa: F401
from panelkit.plans.registry import QUERIES, SQL  # noqa: F401
