"""Imports every query module so that the registry is complete."""

import workload.dependency_queries  # noqa: F401
import workload.profile_queries  # noqa: F401
import workload.score_queries  # noqa: F401
import workload.similarity_queries  # noqa: F401
import workload.repair_queries  # noqa: F401
import workload.impute_queries  # noqa: F401
import workload.fact_queries  # noqa: F401
