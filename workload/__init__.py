"""Registered queries: Spark plan plus reference SQL over the shared test tables."""
