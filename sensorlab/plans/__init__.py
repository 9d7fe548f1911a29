"""Jobs and named queries."""


def all_queries():
    """Every named query, and the SQL of those that have one."""
    from sensorlab.plans import (  # noqa: F401
        grid_queries,
        model_queries,
        network_queries,
        source_queries,
        table_queries,
    )
    from sensorlab.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
