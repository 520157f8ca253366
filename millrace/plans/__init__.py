"""The catalogue of registered queries, the SQL session and the node pipelines."""


def catalogue() -> tuple[dict, dict]:
    """(queries, SQL) of the library, by name."""
    from . import queries_api, queries_group, queries_join, queries_scalar, queries_scan, queries_window  # noqa: F401
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
