"""The registered queries of the sequence operators, each with its SQL where SQL can express it."""

from cadenza.plans import language_queries, model_queries, more_queries, search_queries, signal_queries  # noqa: F401
from cadenza.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    return model_queries.frame_classes(spark, sf_dir)
