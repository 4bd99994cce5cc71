"""Query compositions: the flagship, the chart-feed report (``legation.plans.report``),
size-checked broadcast, the stand-in star over the test tables and the query catalog.

Only modules without operator imports are loaded here, so that the operators
can use ``legation.plans.sizing`` without an import cycle.
"""

from legation.plans.sizing import bounded_broadcast

__all__ = ["bounded_broadcast", "category_share_ranking", "combine_shares"]


def __getattr__(name):
    # the flagship imports the operators, so it is loaded on first use
    if name in ("category_share_ranking", "combine_shares"):
        from legation.plans import flagship

        return getattr(flagship, name)
    raise AttributeError(name)
