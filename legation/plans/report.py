"""From appointments and countries to chart feeds (the answer-to-chart flow).

``representation_report`` composes the operators into the feeds a charting
tool needs and writes each one as a ``;``-delimited folder. Every feed is an
aggregate over the whole appointment table; the country dimension is joined
after the facts were counted per state (or per pair of states).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legation.operators.clean import unmatched_codes
from legation.operators.joins import complete, enrich
from legation.operators.measures import (
    bilateral_matrix,
    count_by,
    crosstab,
    parity_ratio,
    rollup_counts,
    share_by,
)
from legation.operators.windows import change_over
from legation.plans.flagship import category_share_ranking
from legation.sources.delimited import export_feed


def representation_feeds(
    appointments: DataFrame,
    countries: DataFrame,
    category: str,
    categories: Sequence[str],
    other: str | None = None,
    sender: str = "sender_code",
    receiver: str | None = "receiver_code",
    category_col: str = "category",
    posting_col: str | None = "posting",
    period_col: str | None = None,
    code: str = "country_code",
    name: str = "country_name",
    continent: str = "continent_code",
) -> dict[str, DataFrame]:
    """The feeds as DataFrames (nothing is computed until they are written).

    * ``share_by_state``: share of ``category`` per sending state, ranked
      within its continent (F1);
    * ``parity_by_state``: ``category`` against ``other`` per state (A3);
    * ``category_by_posting``: cross-tab of posting type by category (A7);
    * ``continent_matrix``: sender continent x receiver continent (A9);
    * ``share_by_period``: share per period and change on the previous (W4);
    * ``counts_with_subtotals``: appointments per continent and state with
      continent subtotals and the grand total (A5);
    * ``state_by_period``: appointments per state and period, every state of
      the countries table and every period from the first to the last, empty
      cells 0 (J5); appointments of unmatched senders or without a period are
      rows with a null name or period, so the total is that of the table;
    * ``unmatched_senders``: sender codes missing from the countries (Q3).

    Feeds whose columns are not given (``other``, ``receiver``,
    ``posting_col``, ``period_col`` set to None) are left out.
    """
    per_state = enrich(count_by(appointments, sender), countries, sender, code, [name, continent])
    feeds: dict[str, DataFrame] = {
        "share_by_state": category_share_ranking(
            appointments, countries, sender, category_col, category, code, name, continent
        ),
        "counts_with_subtotals": rollup_counts(per_state, [continent, name], weight="n"),
        "unmatched_senders": unmatched_codes(appointments, countries, sender, code),
    }
    if other is not None:
        ratios = parity_ratio(appointments, sender, category_col, category, other)
        feeds["parity_by_state"] = enrich(ratios, countries, sender, code, [name, continent])
    if posting_col is not None:
        feeds["category_by_posting"] = crosstab(appointments, posting_col, category_col, list(categories))
    if receiver is not None:
        pairs = count_by(appointments.where(F.col(receiver).isNotNull()), sender, receiver)
        feeds["continent_matrix"] = bilateral_matrix(
            pairs, countries, sender, receiver, code, continent, weight="n"
        )
    if period_col is not None:
        shares = share_by(appointments, period_col, category_col, category)
        feeds["share_by_period"] = change_over(shares, period_col, "share")
        per_period = enrich(count_by(appointments, sender, period_col), countries, sender, code, [name])
        counts = count_by(per_period, name, period_col, weight="n")
        first = appointments.select(F.min(period_col)).scalar()
        last = appointments.select(F.max(period_col)).scalar()
        feeds["state_by_period"] = complete(
            counts, {name: countries.select(name), period_col: F.sequence(first, last)}, ["n"]
        )
    return feeds


def representation_report(out_dir: str, *args, **kwargs) -> dict[str, str]:
    """Write every feed of ``representation_feeds`` under ``out_dir``; returns the paths."""
    paths = {}
    for feed, df in representation_feeds(*args, **kwargs).items():
        paths[feed] = export_feed(df, f"{out_dir.rstrip('/')}/{feed}")
    return paths
