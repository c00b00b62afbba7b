"""The activity report: sessions with what each of them waits for, holds, changed and blocks.

Optional parts are joined only when their input is given, so a report that
does not ask for locks never reads them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from setwise.operators import aggregates as ag
from setwise.operators import shaping as sh
from setwise.operators.graph import descendant_count
from setwise.operators.incremental import snapshot_delta
from setwise.sources.sinks import save_as

KEY = ["session_id", "request_id"]
# What a filter may be on, and the column it looks at.
FILTER_FIELDS = {"session": "session_id", "program": "program_name", "database": "database_name", "login": "login_name", "host": "host_name"}


@dataclass(frozen=True)
class ActivityOptions:
    """What to show, in which order and layout. Empty filters are off.

    ``show_sleeping``: all sleeping sessions (True), none (False), or with
    ``"open"`` only those with an open transaction (``open_tran_count``).
    """

    include: str = ""
    include_by: str = "session"
    exclude: str = ""
    exclude_by: str = "session"
    columns: str = "[%]"
    order: str = "[session_id][request_id]"
    metrics: Sequence[str] = ("reads", "writes", "physical_io")
    largest_cpu: tuple[str, str] | None = None
    find_block_leaders: bool = False
    format_output: Mapping[str, int] = field(default_factory=dict)
    show_sleeping: bool | str = True


def _awake(show_sleeping: bool | str) -> Column:
    """Sessions that are shown where not all are; one without a status is not asleep."""
    awake = ~F.col("status").eqNullSafe("sleeping")
    if show_sleeping is False:
        return awake
    if show_sleeping != "open":
        raise ValueError(f"show_sleeping must be True, False or 'open', not {show_sleeping!r}")
    return awake | (F.coalesce("open_tran_count", F.lit(0)) > 0)


def activity_report(
    sessions: DataFrame, options: ActivityOptions = ActivityOptions(), previous: DataFrame | None = None,
    waits: DataFrame | None = None, transactions: DataFrame | None = None, locks: DataFrame | None = None,
    destination: str | None = None, return_schema: bool = False,
) -> DataFrame | str:
    """One row per session and request.

    ``previous`` (an earlier capture) adds ``<metric>_delta``; ``waits`` adds
    ``wait_info``, ``transactions`` ``tran_log_writes`` and ``tran_start_time``,
    ``locks`` a nested document, ``find_block_leaders`` the number of sessions
    waiting behind each. With ``destination`` the rows are appended to that
    table; with ``return_schema`` only its column definitions come back.
    """
    o = options
    out = sessions if o.show_sleeping is True else sessions.where(_awake(o.show_sleeping))
    # Chains are counted before filtering: a hidden session still blocks others.
    blocked = None
    if o.find_block_leaders:
        waiting = out.select("session_id", "blocking_session_id").distinct()  # a session may wait for several
        blocked = descendant_count(waiting, "session_id", "blocking_session_id", "blocked_session_count").select(
            "session_id", "blocked_session_count").distinct()
    out = sh.filter_pair(out, FILTER_FIELDS, o.include, o.include_by, o.exclude, o.exclude_by)
    disabled: list[str] = []
    if previous is not None:
        larger = {"CPU": o.largest_cpu} if o.largest_cpu else None
        out = snapshot_delta(previous, out, KEY, "start_time", o.metrics, larger)
        disabled += [c for pair in (o.largest_cpu or (),) for c in pair if c.startswith("thread_")]
    if waits is not None:
        out = out.join(ag.wait_digest(waits, KEY, "wait_type", "wait_duration_ms", "wait_info"), KEY, "left")
    if transactions is not None:
        digest = ag.txn_digest(transactions, KEY, "database", "log_record_count", "log_bytes_used", "begin_time", "tran_log_writes")
        out = out.join(digest.withColumnRenamed("first_begin", "tran_start_time"), KEY, "left")
    if locks is not None:
        documents = sh.nested_counts(locks, "session_id", "database_name", "request_mode", "locks")
        out = out.join(documents, "session_id", "left")
    if blocked is not None:
        out = out.join(blocked, "session_id", "left")
    wide = sh.select_like(out, o.columns, disabled)
    if return_schema or destination:
        ddl = save_as(wide, destination or "", schema_only=return_schema)
        return ddl if return_schema else wide
    ordered = sh.select_like(sh.order_like(out, o.order), o.columns, disabled)
    shown = {c: places for c, places in o.format_output.items() if c in wide.columns}
    return sh.aligned_thousands(ordered, shown) if shown else ordered
