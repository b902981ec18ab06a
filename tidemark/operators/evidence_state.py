"""Evidence carried from cycle to cycle.

``fold`` reduces history rows of the active keys to one state row per key, ``merge`` adds states of disjoint rows, and
``finish`` turns a state into the evidence that ``evidence.evidence`` works out from the whole history. A cycle therefore
reads the stored state and the rows that are not in it yet.

Late rows are folded like any others, with the cursors of the moment they arrive: a scan never looks behind its cursor. What
a state row was folded with (creation and first observation of its key) is kept next to it; ``outdated`` names the keys for
which the registry has moved on since, and those whose first crossing lies behind the cursor or the retained history, so that
the next crossing is unknown. They are folded anew from their history, before anything else is merged into their state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.config import RuleConfig
from tidemark.functions.coerce import instant, seconds
from tidemark.functions.joins import split_ready
from tidemark.operators import evidence as ev

DEFAULT = RuleConfig()
FACTS = ("created_at", "first_observed_at")
NEWEST = {
    "latest_at": ("latest_mcap", "latest_liquidity", "latest_holders"),
    "checkpoint_at": ("checkpoint_mcap", "checkpoint_liquidity"),
    "holder_at": ("checkpoint_holders",),
}
EARLIEST = ("economic_at", *(f"{rule}_crossing" for rule in ev.SCANS))
COLUMNS = ("mint", *FACTS, *(c for at, values in NEWEST.items() for c in (at, *values)), "changes_in_window", *EARLIEST)


def _type(column: str) -> T.DataType:
    if column == "mint":
        return T.StringType()
    if column == "changes_in_window":
        return T.LongType()
    return T.TimestampType() if column.endswith(("_at", "_crossing")) else T.DoubleType()


SCHEMA = T.StructType([T.StructField(c, _type(c)) for c in COLUMNS])


def _marks(registry: DataFrame, cursors: DataFrame | None) -> DataFrame:
    return ev._with_cursors(registry.where("tracking_enabled").select("mint", *FACTS), cursors)


def fold(registry: DataFrame, rows: DataFrame, cfg: RuleConfig = DEFAULT, cursors: DataFrame | None = None) -> DataFrame:
    """State (``COLUMNS``) of the active keys that have a row. ``rows`` is a ``lifecycle_view``."""
    at, created, first = F.col("observed_at"), F.col("created_at"), F.col("first_observed_at")
    before = {
        "latest_at": at,
        "checkpoint_at": F.when(at <= created + seconds(cfg.continuation_checkpoint_s), at),
        "holder_at": F.when(at <= first + seconds(cfg.holder_checkpoint_s), at),
    }
    sources = {"mcap": "mcap", "liquidity": "liquidity", "holders": "holders"}
    folds = [F.max(fact).alias(fact) for fact in FACTS]
    for name, moment in before.items():
        folds.append(F.max(moment).alias(name))
        folds += [F.max_by(sources[value.split("_")[1]], moment).alias(value) for value in NEWEST[name]]
    in_signal = (at > created + seconds(cfg.observation_s)) & (at <= created + seconds(cfg.continuation_checkpoint_s))
    folds.append(F.count_if(in_signal).alias("changes_in_window"))
    folds.append(F.min(F.when(F.col("has_economic"), at)).alias("economic_at"))
    for rule, (field, floor) in ev.SCANS.items():
        crossed = (at > ev._scan_start(created, F.col(f"{rule}_cursor"), cfg)) & (F.col(field) < F.lit(getattr(cfg, floor)))
        folds.append(F.min(F.when(crossed, at)).alias(f"{rule}_crossing"))
    return rows.join(split_ready(_marks(registry, cursors), "mint"), "mint").groupBy("mint").agg(*folds).select(*COLUMNS)


def merge(*states: DataFrame) -> DataFrame:
    """One state row per key from states of disjoint rows that were folded with the same facts."""
    every = states[0].select(*COLUMNS)
    for other in states[1:]:
        every = every.unionByName(other.select(*COLUMNS))
    folds = [F.max(fact).alias(fact) for fact in FACTS]
    for at, values in NEWEST.items():
        folds.append(F.max(at).alias(at))
        folds += [F.max_by(value, at).alias(value) for value in values]
    folds.append(F.sum("changes_in_window").alias("changes_in_window"))
    folds += [F.min(name).alias(name) for name in EARLIEST]
    return every.groupBy("mint").agg(*folds).select(*COLUMNS)


def outdated(registry: DataFrame, state: DataFrame, cfg: RuleConfig = DEFAULT, cursors: DataFrame | None = None, since=None) -> DataFrame:
    """Active keys (``mint``) whose state row no longer answers for their rows."""
    marks = _marks(registry, cursors).withColumnsRenamed({fact: f"_{fact}" for fact in FACTS})
    moved = F.lit(False)
    for fact in FACTS:
        moved |= ~F.col(fact).eqNullSafe(F.col(f"_{fact}"))
    for rule in ev.SCANS:
        crossing = F.col(f"{rule}_crossing")
        behind = crossing <= ev._scan_start(F.col("_created_at"), F.col(f"{rule}_cursor"), cfg)
        if since is not None:
            behind |= crossing < instant(since)
        moved |= F.coalesce(behind, F.lit(False))
    return state.join(marks, "mint").where(moved).select("mint")


def finish(
    registry: DataFrame, state: DataFrame, as_of, cfg: RuleConfig = DEFAULT, cursors: DataFrame | None = None, since=None
) -> DataFrame:
    """Evidence of every active key. ``since`` is the start of the retained history: older rows count as gone."""
    now = instant(as_of)
    active = registry.where("tracking_enabled").select("mint", *FACTS, "last_polled_at", "last_changed_at")
    joined = ev._with_cursors(active, cursors).join(state.select(*COLUMNS).drop(*FACTS), "mint", "left")
    if since is not None:
        gone = {at: F.col(at) < instant(since) for at in NEWEST}
        joined = joined.withColumns({c: F.when(~gone[at], F.col(c)) for at, values in NEWEST.items() for c in (*values, at)})
    scans = {}
    for rule in ev.SCANS:
        start = ev._scan_start(F.col("created_at"), F.col(f"{rule}_cursor"), cfg)
        scans[f"{rule}_scanned"] = F.when(F.col("latest_at") > start, F.col("latest_at"))
        scans[f"{rule}_crossing"] = F.when(F.col(f"{rule}_crossing") > start, F.col(f"{rule}_crossing"))
    return joined.withColumns(
        {
            **scans,
            "has_economic": F.coalesce(F.col("economic_at") <= now, F.lit(False)),
            "changes_in_window": F.coalesce("changes_in_window", F.lit(0)),
            "as_of": now,
        }
    ).drop("economic_at", *(f"{rule}_cursor" for rule in ev.SCANS))


def carried(
    registry: DataFrame,
    state: DataFrame,
    rows: DataFrame,
    as_of,
    cfg: RuleConfig = DEFAULT,
    cursors: DataFrame | None = None,
    since=None,
) -> DataFrame:
    """Evidence from a state without outdated keys and the rows that it does not hold."""
    return finish(registry, merge(state, fold(registry, rows, cfg, cursors)), as_of, cfg, cursors, since)


def renewed(registry: DataFrame, state: DataFrame, history: DataFrame, stale: DataFrame, cfg: RuleConfig = DEFAULT, cursors: DataFrame | None = None) -> DataFrame:
    """The state with the rows of ``stale`` keys folded anew; ``history`` is what the state holds, as a ``lifecycle_view``."""
    rows = history.join(split_ready(stale, "mint"), "mint", "left_semi")
    return state.select(*COLUMNS).join(stale, "mint", "left_anti").unionByName(fold(registry, rows, cfg, cursors))
