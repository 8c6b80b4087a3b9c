"""Campaign states under rule sets A and B, and their side-by-side trace."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barledger.checks import require_columns
from barledger.operators.fold import Machine, decode, fold_events

# The event vocabulary, in declared order.
EVENT_TYPES = (
    "MAJOR_BULL_CONFIRMED",
    "MAJOR_BEAR_CONFIRMED",
    "MAJOR_BULL_RISK",
    "MAJOR_BEAR_RISK",
    "LOCAL_LONG_ENTRY",
    "LOCAL_SHORT_ENTRY",
    "LOCAL_LONG_RISK",
    "LOCAL_SHORT_INVALIDATION",
    "LOCAL_LONG_RECOVERY",
    "LOCAL_SHORT_RECOVERY",
    "LOCAL_LONG_REENTRY",
    "LOCAL_SHORT_REENTRY",
)
# Core side to exposure.
CORE_EXPOSURE = {"CORE_LONG": 1, "CORE_SHORT": -1, "FLAT": 0}
BULL_SIDE = ("BULL_CONFIRMED", "BULL_AT_RISK")
BEAR_SIDE = ("BEAR_CONFIRMED", "BEAR_AT_RISK")


@dataclass(frozen=True)
class CampaignState:
    regime: str = "NEUTRAL"
    core: str = "FLAT"
    at_risk: bool = False
    watch: str = ""


@dataclass(frozen=True)
class Rule:
    """When ``event`` arrives and the guards hold, set the given fields."""

    event: str
    action: str
    regimes: tuple[str, ...] = ()
    core: str | None = None
    watch: str | None = None
    sets: tuple[tuple[str, object], ...] = ()
    closes: str | None = None  # this core side falls back to FLAT

    def fits(self, s: CampaignState) -> bool:
        return (
            (not self.regimes or s.regime in self.regimes)
            and (self.core is None or s.core == self.core)
            and (self.watch is None or s.watch == self.watch)
        )

    def apply(self, s: CampaignState) -> CampaignState:
        after = replace(s, **dict(self.sets))
        return replace(after, core="FLAT") if s.core == self.closes else after


def _confirm(event: str, regime: str, closes: str) -> Rule:
    cleared = (("regime", regime), ("at_risk", False), ("watch", ""))
    return Rule(event, event, sets=cleared, closes=closes)


RULES_A = (
    _confirm("MAJOR_BULL_CONFIRMED", "BULL_CONFIRMED", "CORE_SHORT"),
    _confirm("MAJOR_BEAR_CONFIRMED", "BEAR_CONFIRMED", "CORE_LONG"),
    Rule("MAJOR_BULL_RISK", "RISK_DOWNGRADE", BULL_SIDE, sets=(("regime", "BULL_AT_RISK"), ("at_risk", True))),
    Rule("MAJOR_BEAR_RISK", "RISK_DOWNGRADE", BEAR_SIDE, sets=(("regime", "BEAR_AT_RISK"), ("at_risk", True))),
    Rule("LOCAL_LONG_ENTRY", "ENTER_LONG", BULL_SIDE, core="FLAT", sets=(("core", "CORE_LONG"),)),
    Rule("LOCAL_SHORT_ENTRY", "ENTER_SHORT", BEAR_SIDE, core="FLAT", sets=(("core", "CORE_SHORT"),)),
    Rule("LOCAL_LONG_RISK", "LONG_RISK", core="CORE_LONG", sets=(("at_risk", True),)),
    Rule("LOCAL_SHORT_INVALIDATION", "EXIT_SHORT", core="CORE_SHORT", sets=(("core", "FLAT"), ("watch", "SHORT"))),
    Rule("LOCAL_LONG_RECOVERY", "LONG_RECOVERY", BULL_SIDE, sets=(("regime", "BULL_CONFIRMED"), ("at_risk", False))),
    Rule("LOCAL_SHORT_RECOVERY", "SHORT_RECOVERY", BEAR_SIDE, sets=(("regime", "BEAR_CONFIRMED"), ("at_risk", False))),
    Rule("LOCAL_LONG_REENTRY", "REENTER_LONG", BULL_SIDE, core="FLAT", watch="LONG", sets=(("core", "CORE_LONG"), ("watch", ""))),
    Rule("LOCAL_SHORT_REENTRY", "REENTER_SHORT", BEAR_SIDE, core="FLAT", watch="SHORT", sets=(("core", "CORE_SHORT"), ("watch", ""))),
)
# B keeps every rule of A but only records the short re-entry as a probe.
RULES_B = tuple(
    replace(r, action="PROBE_SHORT_REENTRY_SUPPRESSED", sets=()) if r.action == "REENTER_SHORT" else r
    for r in RULES_A
)
RULE_SETS = {"A": RULES_A, "B": RULES_B}


def step(rules: Sequence[Rule], s: CampaignState, event: str) -> tuple[CampaignState, str]:
    for rule in rules:
        if rule.event == event and rule.fits(s):
            return rule.apply(s), rule.action
    return s, "HOLD"


def compile_machine(names: Sequence[str]) -> Machine:
    """Enumerate the joint states the named rule sets can reach on one event stream."""
    sets = [RULE_SETS[n] for n in names]
    start = tuple(CampaignState() for _ in sets)
    found, queue = {start: 0}, [start]
    moves: dict[tuple[int, int], tuple[int, tuple[str, ...]]] = {}
    while queue:
        joint = queue.pop(0)
        for e, event in enumerate(EVENT_TYPES):
            results = [step(rules, s, event) for rules, s in zip(sets, joint)]
            after = tuple(r[0] for r in results)
            if after not in found:
                found[after] = len(found)
                queue.append(after)
            moves[e, found[joint]] = found[after], tuple(r[1] for r in results)
    ordered = tuple(found)
    grid = [[moves[e, s] for s in range(len(ordered))] for e in range(len(EVENT_TYPES))]
    labels: dict[str, tuple] = {}
    for i, name in enumerate(names):
        p = f"{name.lower()}_" if len(names) > 1 else ""
        labels[f"{p}regime"] = (tuple(s[i].regime for s in ordered),)
        labels[f"{p}core"] = (tuple(s[i].core for s in ordered),)
        labels[f"{p}at_risk"] = (tuple(s[i].at_risk for s in ordered),)
        labels[f"{p}watch"] = (tuple(s[i].watch for s in ordered),)
        labels[f"{p}last_action"] = tuple(tuple(cell[1][i] for cell in row) for row in grid)
    return Machine(
        states=ordered,
        events=EVENT_TYPES,
        step=tuple(tuple(cell[0] for cell in row) for row in grid),
        labels=labels,
    )


def campaign_states(events: DataFrame, keys: Sequence[str], rule_set: str, **kw) -> DataFrame:
    """State after every event under one rule set."""
    machine = compile_machine([rule_set])
    return decode(fold_events(events, keys, machine, **kw), machine)


def ab_trace(events: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """States of A and B side by side, from one pass over the events."""
    machine = compile_machine(["A", "B"])
    return decode(fold_events(events, keys, machine, **kw), machine)


def core_exposure(core: Column) -> Column:
    pairs = [F.lit(v) for kv in CORE_EXPOSURE.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), core)


def direction_of(regime: Column) -> Column:
    return (
        F.when(regime.isin(*BULL_SIDE), 1).when(regime.isin(*BEAR_SIDE), -1).otherwise(0)
    )


def ab_timeline(trace: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The numeric state columns that bars look up: sides, direction and risk flag."""
    return trace.select(
        *keys,
        "ts",
        "seq",
        core_exposure(F.col("a_core")).alias("a_side"),
        core_exposure(F.col("b_core")).alias("b_side"),
        direction_of(F.col("a_regime")).alias("direction"),
        F.col("a_at_risk").cast("int").alias("at_risk"),
    )


def event_violations(events: DataFrame, keys: Sequence[str], freeze: Column | None = None) -> DataFrame:
    """Rows (keys, check, failures) for one event table.

    Rows are first counted per (key, timestamp, type), so duplicates need no second
    pass and no group is larger than its number of identical events.
    """
    require_columns(events, [*keys, "ts", "event_type"])
    distinct = events.groupBy(*keys, "ts", "event_type").agg(F.count("*").alias("n"))
    known = F.col("event_type").isin(*EVENT_TYPES)
    n = F.col("n")
    early = F.lit(False) if freeze is None else F.col("ts") <= freeze

    def rows_where(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    counts = distinct.groupBy(*keys).agg(
        rows_where(F.col("ts").isNull()).alias("invalid_timestamp"),
        rows_where(~F.coalesce(known, F.lit(False))).alias("unknown_event_type"),
        rows_where(early).alias("at_or_before_freeze"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_event"),
    )
    return counts.unpivot(
        list(keys),
        ["invalid_timestamp", "unknown_event_type", "at_or_before_freeze", "duplicate_event"],
        "check",
        "failures",
    )


def split_events(
    events: DataFrame, keys: Sequence[str], freeze: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows carry their reasons instead of vanishing.

    Where events have a seq, those that repeat the (instant, type) of one with a smaller
    seq are duplicates.
    """
    early = F.lit(False) if freeze is None else F.col("ts") <= freeze
    known = F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("ts").isNull(), "invalid_timestamp"),
            F.when(~known, "unknown_event_type"),
            F.when(early, "at_or_before_freeze"),
        )
    )
    marked = events.withColumn("reasons", reasons)
    if "seq" in events.columns:
        at = [*keys, "ts", "event_type"]
        first = events.groupBy(*at).agg(F.min("seq").alias("first_seq"), F.count("*").alias("copies")).where("copies > 1")
        marked = marked.join(first.drop("copies"), at, "left").select(*events.columns, F.when(
            F.col("seq") > F.col("first_seq"), F.array_append("reasons", "duplicate_event")).otherwise(F.col("reasons")).alias("reasons"))
    ok = F.size("reasons") == 0
    return marked.filter(ok).drop("reasons"), marked.filter(~ok)
