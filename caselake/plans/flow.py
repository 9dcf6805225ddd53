"""What a run does with its records, and how it is repeated from the raw store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from caselake.operators.silver import Silver
from caselake.operators.store import Commit, Tables
from caselake.plans.mapping import MappedRun, Mapping, MappingRefused, Resolver, run_mapping
from caselake.sources.bronze import Bronze

Sink = Callable[[dict[str, DataFrame], str], dict[str, int]]
"""(type -> rows, run id) -> rows written per type"""


def fan_out(changes: dict[str, DataFrame], sinks: dict[str, Sink], run_id: str) -> dict[str, dict[str, int]]:
    """P20: one change set to every sink. The rows are already a table, so no sink recomputes the mapping."""
    if not changes:
        return {name: {} for name in sinks}
    return {name: sink(changes, run_id) for name, sink in sinks.items()}


@dataclass(frozen=True)
class RunResult:
    run: MappedRun
    commits: list[Commit]
    projected: dict[str, dict[str, int]] = field(default_factory=dict)
    landed: int = 0
    quarantined: int = 0

    @property
    def clean(self) -> bool:
        return self.quarantined == 0


QUARANTINE, VIOLATIONS, RUNS = "quarantine", "violations", "runs"


def keep_rejects(run: MappedRun, store: Tables) -> None:
    """What a run held back, with its values (this store is restricted), why, and the run's report.

    Each under the run's id, so a repeated run is kept once.
    """
    for name, rows in ((QUARANTINE, run.quarantine()), (VIOLATIONS, run.violation_rows()), (RUNS, run.report())):
        store.append(name, rows, run.run_id)


def execute(bronze: Bronze, silver: Silver, mapping: Mapping, resolvers: dict[str, Resolver], run_id: str,
            first: str | None = None, last: str | None = None, sinks: dict[str, Sink] | None = None,
            rewrite: bool = False, rejects: Tables | None = None) -> RunResult:
    """Read a range of the raw store, map it, write silver and what was held back, feed the projections."""
    run = run_mapping(bronze.read(mapping.source_id, first, last), mapping, resolvers, run_id,
                      bronze.at_most(mapping.source_id, first, last))
    tables = run.by_type()
    commits = silver.rewrite(tables) if rewrite else silver.append(tables)
    written = {c.name: silver.read(c.name) if rewrite else tables[c.name] for c in commits}
    if rejects is not None:
        keep_rejects(run, rejects)
    projected = fan_out(written, sinks or {}, run_id)
    account = run.account().first()
    return RunResult(run, commits, projected, account["landed"], account["quarantined"])


@dataclass(frozen=True)
class ReplayRequest:
    source_id: str
    mapping: str                 # name@version, exactly
    first: str | None = None
    last: str | None = None


def replay(request: ReplayRequest, bronze: Bronze, silver: Silver, mapping: Mapping,
           resolvers: dict[str, Resolver], sinks: dict[str, Sink] | None = None, run_id: str = "replay") -> RunResult:
    """Rewrite the types the mapping produces, then rebuild what is derived from them."""
    if request.mapping != mapping.qualified:
        raise MappingRefused(f"replay asks for {request.mapping}, the mapping given is {mapping.qualified}")
    if request.source_id != mapping.source_id:
        raise MappingRefused(f"replay asks for source '{request.source_id}', the mapping reads '{mapping.source_id}'")
    return execute(bronze, silver, mapping, resolvers, run_id, request.first, request.last, sinks, rewrite=True)


def dry_run(silver: Silver, mapping: Mapping) -> dict[str, int]:
    """The types a replay would rewrite and how many rows they hold now; the log alone answers it."""
    now = silver.counts()
    return {h.contract.emits.name: now.get(h.contract.emits.name, 0) for h in mapping.hops}
