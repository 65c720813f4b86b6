"""Regional events tracked from snapshot to snapshot, with ids that last.

A snapshot is the clusters of one network at one time.  An event and a cluster are candidates for
each other if they share a member and the event was last seen within the gap; a pair that is each
other's only candidate goes on as the same event.  An event that meets several clusters may have
split, a cluster that meets several events may be their merger: neither is guessed, the clusters
open events of their own with a note.  Events that nothing has matched for longer than the gap
disappear.  Nothing is predicted; flags say what changed between two observed snapshots.

`Registry` is the state of one network; `registry_stream` keeps it in a stream, `registry_batch`
folds a table.  Members are looked up by equality, so a snapshot costs as much as its members.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.physics import distance_km
from .stations import with_state_store

#: Minutes without a match after which continuity is not claimed, and what counts as moved and as changed.
GAP_MIN, MOVED_KM, CHANGED = 15.0, 125.0, 1.0
CLUSTER = ["at_us", "cluster", "members", "lat", "lon", "channels", "magnitude", "extent_km"]
REPORT = (
    "network string, at_us long, event string, status string, flags string, cluster long, members int, "
    "member_change int, overlap double, channel_overlap double, moved_km double, magnitude_change double, "
    "extent_change_km double, first_seen_us long, last_seen_us long, note string"
)
_NAMES = [x.split()[0] for x in REPORT.split(", ")]


def _jaccard(a: list, b: list) -> float:
    union = len(set(a) | set(b))
    return len(set(a) & set(b)) / union if union else 0.0


class Registry:
    """Active events of one network, and the number of the next."""

    def __init__(self, network, next_number: int = 1, events: dict[str, dict] | None = None):
        self.network, self.next_number, self.events = network, next_number, events or {}

    def saved(self) -> str:
        return json.dumps([self.next_number, self.events])

    @classmethod
    def loaded(cls, network, text: str) -> Registry:
        return cls(network, *json.loads(text))

    def update(self, at_us: int, clusters: list[dict], gap_min: float = GAP_MIN) -> list[tuple]:
        """Reports after one snapshot: every active event, and those that have just disappeared.

        ``clusters`` are numbered in their order: by centre (six decimals), then by least member.
        """
        clusters = sorted(clusters, key=lambda c: (round(c["lat"], 6), round(c["lon"], 6), min(c["members"])))
        out: list[tuple] = []
        for name in [n for n, e in self.events.items() if (at_us - e["last_seen_us"]) / 60e6 > gap_min]:
            out.append(self._report(at_us, name, self.events.pop(name) | {"flags": "DISAPPEARED", "note": f"unmatched for over {gap_min:g} minutes"}, "DISAPPEARED"))
        owners = defaultdict(set)
        for name, e in self.events.items():
            for m in e["members"]:
                owners[m].add(name)
        of_cluster = [sorted(set().union(*(owners.get(m, ()) for m in c["members"]))) for c in clusters]
        of_event = defaultdict(list)
        for i, names in enumerate(of_cluster):
            for n in names:
                of_event[n].append(i)
        going_on = {n: found[0] for n, found in of_event.items() if len(found) == 1 and len(of_cluster[found[0]]) == 1}
        reports = {n: self._matched(at_us, n, clusters[i]) for n, i in going_on.items()}
        for name, found in of_event.items():
            if len(found) > 1:
                self.events[name].update(flags="SPLIT_AMBIGUOUS", note=f"meets {len(found)} clusters", cluster=None)
        for i, c in enumerate(clusters):
            if i in going_on.values():
                continue
            name = f"EVENT_{self.next_number:04d}"
            self.next_number += 1
            # A cluster is a merger if one of its events meets no other cluster.
            merged = len(of_cluster[i]) > 1 and any(len(of_event[n]) == 1 for n in of_cluster[i])
            note = f"possible merger of {', '.join(of_cluster[i])}" if merged else ""
            for parent in of_cluster[i] if merged else ():
                self.events[parent].update(flags="MERGE_AMBIGUOUS", note=f"possibly merged into {name}", cluster=None)
            self.events[name] = {k: c[k] for k in CLUSTER[1:]} | {"flags": "NEW", "note": note, "first_seen_us": at_us, "last_seen_us": at_us}
        for name, e in self.events.items():
            out.append(reports.get(name) or self._report(at_us, name, e, "ACTIVE"))
        return out

    def _matched(self, at_us: int, name: str, c: dict) -> tuple:
        e = self.events[name]
        grown = len(c["members"]) - len(e["members"])
        moved = distance_km(e["lat"], e["lon"], c["lat"], c["lon"])
        change = None if e["magnitude"] is None or c["magnitude"] is None else c["magnitude"] - e["magnitude"]
        extent = None if e["extent_km"] is None or c["extent_km"] is None else c["extent_km"] - e["extent_km"]
        flags = ["PERSISTING"]
        flags += ["GROWING"] if grown > 0 else ["SHRINKING"] if grown < 0 else []
        flags += ["MOVING"] if moved > MOVED_KM else []
        flags += [] if change is None else ["INTENSIFYING"] if change >= CHANGED else ["WEAKENING"] if change <= -CHANGED else []
        evidence = (grown, _jaccard(e["members"], c["members"]), _jaccard(e["channels"], c["channels"]), moved, change, extent)
        e.update({k: c[k] for k in CLUSTER[1:]}, flags=",".join(flags), note="", last_seen_us=at_us)
        return self._report(at_us, name, e, "ACTIVE", evidence)

    def _report(self, at_us: int, name: str, e: dict, status: str, evidence=(None,) * 6) -> tuple:
        cluster = e["cluster"] if status == "ACTIVE" else None
        return (self.network, at_us, name, status, e["flags"], cluster, len(e["members"]), *evidence, e["first_seen_us"], e["last_seen_us"], e["note"])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"cluster": "Int64", "member_change": "Int32"}
    return pd.DataFrame(rows, columns=_NAMES).astype(kinds)


def _clusters(rows: pd.DataFrame) -> list[dict]:
    """Clusters of a snapshot; a row without a cluster only says that the snapshot was taken."""
    out = []
    for r in rows[rows["cluster"].notna()].to_dict("records"):
        out.append({k: r[k] for k in CLUSTER} | {
            "cluster": int(r["cluster"]),
            "members": [m.item() if hasattr(m, "item") else m for m in r["members"]],
            "channels": [] if r["channels"] is None else list(r["channels"]),
            "magnitude": None if pd.isna(r["magnitude"]) else float(r["magnitude"]),
            "extent_km": None if pd.isna(r["extent_km"]) else float(r["extent_km"]),
        })
    return out


def _snapshots(rows: pd.DataFrame) -> Iterator[tuple[int, list[dict]]]:
    for at, snapshot in rows.groupby("at_us", sort=True):
        yield int(at), _clusters(snapshot)


class RegistryProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("registry", "text string, last_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        text, last = self.held.get() if self.held.exists() else (None, -1)
        registry = Registry.loaded(key[0], text) if text else Registry(key[0])
        out = []
        for at, clusters in _snapshots(pd.concat(list(rows))):
            if at > last:  # a snapshot that is older than the registry changes nothing
                out += registry.update(at, clusters)
                last = at
        self.held.update((registry.saved(), last))
        yield _frame(out)

    def close(self) -> None:
        pass


def registry_stream(clusters: DataFrame) -> DataFrame:
    """Reports of a stream of clusters (network and ``CLUSTER``); a snapshot's rows arrive in one micro-batch.

    A snapshot without clusters is a row whose cluster is null, so that time passes for its network.
    """
    with_state_store(clusters.sparkSession)
    keyed = clusters.select(F.coalesce("network", F.lit("")).alias("network"), *CLUSTER).groupBy("network")
    return keyed.transformWithStateInPandas(RegistryProcessor(), StructType.fromDDL(REPORT), "Append", "none")


def registry_batch(clusters: DataFrame) -> DataFrame:
    """The same reports of a table: networks one after the other in sorted partitions, one snapshot held at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        registry, at, held = None, None, []
        for frame in frames:
            for (network, when), rows in frame.groupby(["network", "at_us"], sort=False, dropna=False):
                if registry is not None and (network, when) != (registry.network, at):
                    yield _frame(registry.update(at, held))
                    held = []
                if registry is None or network != registry.network:
                    registry = Registry(network)
                at = int(when)
                held += _clusters(rows)
        if registry is not None:
            yield _frame(registry.update(at, held))

    rows = clusters.select(F.coalesce("network", F.lit("")).alias("network"), *CLUSTER).repartition("network").sortWithinPartitions("network", "at_us")
    return rows.mapInPandas(run, REPORT)
