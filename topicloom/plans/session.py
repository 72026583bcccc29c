"""One corpus and what is done to it over time: settings, a result to edit, apply and undo, and where a run stands."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from topicloom.operators import apply as applying
from topicloom.operators import clustering, results, tree
from topicloom.operators.tree import FolderFilter
from topicloom.plans import topics

METHODS = ("both", "notebooks", "tags")


@dataclass
class Settings:
    parent: str = ""  # folder under which an apply makes its folders; empty: at the top
    method: str = "both"
    filter: FolderFilter = field(default_factory=FolderFilter)

    def to_json(self) -> str:
        f = self.filter
        return json.dumps({"parent": self.parent, "method": self.method, "filter": {"mode": f.mode, "selectedFolderIds": list(f.selected), "includeSubNotebooks": f.with_descendants}})

    @classmethod
    def of_json(cls, raw: str) -> Settings:
        """Settings as they were stored; whatever can't be read falls back to its default."""
        try:
            given = json.loads(raw)
        except ValueError:
            given = None
        given = given if isinstance(given, dict) else {}
        method = given.get("method")
        return cls(str(given.get("parent") or ""), method if method in METHODS else "both", FolderFilter.parse(json.dumps(given.get("filter"))))


def percent(done: int, total: int) -> int:
    """Progress to show: halves round up, nothing to do counts as none done."""
    return int(100 * done / total + 0.5) if total > 0 else 0


class Busy(RuntimeError):
    """An operation that changes the corpus is under way."""


class Session:
    """The corpus ``state`` with note vectors (note_id, vector); notes need note_idx.

    Apply, undo and a run of the clustering exclude each other: a second one raises ``Busy`` at once. The last apply
    alone can be undone, once.
    """

    def __init__(self, state: applying.State, vectors: DataFrame, settings: Settings | None = None, ask: Callable | None = None):
        self.state, self.vectors, self.ask = state, vectors, ask
        self.settings = settings or Settings()
        self.result: topics.Topics | None = None
        self.selected = 0
        self.status, self.error, self.progress = "idle", "", 0
        self.log: applying.ChangeLog | None = None
        self._lock = threading.Lock()

    @contextmanager
    def _alone(self, status: str) -> Iterator[None]:
        if not self._lock.acquire(blocking=False):
            raise Busy(f"{self.status} is under way")
        self.status, self.error, self.progress = status, "", 0
        try:
            yield
            self.status = "idle" if self.result is None else "ready"
        except Exception as e:
            self.status, self.error = "failed", str(e)
            raise
        finally:
            self._lock.release()

    def update(self, **changes) -> Settings:
        """Settings with some of them changed; an unknown name or method is an error."""
        if changes.get("method", "both") not in METHODS:
            raise ValueError(f"no method {changes['method']}")
        self.settings = replace(self.settings, **changes)
        return self.settings

    def folders(self) -> DataFrame:
        """The folder tree with the number of notes in each folder."""
        return tree.folder_tree(self.state.folders, tree.note_counts(self.state.notes))

    def run(self, config: clustering.Config | None = None) -> topics.Topics:
        """Cluster and label the notes that the filter lets through; the strategy shown is the first k-means."""
        with self._alone("clustering"):
            notes = tree.notes_in(self.state.notes, self.state.folders, self.settings.filter)
            self.progress = percent(1, 3)
            self.result = topics.run(notes, self.vectors, self.ask, config=config)
            self.progress = percent(2, 3)
            self.selected = results.default_strategy(self.strategies())
            self.progress = 100
        return self.result

    def poll(self) -> dict:
        """Where things stand, for a view that asks again and again."""
        return {"status": self.status, "error": self.error, "progress": self.progress, "strategies": self.strategies(), "selected": self.selected, "can_undo": self.log is not None}

    def strategies(self) -> list[str]:
        """Names, the best silhouette first: a handful, as many as the configuration names."""
        return [] if self.result is None else [r["strategy"] for r in self.result.summary.orderBy(self.result.summary["silhouette"].desc()).collect()]

    def select(self, index: int) -> None:
        if not 0 <= index < len(self.strategies()):
            raise IndexError(f"no strategy {index}")
        self.selected = index

    def shown(self) -> tuple[DataFrame, DataFrame]:
        """(assignments, clusters) of the selected strategy."""
        if self.result is None:
            raise ValueError("nothing has been clustered")
        name = self.strategies()[self.selected]
        return tuple(t.where(t["strategy"] == name).drop("strategy") for t in (self.result.assignments, self.result.clusters))

    def sync(self, assignments: DataFrame, clusters: DataFrame) -> None:
        """Take an edited result in place of the selected strategy's."""
        name, r = self.strategies()[self.selected], self.result
        both = []
        for whole, own in ((r.assignments, assignments), (r.clusters, clusters)):
            own = own.selectExpr(f"'{name}' AS strategy", *[f"`{c}`" for c in own.columns])
            both.append(whole.where(whole["strategy"] != name).unionByName(own, allowMissingColumns=True))
        self.result = topics.Topics(r.summary, *both)

    def note(self, note_id: str) -> dict | None:
        """One note to open."""
        row = self.state.notes.where(self.state.notes["note_id"] == note_id).first()
        return row.asDict() if row else None

    def apply(self, timestamp: int = 0) -> str:
        """Move and tag notes as the shown result says; its summary."""
        assignments, clusters = self.shown()
        with self._alone("applying"):
            self.state, self.log = applying.apply(self.state, assignments, clusters, self.settings.method, self.settings.parent, timestamp)
            return self.log.summary()

    def undo(self) -> None:
        """Take back the last apply."""
        with self._alone("undoing"):
            self.state = applying.undo(self.state, self.log)
            self.log = None
