"""Tables whose rows change: a base, changes merged as they are read, and one commit over several tables.

A change writes only its own rows. Reading takes of each key the row of the last
change that names it, else the base's; the changed keys are few against the base, so
they are broadcast (behind a count) and the base isn't shuffled. `compact` makes
base and changes one again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import history
from siftline.operators.retrieval import small

from .log import Log

#: Changes of a table that are merged into its base at the next write.
MOST_CHANGES = 20


@dataclass
class Edit:
    """Changes to several tables that become visible together. read: what it was worked out from; where that has changed meanwhile, it is worked out again."""

    puts: dict[str, DataFrame] = field(default_factory=dict)
    deletes: dict[str, DataFrame] = field(default_factory=dict)
    read: tuple[str, ...] = ()


class RowTables:
    """keys: the key columns of each table."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, Sequence[str]]):
        self.log, self.keys = Log(spark, root), {name: list(k) for name, k in keys.items()}

    def read(self, name: str, state: dict | None = None) -> DataFrame | None:
        """The rows as they are, or as a state has them; None where nothing was written yet."""
        entry = (self.log.state()[1] if state is None else state).get(name)
        if not entry:
            return None
        keys, base = self.keys[name], self.log.read(entry["base"]) if entry["base"] else None
        changes = None
        for at, folder in enumerate(entry["changes"]):
            one = self.log.read(folder).withColumn("_at", F.lit(at))
            changes = one if changes is None else changes.unionByName(one, allowMissingColumns=True)
        if changes is None:
            return base
        columns = [c for c in changes.columns if c not in (*keys, "_at")]
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_at").alias("_row"))
        kept = last.where("not _row._gone").select(*keys, *[F.col("_row").getField(c).alias(c) for c in columns if c != "_gone"])
        if base is None:
            return kept
        named = small(changes.select(*[F.col(k).alias(f"_k{k}") for k in keys]).distinct())
        same = [base[k].eqNullSafe(named[f"_k{k}"]) for k in keys]
        return base.join(named, same, "left_anti").unionByName(kept, allowMissingColumns=True)

    def _folders(self, edit: Edit) -> dict[str, str]:
        out = {}
        for name in {*edit.puts, *edit.deletes}:
            keys, parts = self.keys[name], []
            if name in edit.puts:
                parts.append(edit.puts[name].withColumn("_gone", F.lit(False)))
            if name in edit.deletes:
                parts.append(edit.deletes[name].select(*keys).withColumn("_gone", F.lit(True)))
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
            out[name] = self.log.write(name, rows)
        return out

    def commit(self, make: Callable[[dict], Edit | None], tries: int = 20) -> bool:
        """Commit the edit that make(state) gives, all of its tables at once; None commits nothing.

        An edit that read tables is made again where another commit changed one
        of them after the state it saw; other edits just join those before them.
        A key that an edit both puts and deletes is put.
        """
        for _ in range(tries):
            number, seen = self.log.state()
            edit = make(seen)
            if edit is None:
                return False
            folders = self._folders(edit)
            stale: list[str] = []

            def join(state: dict, seen: dict = seen, edit: Edit = edit, folders: dict = folders, stale: list = stale) -> dict:
                stale[:] = [name for name in edit.read if state.get(name) != seen.get(name)]
                if not stale:
                    for name, folder in folders.items():
                        entry = state.setdefault(name, {"base": None, "changes": []})
                        entry["changes"] = [*entry["changes"], folder]
                return state

            after = self.log.change(join)
            if not stale:
                for name in folders:
                    if len(after[name]["changes"]) > MOST_CHANGES:
                        self.compact(name)
                return True
        raise RuntimeError(f"the tables read changed {tries} times")

    def put(self, name: str, rows: DataFrame) -> None:
        self.commit(lambda _: Edit(puts={name: rows}))

    def delete(self, name: str, keys: DataFrame) -> None:
        self.commit(lambda _: Edit(deletes={name: keys}))

    def compact(self, name: str) -> None:
        """Base and changes as a new base; changes that others make meanwhile stay changes. A compaction that another one overtook is dropped."""
        seen = self.log.state()[1].get(name)
        rows = self.read(name, {name: seen}) if seen else None
        if rows is None or not seen["changes"]:
            return
        base = self.log.write(name, rows)

        def swap(state: dict) -> dict:
            entry = state[name]
            if entry["base"] == seen["base"] and entry["changes"][: len(seen["changes"])] == seen["changes"]:
                state[name] = {"base": base, "changes": entry["changes"][len(seen["changes"]) :]}
            return state

        self.log.change(swap)

    def tidy(self, keep: int = 10) -> int:
        """Delete files that none of the last states names."""
        return self.log.tidy(keep, lambda state: {f for e in state.values() for f in (e["base"], *e["changes"]) if f})


RUN_TABLES = {"runs": ["run_id"], "run_texts": ["run_id"], "variants": ["variant_id"], "import_bullets": ["session_id", "id"], "import_clusters": ["session_id", "cluster_id"], "import_resolutions": ["session_id", "cluster_id"]}


class RunStore:
    """Runs, their texts, variants and import sessions, changed row by row."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, RowTables(spark, root, RUN_TABLES)

    def add(self, runs: DataFrame, texts: DataFrame | None = None) -> None:
        """Runs, and the texts (run_id, text) that belong to them, in one commit."""
        self.tables.commit(lambda _: Edit(puts={"runs": runs} | ({"run_texts": texts} if texts is not None else {})))

    def _one(self, state: dict, name: str, run_id: str) -> DataFrame | None:
        rows = self.tables.read(name, state)
        return None if rows is None else rows.where(F.col("run_id") == run_id)

    def update(self, run_id: str, fields: dict[str, str]) -> bool:
        """Replace editable fields of one run; whether there is such a run. Only that run's row is written."""

        def make(state: dict) -> Edit | None:
            mine = self._one(state, "runs", run_id)
            if mine is None or mine.isEmpty():
                return None
            return Edit(puts={"runs": history.updated(mine, run_id, fields)}, read=("runs",))

        return self.tables.commit(make)

    def delete(self, run_id: str) -> bool:
        """A run goes with its text; whether there was one."""
        key = self.spark.createDataFrame([(run_id,)], "run_id string")

        def make(state: dict) -> Edit | None:
            mine = self._one(state, "runs", run_id)
            if mine is None or mine.isEmpty():
                return None
            return Edit(deletes={"runs": key, "run_texts": key})

        return self.tables.commit(make)

    def text(self, run_id: str) -> str | None:
        found = self._one(self.tables.log.state()[1], "run_texts", run_id)
        rows = [] if found is None else found.select("text").take(1)
        return rows[0].text if rows else None

    def apply_usage(self, flag: str = "variant_usage_applied") -> bool:
        """Add the usage of runs not applied yet to their variants and flag these runs, both in one commit; whether there was any.

        A crash before the commit leaves both tables as they were, one after it
        both changed; so calling again never counts a run twice.
        """

        def make(state: dict) -> Edit | None:
            runs, variants = self.tables.read("runs", state), self.tables.read("variants", state)
            if runs is None or variants is None:
                return None
            todo = runs.where(~F.coalesce(F.col(flag), F.lit(False)))
            if todo.isEmpty():
                return None
            usage = history.pending_usage(todo, flag)
            touched = variants.join(small(usage.select("variant_id")), "variant_id", "left_semi")
            return Edit(puts={"variants": history.apply_usage(touched, usage), "runs": todo.withColumn(flag, F.lit(True))}, read=("runs", "variants"))

        return self.tables.commit(make)

    def save_session(self, bullets: DataFrame, clusters: DataFrame, resolutions: DataFrame) -> None:
        """The rows of an import session, or those of them that changed, in one commit."""
        self.tables.commit(lambda _: Edit(puts={"import_bullets": bullets, "import_clusters": clusters, "import_resolutions": resolutions}))

    def session(self, session_id: str) -> tuple[DataFrame, ...] | None:
        state = self.tables.log.state()[1]
        found = [self.tables.read(name, state) for name in ("import_bullets", "import_clusters", "import_resolutions")]
        if any(df is None for df in found):
            return None
        mine = tuple(df.where(F.col("session_id") == session_id) for df in found)
        return None if mine[0].isEmpty() else mine
