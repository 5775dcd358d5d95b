"""The minimal cover of a table under inserts, updates and deletes, a batch at a time.

For each key the engine keeps difference sets, each with the ids of up to PROOFS pairs of rows that prove it, and the minimal
hitting sets of them, which follow each difference set that comes or goes. They are the candidates: Spark jobs judge
them together, broken ones yield difference sets of rows that break them, and the loop ends when no candidate is broken. Then
the candidates are the minimal valid contexts: a valid context hits every difference set, so it contains one of them.

Inserts only add difference sets. A delete takes pairs away; while a set has another pair nothing is judged, and when the last
one goes, the contexts that it kept invalid become candidates. Of an updated row the pairs are compared anew: they prove the
set in which they differ now, which without the changed attributes is the old one, so no key and context without these is judged.
The data stay in DataFrames; the driver holds masks and pairs of ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.cluster import Tables
from tidewright.model import Key, OrderDependency, all_keys, to_frame
from tidewright.operators.validate import Pair, broken, neighbours, range_bounds, touched, witnesses
from tidewright.plans.lattice import HittingSets, contexts_of, cover, evidence_of, maximal_invalid

OPERATIONS = ("insert", "update", "delete")
#: Net changes up to so many rows are broadcast to the table; beyond, the join is dealt out by record id.
BROADCAST_CHANGES = 200_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_CHANGES rows."""
    return F.broadcast(df) if df.limit(BROADCAST_CHANGES + 1).count() <= BROADCAST_CHANGES else df


#: So many ids are written into a filter, which reaches the files' statistics; more are joined.
FILTERED_IDS = 1_000


def of_ids(df: DataFrame, tid: str, ids: Sequence[int]) -> DataFrame:
    """The rows of df with ids that the driver holds: those of proofs."""
    if len(ids) <= FILTERED_IDS:
        return df.where(F.col(tid).isin(list(ids)))
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(i,) for i in ids], f"`{tid}` long")), tid, "left_semi")


#: Changes are appended as tables of their own; behind so many the table is written anew.
COMPACT = 16
#: Pairs of rows that are kept for each difference set.
PROOFS = 4
_PROOF = "left int, right int, same boolean, mask long, t1 long, t2 long"


class Evidence:
    """The difference sets of a key, the pairs that prove them, and the contexts that hit them all."""

    def __init__(self, masks: Iterable[int] = ()):
        #: pairs of each set; none where a set was taken from a cover that came without them
        self.pairs: dict[int, set[Pair]] = {m: set() for m in masks}
        self.hitting = HittingSets(self.pairs)

    def add(self, mask: int, pairs: Iterable[Pair]) -> bool:
        """Whether the set is new; a set has PROOFS pairs at most."""
        new = mask not in self.pairs
        own = self.pairs.setdefault(mask, set())
        own.update(list(pairs)[: PROOFS - len(own)])
        if new:
            self.hitting.add(mask)
        return new

    def lose(self, mask: int, pairs: Iterable[Pair] = ()) -> bool:
        """Takes pairs of a set away; whether it had no other and is gone."""
        own = self.pairs[mask]
        own.difference_update(pairs)
        if own:
            return False
        del self.pairs[mask]
        self.hitting.remove(mask)
        return True

    @property
    def contexts(self) -> set[int]:
        return self.hitting.sets


class OdEngine:
    """Maintains the minimal cover of a table of orderable, null-free columns (rank-encode others first; nulls are errors).

    rows: the start of the table, with a unique id in `tid` (and, for changes by record, `rid`); ods: its cover if known.
    A batch costs what it changes: rows are appended or left out by their ids, a context that held before is judged only in
    classes that a changed row is in, and contexts are judged on the whole table only where the last proof against them went.
    judged: the dependencies that the last batch judged, on the whole table (True) or near changed rows (False).
    """

    def __init__(self, rows: DataFrame, columns: Iterable[str], ods: Iterable[OrderDependency] | None = None, tid: str = "_tid"):
        self._start(rows, columns, tid)
        self.evidence = {k: Evidence() for k in self.keys}
        self.contexts: dict[Key, set[int]] = {}
        if ods is not None:
            self.contexts = contexts_of(ods, self.keys)
            self.evidence = {k: Evidence(e) for k, e in evidence_of(self.contexts).items()}
        elif self.size:
            for key, mask, pairs in neighbours(self.rows, self.columns, self.keys, tid, self.size):
                self.evidence[key].add(mask, pairs)
            self.refine()
        else:
            self.contexts = {k: set(e.contexts) for k, e in self.evidence.items()}

    def _start(self, rows: DataFrame, columns: Iterable[str], tid: str) -> None:
        self.columns, self.tid = list(columns), tid
        if len(self.columns) > 62:
            raise ValueError("contexts are 62 columns wide at most")
        self.keys = all_keys(len(self.columns))
        self.tables, self.spent, self.batches = Tables(rows.sparkSession), None, 0
        self.judged: dict[OrderDependency, bool] = {}
        self.counts = dict.fromkeys(("whole", "near", "spared", "broken", "rounds", "compactions"), 0)
        self.rows = self.tables.write(rows.select(tid, *self.columns))
        self.size = self._checked(self.rows)
        self.bounds = range_bounds(self.rows, self.columns) if self.size else {}

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def _checked(self, rows: DataFrame) -> int:
        """How many rows there are, or an error if a value is null (null differs from nothing, so no order says what it breaks) or an id comes twice."""
        found = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in (self.tid, *self.columns)]).first().asDict()
        n = found.pop("_n")
        if any(found.values()):
            raise ValueError(f"null values in {[c for c, n in found.items() if n]}: rank-encode or remove them first")
        if not rows.groupBy(self.tid).count().where("count > 1").isEmpty():
            raise ValueError(f"an id in {self.tid} comes twice")
        return n

    def refine(self, added: DataFrame | None = None, changed: str | None = None) -> int:
        """Judges candidates until none is broken; the number of rounds.

        added: rows that the known contexts were not judged on; changed: its column with the mask of attributes that are new in a row.
        """
        held = {k: set(c) for k, c in self.contexts.items()}
        valid: dict[Key, set[int]] = {k: set() for k in self.keys}
        near = None if added is None else touched(self.rows, self.columns, added, changed)
        moved = [-1] if changed is None or added is None else [r[0] for r in added.select(changed).distinct().collect()]  # a mask for each way to change a row
        self.judged, rounds = {}, 0
        while True:
            wanted = {k: e.contexts for k, e in self.evidence.items()}
            # a compatible key holds where one of its sides is known to be constant
            fixed = {k: [c for s in (Key(k.left), Key(k.right)) for c in valid[s]] if not k.constant else [] for k in self.keys}
            open_ods = {OrderDependency(k, c) for k, found in wanted.items() for c in found - valid[k] if not any(f & c == f for f in fixed[k])}
            if not open_ods:
                self.contexts = {k: set(c) for k, c in wanted.items()}
                return rounds
            # constants first: they may settle compatibles without a job
            first = {od for od in open_ods if od.key.constant} or open_ods
            # what held before can be broken by added rows alone, and only by those that are new in one of its attributes
            known = {od for od in first if any(c & od.context == c for c in held.get(od.key, ()))}
            asked = {od for od in known if near is not None and any((od.context | od.key.mask) & m for m in moved)}
            failed = broken(self.rows, self.columns, first - known, bounds=self.bounds) if first - known else set()
            if asked:
                failed |= broken(self.rows, self.columns, asked, near, self.bounds)
            self.judged |= dict.fromkeys(first - known, True) | dict.fromkeys(asked, False)
            for name, ods in (("whole", first - known), ("near", asked), ("spared", known - asked), ("broken", failed)):
                self.counts[name] += len(ods)
            self.counts["rounds"] += 1
            for od in first - failed:
                valid[od.key].add(od.context)
            news = 0
            for ods, rows in ((failed & known, near), (failed - known, None)):
                if ods:
                    for key, mask, pairs in witnesses(self.rows, self.columns, ods, self.tid, rows, self.bounds):
                        news += self.evidence[key].add(mask, pairs)
            if failed and not news:
                raise RuntimeError("a dependency was found broken without a proof against it")
            rounds += 1

    def _write(self, rows: DataFrame) -> DataFrame:
        """The new state of the table, written anew behind COMPACT batches."""
        self.batches += 1
        if self.spent:  # the tables of the state before the last one written anew
            self.spent.clear()
            self.spent = None
        if self.batches % COMPACT:
            return rows
        self.spent, self.tables = self.tables, Tables(self.spark)
        self.counts["compactions"] += 1
        return self.tables.write(rows)

    def insert(self, delta: DataFrame) -> None:
        """Adds rows (tid and columns); an id that the table has is an error."""
        delta = self._new(delta)
        if delta is not None:
            self.rows = self._write(self.rows.unionByName(delta))
            self.refine(delta)

    def insert_judged(self, delta: DataFrame) -> None:
        """Adds rows whose difference sets are known (see timeline)."""
        delta = self._new(delta)
        if delta is not None:
            self.rows = self._write(self.rows.unionByName(delta))

    def _new(self, delta: DataFrame) -> DataFrame | None:
        """delta as a table of its own (none if it has no rows), or an error if an id of it is known."""
        delta = self.tables.write(delta.select(self.tid, *self.columns))
        if not self._checked(delta):
            return None
        known = self.rows.join(small(delta.select(self.tid)), self.tid, "left_semi").select(self.tid).head()
        if known:
            raise ValueError(f"insert of a known record: {known[0]}")
        return delta

    def delete(self, ids: DataFrame) -> None:
        """Removes the rows whose id is in ids (all of them known); pairs that lost a row are dropped, then candidates are judged anew."""
        ids = self.tables.write(ids.select(F.col(self.tid)).distinct())
        unknown = ids.join(self.rows.join(small(ids), self.tid, "left_semi").select(self.tid), self.tid, "left_anti").head()
        if unknown:
            raise ValueError(f"delete of an unknown record: {unknown[0]}")
        self._drop_lost(ids)
        self.rows = self._write(self.rows.join(small(ids), self.tid, "left_anti"))
        self.refine()

    def _drop_lost(self, ids: DataFrame, stays: str | None = None) -> dict[Pair, set[Key]]:
        """Drops pairs that lost a row, and sets without proof; of an update (stays) the pairs whose rows all are still there, by pair."""
        proven = {p for e in self.evidence.values() for own in e.pairs.values() for p in own}
        gone: dict[int, bool] = {}
        if proven:
            ends = self.spark.createDataFrame([(t,) for t in sorted({t for p in proven for t in p})], f"{self.tid} long")
            gone = {r[0]: bool(r[1]) for r in ids.join(F.broadcast(ends), self.tid).select(self.tid, F.col(stays) if stays else F.lit(False)).collect()}
        again: dict[Pair, set[Key]] = {}
        for key, evidence in self.evidence.items():
            for mask, own in list(evidence.pairs.items()):
                lost = {p for p in own if any(t in gone for t in p)}
                if lost or not own:
                    for p in lost:
                        if all(gone.get(t, True) for t in p):
                            again.setdefault(p, set()).add(key)
                    evidence.lose(mask, lost)
        return again

    def _compare_again(self, pairs: dict[Pair, set[Key]]) -> None:
        """Adds the sets that pairs prove with the values their rows have now, for the keys that they still break."""
        ids = sorted({t for p in pairs for t in p})
        if not ids:
            return
        now = {r[0]: tuple(r)[1:] for r in of_ids(self.rows, self.tid, ids).select(self.tid, *self.columns).collect()}
        for pair, keys in pairs.items():
            x, y = now[pair[0]], now[pair[1]]
            mask = sum(1 << i for i, (a, b) in enumerate(zip(x, y)) if a != b)
            for key in keys:
                apart = mask & key.mask == key.mask
                if apart and (key.constant or (((x[key.left] < y[key.left]) != (x[key.right] < y[key.right])) == key.same)):
                    self.evidence[key].add(mask & ~key.mask, [pair])

    def apply(self, changes: DataFrame, rid: str = "_rid", operation: str = "_op", sequence: str = "_seq") -> None:
        """One batch of inserts, updates and deletes by record id (the table's tid), in the order of sequence.

        The batch counts as its net effect: the last state of each record. Unknown operations, updates and deletes of
        unknown records and inserts of known ones are errors. Repeated rows with one sequence number have an arbitrary order.
        """
        checked = changes.withColumn("_op", F.lower(F.trim(F.col(operation))))
        first = F.min_by("_op", F.col(sequence))
        last = F.max_by(F.struct("_op", *self.columns), F.col(sequence))
        net = self.tables.write(checked.groupBy(F.col(rid).cast("long").alias(self.tid)).agg(first.alias("first"), last.alias("last"), F.max(~F.col("_op").isin(*OPERATIONS) | F.col("_op").isNull()).alias("unknown")))
        old = self.rows.join(small(net.select(self.tid)), self.tid, "left_semi").select(F.col(self.tid).alias("known"), F.struct(*self.columns).alias("old"))
        new = [F.when(F.col(f"old.{c}").eqNullSafe(F.col(f"last.{c}")), F.lit(0)).otherwise(F.lit(1 << i)).cast("long") for i, c in enumerate(self.columns)]
        wrong = F.when(F.col("unknown"), "unknown operation").when((F.col("first") == "insert") & F.col("known").isNotNull(), "insert of a known record").when((F.col("first") != "insert") & F.col("known").isNull(), "change of an unknown record")
        moved = F.when(F.col("known").isNull(), F.lit((1 << len(self.columns)) - 1).cast("long")).otherwise(sum(new[1:], new[0]))
        judged = self.tables.write(net.join(old, net[self.tid] == F.col("known"), "left").withColumn("wrong", wrong).withColumn("stays", F.col("last._op") != "delete").withColumn("_moved", moved))
        bad = judged.where("wrong is not null").select(self.tid, "wrong").head()
        if bad:
            raise ValueError(f"{bad.wrong}: {bad[0]}")
        # rows that are as they were before the batch change nothing, and a deleted id may come back with other values
        gone = judged.where("known is not null and (not stays or _moved <> 0)").select(self.tid, "stays")
        fresh = self.tables.write(judged.where("stays and _moved <> 0").select(self.tid, "last.*", "_moved").drop("_op"))
        added = fresh if self._checked(fresh.drop("_moved")) else None
        again = self._drop_lost(gone, "stays")
        self.rows = self._write(self.rows.join(small(gone.select(self.tid)), self.tid, "left_anti").unionByName(fresh.drop("_moved")))
        self._compare_again(again)
        self.refine(added, "_moved" if added is not None else None)

    def ods(self) -> set[OrderDependency]:
        return cover(self.contexts)

    def non_ods(self) -> set[OrderDependency]:
        """The maximal contexts in which a key does not hold."""
        return maximal_invalid({k: e.hitting.least for k, e in self.evidence.items()}, len(self.columns))

    def statistics(self, operations: int, elapsed_ms: int, ods: Iterable[OrderDependency] | None = None, non_ods: Iterable[OrderDependency] | None = None, highest_id: int | None = None) -> dict:
        """A row of statistics: the state (this one, or the one given; highest_id is -1 without rows), what was judged since the start, and what is kept."""
        ods, non_ods = (set(self.ods() if ods is None else ods), set(self.non_ods() if non_ods is None else non_ods))
        runtime = self.spark._jvm.java.lang.Runtime.getRuntime()
        split = lambda found: (sum(od.key.constant for od in found), sum(not od.key.constant for od in found))
        (constant, compatible), (no_constant, no_compatible) = split(ods), split(non_ods)
        top = self.rows.agg(F.coalesce(F.max(self.tid), F.lit(-1))).first()[0] if highest_id is None else highest_id
        return {
            "highest_id": top, "operations": operations, "constant_ods": constant, "constant_non_ods": no_constant, "compatible_ods": compatible, "compatible_non_ods": no_compatible,
            "elapsed_ms": elapsed_ms, "judged": self.counts["whole"] + self.counts["near"], "judged_whole": self.counts["whole"], "judged_near": self.counts["near"], "spared": self.counts["spared"],
            "rounds": self.counts["rounds"], "compactions": self.counts["compactions"], "driver_max_bytes": int(runtime.maxMemory()), "driver_used_bytes": int(runtime.totalMemory() - runtime.freeMemory()),
            "contexts": len({od.context for od in ods}), "proofs": sum(len(own) for e in self.evidence.values() for own in e.pairs.values()),
        }

    def to_frame(self) -> DataFrame:
        return to_frame(self.spark, self.ods(), self.columns)

    def save(self, path: str) -> None:
        """Writes the table, the proofs and, last, what it takes to read them: a snapshot that load() goes on from."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        proofs = [(k.left, k.right, k.same, m, *p) for k, e in self.evidence.items() for m, own in e.pairs.items() for p in own or [(None, None)]]
        self.spark.createDataFrame(proofs, _PROOF).coalesce(1).write.mode("overwrite").parquet(f"{path}/proofs")
        about = json.dumps({"columns": self.columns, "tid": self.tid})
        self.spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OdEngine:
        """The engine of a snapshot, without a judgement: its difference sets say all."""
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        engine = cls.__new__(cls)
        engine._start(spark.read.parquet(f"{path}/rows"), about["columns"], about["tid"])
        engine.evidence = {k: Evidence() for k in engine.keys}
        for r in spark.read.schema(_PROOF).parquet(f"{path}/proofs").collect():
            engine.evidence[Key(r.left, r.right, r.same)].add(r["mask"], [] if r.t1 is None else [(r.t1, r.t2)])
        engine.contexts = {k: set(e.contexts) for k, e in engine.evidence.items()}
        return engine


def discover(df: DataFrame, columns: Sequence[str]) -> set[OrderDependency]:
    """The minimal cover of df; df needs no ids."""
    columns = list(columns)
    engine = OdEngine(df.select(F.monotonically_increasing_id().alias("_tid"), *columns), columns)
    engine.tables.clear()
    return engine.ods()
