"""Refreshes as a stream of fetched documents (X1-X9), and admission with keyed state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark import constants as C
from tidemark.operators.run import refresh
from tidemark.sources.store import Store


def ingest_stream(fetches: DataFrame, store: Store, checkpoint: str, *, limit: int = C.MAX_NEW_PER_SOURCE_PER_RUN, listings: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run a refresh for each micro-batch of fetches(…FETCHES, fetched_at), and stop when the input is used up.

    The time of a refresh is the latest ``fetched_at`` in it, so that a replay gives the same rows. The state of a source is the stored mark, not a
    watermark of the whole query: sources are late independently. All fetches of a source within a batch are read, oldest first, in a refresh
    each, as they would be one a batch. ``listings`` fetches the listing pages of feeds that failed, as in ``refresh``.

    A batch that this query already wrote is skipped by its number, and its refreshes by theirs. The query is known by the id in its
    checkpoint, so a new checkpoint's batch 0 is another one, also where its folder had a query before.
    """

    def run(batch: DataFrame, number: int) -> None:
        writer = json.loads(Store(store.spark, checkpoint).content("metadata") or "{}").get("id", checkpoint)
        # equal times in an order that a replay repeats
        order = Window.partitionBy("source_id").orderBy("fetched_at", F.xxhash64(*batch.columns))
        dated = batch.where("fetched_at is not null").withColumn("turn", F.row_number().over(order)).persist()
        times = dict(dated.groupBy("turn").agg(F.max("fetched_at")).collect())
        done, _, part = (store.batch(writer) or "").partition(".")
        for turn in range(int(part or 0) + 1 if done == str(number) else 1, len(times) + 1):
            rows = dated.where(F.col("turn") == turn).drop("turn", "fetched_at")
            refresh(store, rows, listings, times[turn], limit=limit, batch=f"{number}.{turn}", writer=writer)
        dated.unpersist()

    return fetches.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Microseconds of a day, parts that the keys of a day are kept in, keys of a piece of a part at which the next begins, and candidates that are looked up at once.
_DAY, _PARTS, _PIECE, _AT_ONCE = 86_400_000_000, 64, 4096, 1 << 19


class _Admission(StatefulProcessor):
    """Of each source: its mark, the keys that were admitted and could be again, and the candidates that wait for a place.

    State is asked for lists of keys, never for single ones. Keys stand by a part that their hash tells, and there by day and in pieces, so that candidates
    are looked up part by part, those of days below mark - grace are dropped as a whole, and what is added rewrites a piece a day and part at most. What waits
    stands by day, so that the oldest are found by reading the oldest days only.
    """

    def __init__(self, limit: int | None):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "at long")
        self.known = handle.getMapState("known", "part int, day long, piece int", "ids array<string>")
        self.waiting = handle.getMapState("waiting", "day long, piece int", "ids array<string>, ats array<long>")

    def _pieces(self) -> dict[int, list[tuple[int, int]]]:
        """The (day, piece) of each part."""
        out: dict[int, list[tuple[int, int]]] = {}
        for part, day, piece in self.known.keys() if self.known.exists() else ():
            out.setdefault(part, []).append((day, piece))
        return out

    def _new(self, rows: pd.DataFrame, pieces: dict[int, list[tuple[int, int]]]) -> pd.DataFrame:
        """The rows (at, id, part) whose keys are not known, once each: of dates that differ the earliest."""
        rows = rows.sort_values(["at", "id"], kind="stable").drop_duplicates("id")
        rows = rows.assign(part=pd.util.hash_array(rows["id"].to_numpy(object), categorize=False) % _PARTS)
        out = [rows.iloc[:0]]
        for part, some in rows.groupby("part"):
            known = [i for day, piece in pieces.get(part, ()) for i in self.known.getValue((int(part), day, piece))[0]]
            out.append(some[~some["id"].isin(known)] if known else some)
        return pd.concat(out).sort_values(["at", "id"], kind="stable")

    def _learn(self, rows: pd.DataFrame, pieces: dict[int, list[tuple[int, int]]]) -> None:
        """Remember keys of rows(at, id, part)."""
        for (part, day), some in rows.groupby(["part", rows["at"] // _DAY]):
            part, day, ids, had = int(part), int(day), some["id"].tolist(), []
            last = max((piece for d, piece in pieces.get(part, ()) if d == day), default=-1)
            if last >= 0:
                had = list(self.known.getValue((part, day, last))[0])
            if last < 0 or len(had) >= _PIECE:
                last, had = last + 1, []
                pieces.setdefault(part, []).append((day, last))
            self.known.updateValue((part, day, last), (had + ids,))

    def _forget(self, before: int, pieces: dict[int, list[tuple[int, int]]]) -> None:
        """Drop the keys of whole days before a time."""
        for part, own in pieces.items():
            for day, piece in own:
                if (day + 1) * _DAY <= before:
                    self.known.removeKey((part, day, piece))

    def _wait(self, rows: pd.DataFrame) -> None:
        had = [tuple(k) for k in self.waiting.keys()] if self.waiting.exists() else []
        for day, some in rows.groupby(rows["at"] // _DAY):
            piece = 1 + max((n for d, n in had if d == day), default=-1)
            self.waiting.updateValue((int(day), piece), (some["id"].tolist(), some["at"].tolist()))

    def _next(self) -> tuple[list[tuple[int, str]], bool]:
        """(the oldest ``limit`` of what waits, whether more does)."""
        taken: list[tuple[int, str]] = []
        days: dict[int, list[int]] = {}
        for day, piece in self.waiting.keys() if self.waiting.exists() else ():
            days.setdefault(day, []).append(piece)
        for day in sorted(days):
            room = self.limit - len(taken)
            if room <= 0:
                return taken, True
            rows: list[tuple[int, str]] = []
            for piece in days[day]:
                ids, ats = self.waiting.getValue((day, piece))
                rows += zip(ats, ids, strict=True)
                self.waiting.removeKey((day, piece))
            rows.sort()
            taken += rows[:room]
            if len(rows) > room:
                self.waiting.updateValue((day, 0), ([i for _, i in rows[room:]], [at for at, _ in rows[room:]]))
                return taken, True
        return taken, False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = self.mark.get()[0] if self.mark.exists() else None
        grace = C.NEW_ITEM_GRACE_DAYS * _DAY
        first, latest, added, new = None, None, None, None
        pieces = {} if mark is None else self._pieces()
        for some in _gathered(rows):
            fresh = some[["at", "id"]] if mark is None else some.loc[some["at"] > mark - grace, ["at", "id"]]
            if not len(fresh):
                continue
            newest = int(fresh["at"].max())
            latest = max(newest, latest or newest)
            if mark is None:
                found = (newest, fresh.loc[fresh["at"] == newest, "id"].max())
                first = max(found, first or found)
                continue
            if new is not None:  # the rest of the batch may repeat its keys
                self._learn(new, pieces)
            new = self._new(fresh, pieces)
            if self.limit is not None:
                self._wait(new)
            elif len(new):
                yield self._shaped(new["id"].tolist(), new["at"].tolist(), key)
        more = False
        if first is not None:
            new = pd.DataFrame({"at": [first[0]], "id": [first[1]], "part": pd.util.hash_array(pd.Series([first[1]]).to_numpy(object), categorize=False) % _PARTS})
            yield self._shaped([first[1]], [first[0]], key)
        elif mark is not None and self.limit is not None:
            taken, more = self._next()
            added = taken[-1][0] if taken else None
            if taken:
                yield self._shaped([i for _, i in taken], [at for at, _ in taken], key)
        # while candidates wait, the mark stays at what was added, so that it passes none of them
        reached = [x for x in (mark, added if more else latest) if x is not None]
        if reached:
            before = max(reached) - grace
            self.mark.update((max(reached),))
            if new is not None:
                self._learn(new[(new["at"] // _DAY + 1) * _DAY > before], pieces)
            self._forget(before, pieces)

    @staticmethod
    def _shaped(ids: list[str], ats: list[int], key) -> pd.DataFrame:
        return pd.DataFrame({"source_id": [key[0]] * len(ids), "id": ids, "at": ats}).astype({"at": "int64"})

    def close(self) -> None:
        pass


def _gathered(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in tables of about _AT_ONCE."""
    held, n = [], 0
    for some in rows:
        held.append(some)
        n += len(some)
        if n >= _AT_ONCE:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)


def admit_stream(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Admitted (source_id, id, published_at) of a stream of candidates, with marks, admitted keys and what waits as keyed state.

    For streams without a store; needs the RocksDB state provider. Cold sources admit their newest candidate of the first batch. With a ``limit`` a source
    admits so many a batch, the oldest first; the others wait in its state for its next batch, whether the stream shows them again or not.
    Candidates without a source, date or id are never admitted; of rows that repeat an id in a batch the earliest date counts. State holds the keys
    of the days within the grace of each source's mark, and what waits.
    """
    keyed = candidates.where("source_id is not null and id is not null and published_at is not null")
    keyed = keyed.select("source_id", "id", F.unix_micros("published_at").alias("at")).groupBy("source_id")
    out = keyed.transformWithStateInPandas(_Admission(None if limit is None else max(0, int(limit))), "source_id string, id string, at long", "append", "none")
    return out.select("source_id", "id", F.timestamp_micros("at").alias("published_at"))

