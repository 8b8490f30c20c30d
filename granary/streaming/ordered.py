"""Streams with state by key: first arrivals of objects, and rows put back in order.

Both keep their state in maps of Spark's state store, so it need not fit in
memory and survives a restart from the checkpoint. They need the RocksDB
provider (see ``rocksdb``).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """The RocksDB state store for streams that are started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


#: Groups that streams are dealt to, each with a call per batch; and the numbers that a page of waiting rows spans.
PARTS, PAGE = 512, 1_000


class _FirstArrivals(StatefulProcessor):
    def __init__(self, columns: list[str], ttl_ms: int | None):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "stream string, object string", "ordinal long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[tuple, int] = {}
        for frame in rows:
            for stream, object, ordinal in zip(*(frame[c].tolist() for c in self.columns)):
                held = first.get((stream, object))
                if held is None or ordinal < held:
                    first[stream, object] = ordinal
        new = [(*name, ordinal) for name, ordinal in first.items() if not self.seen.containsKey(name)]
        for stream, object, ordinal in new:
            self.seen.updateValue((stream, object), (ordinal,))
        if new:
            yield pd.DataFrame(new, columns=self.columns)

    def close(self) -> None:
        pass


def first_arrivals(rows: DataFrame, stream: str, object: str, ordinal: str, ttl: str | None = None, parts: int = PARTS) -> DataFrame:
    """stream, object, ordinal of rows whose object (a string) its stream has not had before.

    Of one batch, the row with the smallest ordinal counts. With ``ttl`` (an
    interval such as '2 hours') an object counts as new again once its first row
    is so old; such a stream goes on until it is stopped, with any trigger. Streams and objects are dealt to ``parts`` groups by hash, so that one
    busy stream does not stay in one task, and many small ones do not cost a call each.
    """
    columns = [stream, object, ordinal]
    kinds = dict(rows.dtypes)
    part = F.pmod(F.xxhash64(stream, object), F.lit(parts)).alias("_part")
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    grouped = rows.select(F.col(stream).cast("string").alias(stream), object, ordinal, part).groupBy("_part")
    schema = f"{stream} string, {object} {kinds[object]}, {ordinal} {kinds[ordinal]}"
    found = grouped.transformWithStateInPandas(_FirstArrivals(columns, ttl_ms), schema, "append", "processingTime" if ttl else "none")
    return found.select(F.col(stream).cast(kinds[stream]).alias(stream), object, ordinal)


class _InOrder(StatefulProcessor):
    def __init__(self, columns: list[str], first: int):
        self.columns, self.first = columns, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getMapState("place", "name string", "awaited long, emitted long")
        self.waiting = handle.getMapState("waiting", "name string, page long", "seq array<long>, payload array<string>, failed array<boolean>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, dict[int, tuple]] = {}
        for frame in rows:
            for name, s, p, f in zip(*(frame[c].tolist() for c in self.columns)):
                new.setdefault(name, {}).setdefault(s, (p, bool(f)))
        out = []
        for name, arrived in new.items():
            out += self._placed(name, arrived)
        if out:
            group, seq, payload, _ = self.columns
            yield pd.DataFrame(out, columns=[group, "place", seq, payload])

    def _placed(self, name, arrived: dict[int, tuple]) -> list[tuple]:
        """The rows of a group that it is the turn of; the others wait, in pages of numbers."""
        known = self.place.containsKey((name,))
        awaited, emitted = self.place.getValue((name,)) if known else (self.first, 0)
        pages: dict[int, dict[int, tuple]] = {}
        stored, changed = set(), set()

        def page_of(s: int) -> dict[int, tuple]:
            page = s // PAGE
            if page not in pages:
                pages[page] = {}
                if known and self.waiting.containsKey((name, page)):
                    stored.add(page)
                    seqs, payloads, failed = self.waiting.getValue((name, page))
                    pages[page] = dict(zip(seqs, zip(payloads, failed)))
            return pages[page]

        for s, said in arrived.items():
            if s >= awaited and s not in page_of(s):
                page_of(s)[s] = said
                changed.add(s // PAGE)
        out = []
        while awaited in page_of(awaited):
            payload, failed = page_of(awaited).pop(awaited)
            changed.add(awaited // PAGE)
            if not failed:
                out.append((name, emitted, awaited, payload))
                emitted += 1
            awaited += 1
        for page in changed:
            if pages[page]:
                self.waiting.updateValue((name, page), (list(pages[page]), [p for p, _ in pages[page].values()], [f for _, f in pages[page].values()]))
            elif page in stored:
                self.waiting.removeKey((name, page))
        self.place.updateValue((name,), (awaited, emitted))
        return out

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, group: str, seq: str, payload: str, failed: str, first: int = 0, parts: int = PARTS) -> DataFrame:
    """group, place, seq, payload: each group's rows by seq without gaps, however they arrive.

    A row waits until all numbers from ``first`` to its own have come; a failed
    row takes its turn but is not emitted; a number that comes again is left out.
    ``place`` counts a group's emitted rows. payload is a string. Groups are dealt
    to ``parts`` by hash; a part holds its rows of a batch, and waiting rows page by page.
    """
    kinds = dict(rows.dtypes)
    part = F.pmod(F.xxhash64(group), F.lit(parts)).alias("_part")
    grouped = rows.select(F.col(group).cast("string").alias(group), F.col(seq).cast("long").alias(seq), payload, failed, part).groupBy("_part")
    schema = f"{group} string, place long, {seq} long, {payload} string"
    placed = grouped.transformWithStateInPandas(_InOrder([group, seq, payload, failed], first), schema, "append", "none")
    return placed.select(F.col(group).cast(kinds[group]).alias(group), "place", seq, payload)
