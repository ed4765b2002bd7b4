"""The latest state per post, kept by Spark's state store: one value and one timer per page, a hash of the id.

A stream of puts (new posts) and updates (included posts) becomes a stream of changed rows. What is stored of a post is
asked for by its page, so neither the table of all states nor a partition of it is read or written for a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postflow import schemas

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PUT, UPDATE = "put", "update"
#: Pages of the state. A page is read and written as a whole, so it should hold some hundred posts; the number is part of
#: a checkpoint.
PAGES = 1 << 14
#: The event name of a post whose state is given up because nothing has touched it for long.
EXPIRED = "EXPIRE"

_INPUT = "id STRING, kind STRING, version BIGINT, place STRING, has_text BOOLEAN, metrics STRING, row STRING"
_OUTPUT = "id STRING, event_name STRING, fresh BOOLEAN, version BIGINT, metrics STRING, row STRING"
_STATE = "posts ARRAY<STRUCT<id: STRING, version: BIGINT, has_text: BOOLEAN, metrics: STRING, row: STRING, touched: BIGINT>>"


class Event(NamedTuple):
    """A put or an update of one post; ``place`` orders events by arrival."""

    kind: str
    version: int | None
    place: str
    has_text: bool
    metrics: str | None
    row: str


class Stored(NamedTuple):
    version: int | None
    has_text: bool
    metrics: str | None
    row: str


def require_state_api(spark: SparkSession) -> None:
    """Says at once what is missing, instead of failing in the first micro-batch; chooses the store that keyed state needs."""
    if not hasattr(GroupedData, "transformWithState"):
        raise RuntimeError("keyed state needs transformWithState (rows; it came after transformWithStateInPandas), which this version of Spark does not have")
    try:
        import google.protobuf  # noqa: F401
    except ImportError as missing:
        raise RuntimeError("keyed state needs the protobuf package, by which Python workers talk to the state store") from missing
    spark.conf.set(STORE, ROCKSDB)


def newer(a: Event, b: Event) -> bool:
    """Whether update ``a`` wins over ``b``: the larger version, of equal ones the first arrival; one without a version
    loses."""
    if a.version is None or b.version is None:
        return b.version is None and (a.version is not None or a.place < b.place)
    return (a.version, b.place) > (b.version, a.place)


def reduced(events: Iterable[Event]) -> list[Event]:
    """The events of one post that can still matter: the last put, and the updates behind it that no later one beats.

    Whatever arrives besides, these give the same result as all of them, so batches may be reduced in parts and in any
    order. Of many updates in no special order a handful is left.
    """
    last, updates = None, []
    for event in events:
        if event.kind == PUT:
            if last is None or event.place > last.place:
                last = event
        else:
            updates.append(event)
    kept: list[Event] = []
    for event in sorted(updates, key=lambda e: e.place, reverse=True):
        if last is not None and event.place <= last.place:
            break
        # behind this one come the ones kept so far: it counts only if it wins over all of them
        if not kept or newer(event, kept[-1]):
            kept.append(event)
    return [*([] if last is None else [last]), *kept]


def applied(stored: Stored | None, events: list[Event]) -> tuple[Stored, str, bool] | None:
    """The new state, the kind of change and whether the row is a fresh one; ``None`` if nothing changes.

    A put replaces what is stored. The best update behind it counts if it is newer, or if there is no row: it brings
    the metrics of a row that has its text, and is itself the row where text is missing (a stub is promoted).
    """
    put = next((e for e in events if e.kind == PUT), None)
    updates = [e for e in events if e.kind == UPDATE]
    best = None
    for event in updates:
        if best is None or newer(event, best):
            best = event
    base = put or stored
    image = base
    promoted = False
    newer_than_base = best is not None and (base is None or (base.version is not None and best.version is not None and base.version < best.version))
    if newer_than_base:
        promoted = base is None or not base.has_text
        image = best if promoted else Stored(best.version, base.has_text, best.metrics, base.row)
    if put is None and not newer_than_base:
        return None
    state = Stored(image.version, image.has_text, image.metrics, image.row)
    return state, "INSERT" if stored is None else "MODIFY", put is not None or promoted


#: Events of a post that are gathered before they are reduced.
_GATHERED = 1000


def _reduced_rows(rows: Iterable[Row]) -> dict[str, list[Event]]:
    """The events that matter of each post, of any number, by parts of bounded size."""
    posts: dict[str, list[Event]] = {}
    for row in rows:
        events = posts.setdefault(row["id"], [])
        events.append(Event(*[row[name] for name in Event._fields]))
        if len(events) >= _GATHERED:
            posts[row["id"]] = reduced(events)
    return {post_id: events if len(events) == 1 else reduced(events) for post_id, events in posts.items()}


class PostState(StatefulProcessor):
    """The posts of one page. With ``idle_ms`` a post that nothing touches for so long leaves the store with an event.

    A message to the store takes far longer than the work on a post, so one value holds a page of them. The timer of a
    page is that of the post that is due first.
    """

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("posts", _STATE)

    def _stored(self) -> dict[str, tuple[Stored, int | None]]:
        found = self.value.get()
        return {} if found is None else {post_id: (Stored(*rest), touched) for post_id, *rest, touched in found[0]}

    def _store(self, posts: dict[str, tuple[Stored, int | None]]) -> None:
        self.value.update(([(post_id, *stored, touched) for post_id, (stored, touched) in posts.items()],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        posts = self._stored()
        now = None if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs()
        changed = False
        for post_id, events in _reduced_rows(rows).items():
            stored, _ = posts.get(post_id, (None, None))
            change = applied(stored, events)
            if change is not None:
                state, event_name, fresh = change
                posts[post_id] = state, now
                yield _row(post_id, event_name, fresh, state)
            elif now is not None:
                posts[post_id] = stored, now
            changed = changed or change is not None or now is not None
        if changed:
            self._store(posts)
        if now is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(min(touched for _, touched in posts.values()) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        posts = self._stored()
        due = timerValues.getCurrentProcessingTimeInMs() - self.idle_ms
        left = {post_id: post for post_id, post in posts.items() if post[1] > due}
        for post_id in posts.keys() - left.keys():
            yield _row(post_id, EXPIRED, False, posts[post_id][0])
        if left:
            self._store(left)
            self.handle.registerTimer(min(touched for _, touched in left.values()) + self.idle_ms)
        else:
            self.value.clear()

    def close(self) -> None:
        pass


def _row(post_id: str, event_name: str, fresh: bool, state: Stored) -> Row:
    return Row(id=post_id, event_name=event_name, fresh=fresh, version=state.version, metrics=state.metrics, row=state.row)


def _reduced_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated ids of an Arrow batch, reduced before rows move: a post that makes up a third of them all is a few rows
    a batch for the task that holds its state."""
    for batch in batches:
        ids = batch.column("id")
        if batch.num_rows < 2 or ids.value_counts().field("counts").to_numpy().max() == 1:
            yield batch
            continue
        groups: dict[str, list[tuple[Event, int]]] = {}
        columns = [batch.column(c).to_pylist() for c in ("id", "kind", "version", "place", "has_text")]
        for i, (post_id, kind, version, place, has_text) in enumerate(zip(*columns)):
            # the number of the row stands for its content
            groups.setdefault(post_id, []).append(Event(kind, version, place, has_text, None, str(i)))
        kept = sorted(int(e.row) for events in groups.values() for e in reduced(events))
        yield batch.take(pa.array(kept))


def _place(arrival: Column) -> Column:
    """The order of arrival as text: numbers in equal width, the place ended by the smallest character."""
    digits = lambda c: F.lpad(F.coalesce(c, F.lit(0)).cast("string"), 20, "0")
    return F.concat(digits(F.unix_micros(arrival["time"])), F.coalesce(arrival["place"], F.lit("")), F.lit("\x00"), digits(arrival["position"]), digits(arrival["line"]))


def keyed_events(puts: DataFrame, updates: DataFrame) -> DataFrame:
    """State rows (``schemas.STATE`` with ``arrival``) of both kinds in the form that the state takes."""

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.where(F.col("id").isNotNull()).select(
            "id",
            F.lit(kind).alias("kind"),
            F.col("updated_at").cast("bigint").alias("version"),
            _place(F.col("arrival")).alias("place"),
            F.col("text").isNotNull().alias("has_text"),
            F.to_json("public_metrics").alias("metrics"),
            F.to_json(F.struct(*[c for c in schemas.STATE.names if c not in ("public_metrics", "updated_at")])).alias("row"),
        )

    both = rows(puts, PUT).unionByName(rows(updates, UPDATE))
    return both.mapInArrow(_reduced_batches, _INPUT)


def state_changes(events: DataFrame, idle_ms: int | None = None, pages: int = PAGES) -> DataFrame:
    """The stream of changed rows: ``schemas.STATE``, ``event_name`` and ``fresh`` (replaced as a whole).

    One row per post and micro-batch that changes it. ``events`` come from :func:`keyed_events`. A post given up after
    ``idle_ms`` without an event comes out once more as :data:`EXPIRED`; a later update finds no row and brings it back.
    """
    require_state_api(events.sparkSession)
    paged = events.withColumn("page", F.pmod(F.xxhash64("id"), F.lit(pages)))
    changed = paged.groupBy("page").transformWithState(
        PostState(idle_ms), outputStructType=_OUTPUT, outputMode="append", timeMode="none" if idle_ms is None else "processingTime"
    )
    kind = schemas.STATE["public_metrics"].dataType
    row = F.from_json("row", T.StructType([f for f in schemas.STATE.fields if f.name not in ("public_metrics", "updated_at")]))
    parsed = changed.select(row.alias("r"), F.from_json("metrics", kind).alias("public_metrics"), F.col("version").alias("updated_at"), "event_name", "fresh")
    fields = [F.col(n) if n in ("public_metrics", "updated_at") else F.col(f"r.{n}") for n in schemas.STATE.names]
    return parsed.select(*fields, "event_name", "fresh")
