"""Sequential folds over a chat's log: pure steps, run in batch over sorted partitions or as streaming state."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Wake:
    """Fires once at least ``floor`` seconds have passed since the last wake and either ``most`` messages came or ``interval`` passed."""

    last: int | None = None
    count: int = 0
    floor: int = 300
    interval: int = 3600
    most: int = 5

    def reason(self, at: int, jitter: float = 1.0) -> str | None:
        passed = at - self.last
        if passed < self.floor:
            return None
        return "count" if self.count >= self.most else "interval" if passed >= round(self.interval * jitter) else None

    def step(self, at: int) -> str | None:
        if self.last is None:
            self.last = at
        self.count += 1
        reason = self.reason(at)
        if reason:
            self.last, self.count = at, 0
        return reason


@dataclass
class Session:
    """The wake of a chat as it runs: the trigger's interval times a jitter, wakes that a mention or reply forces, and one wake at a time.

    A forced row starts a wake at once; within ``cooldown`` seconds of the last forced one it is passed over; while a wake runs (``running`` seconds) the
    newest forced row waits and starts when it ends. A wake shows the rows since the marker, which moves to the row that started it."""

    wake: Wake
    jitter: float = 1.0
    cooldown: int = 10
    running: int = 30
    busy_until: int = -1
    cool_until: int = -1
    waiting: int | None = None
    marker: int | None = None

    def _start(self, at: int, row: int, reason: str) -> tuple[int, str, int]:
        since, self.marker = self.marker, row
        self.busy_until = at + self.running
        self.wake.last, self.wake.count = at, 0
        return row, reason, -1 if since is None else since

    def step(self, at: int, row: int, forced: bool) -> list[tuple[int, str, int]]:
        """(row, reason, marker before) of the wakes that start by the time of this row."""
        out = []
        if self.waiting is not None and at >= self.busy_until:
            out.append(self._start(self.busy_until, self.waiting, "queued"))
            self.waiting = None
        if self.wake.last is None:
            self.wake.last = at
        self.wake.count += 1
        if not forced:
            reason = self.wake.reason(at, self.jitter)
            if reason and at >= self.busy_until:  # while a call runs the trigger stays armed
                out.append(self._start(at, row, reason))
        elif at >= self.cool_until:
            self.cool_until = at + self.cooldown
            if at < self.busy_until:
                self.waiting = row
            else:
                out.append(self._start(at, row, "forced"))
        return out


@dataclass
class Boundaries:
    """Where digests ended: ``previous`` stays unknown until the second one, so that the chunk before last is what leaves the context."""

    last: int = 0
    previous: int | None = None
    done: int = 0

    def step(self, row: int) -> tuple[int, int]:
        """(rows at or below leave the context, previous boundary or -1) as a digest ends at ``row``."""
        leave = self.last
        self.previous = self.last if self.done else None
        self.last, self.done = row, self.done + 1
        return leave, -1 if self.previous is None else self.previous


@dataclass
class Breaker:
    """After ``most`` failures in a row nothing is tried any more; a success starts anew."""

    most: int = 3
    failed: int = 0

    def step(self, ok: bool) -> str:
        if self.failed >= self.most:
            return "dropped"
        self.failed = 0 if ok else self.failed + 1
        return "done" if ok else "open" if self.failed >= self.most else "failed"


@dataclass
class Digest:
    """Closes a batch when the tail reaches any size, or when a batch was closed and six hours passed since."""

    last: int | None = None
    messages: int = 0
    chars: int = 0
    words: int = 0
    size: int = 0

    def step(self, at: int, chars: int, words: int, size: int) -> bool:
        self.messages, self.chars, self.words, self.size = self.messages + 1, self.chars + chars, self.words + words, self.size + size
        full = self.messages >= 100 or self.chars >= 5000 or self.words >= 2500 or self.size >= 20 * 1024
        if full or self.last is not None and at - self.last >= 6 * 3600:
            self.last, self.messages, self.chars, self.words, self.size = at, 0, 0, 0, 0
            return True
        return False


def fold(rows: DataFrame, make: Callable[[], object], step: Callable[[object, dict], list[tuple]], schema: str) -> DataFrame:
    """Runs ``step`` over each chat's rows in order of id. A chat is sequential by nature, so it stays in one partition, but rows stream
    through in Arrow batches and only the state is held."""
    cols = rows.columns
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        chat, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
                row = dict(zip(cols, values, strict=True))
                if state is None or row["chat_id"] != chat:
                    chat, state = row["chat_id"], make()
                out += [(chat, *r) for r in step(state, row)]
            arrays = list(zip(*out, strict=True)) if out else [[] for _ in names]
            types = {"string": pa.string(), "long": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(a, types[s.split()[1]]) for a, s in zip(arrays, schema.split(", "), strict=True)], names=names)

    return rows.repartition("chat_id").sortWithinPartitions("chat_id", "id").mapInArrow(run, schema)


def wake_fires(log: DataFrame) -> DataFrame:
    rows = log.where("direction = 'inbound' and event_type not in ('join', 'leave')").select("chat_id", "id", F.unix_timestamp("timestamp").alias("t"))

    def step(state: Wake, row: dict) -> list[tuple]:
        reason = state.step(row["t"])
        return [(row["id"], reason)] if reason else []

    return fold(rows, Wake, step, "chat_id string, id long, reason string")


def digest_batches(log: DataFrame) -> DataFrame:
    from ..functions.text import cjk_count, word_count

    text = F.coalesce("text", F.lit(""))
    rows = log.where("event_type not in ('join', 'leave')").select(
        "chat_id", "id", F.unix_timestamp("timestamp").alias("t"), cjk_count(text).alias("c"), word_count(text).alias("w"), F.octet_length(text).alias("b"))

    def step(state: Digest, row: dict) -> list[tuple]:
        n = state.messages + 1
        return [(row["id"], n)] if state.step(row["t"], row["c"], row["w"], row["b"]) else []

    return fold(rows, Digest, step, "chat_id string, last_id long, messages long")


def session_wakes(log: DataFrame, jitter: float = 1.0) -> DataFrame:
    """(chat_id, id, reason, since): every wake of each chat with the row that started it and the marker before."""
    forced = F.coalesce("mentions_bot", F.lit(False)) | F.coalesce("is_reply_to_bot", F.lit(False))
    rows = log.where("direction = 'inbound' and event_type not in ('join', 'leave')").select("chat_id", "id", F.unix_timestamp("timestamp").alias("t"), forced.alias("f"))
    return fold(rows, lambda: Session(Wake(), jitter), lambda s, r: s.step(r["t"], r["id"], r["f"]), "chat_id string, id long, reason string, since long")


def digest_boundaries(batches: DataFrame) -> DataFrame:
    """(chat_id, last_id, leave_upto, previous): what each digest (chat_id, last_id) removes from the context and the boundary before it."""
    rows = batches.select("chat_id", F.col("last_id").alias("id"))
    return fold(rows, Boundaries, lambda s, r: [(r["id"], *s.step(r["id"]))], "chat_id string, last_id long, leave_upto long, previous long")


def circuit(outcomes: DataFrame) -> DataFrame:
    """(chat_id, id, state) of attempts (chat_id, id, ok) in order of id."""
    return fold(outcomes.select("chat_id", "id", "ok"), Breaker, lambda s, r: [(r["id"], s.step(bool(r["ok"])))], "chat_id string, id long, state string")


# Keys of a chat's stored state with the type they are read as and what stands for a missing or unreadable value.
STATE_KEYS = {
    "last_digest_boundary_msg_id": ("bigint", 0), "prev_digest_boundary_msg_id": ("bigint", None), "last_digest_at": ("timestamp", None), "muted_flag": ("boolean", False),
    "consecutive_bot_msgs": ("int", 0), "wake_msgs_since_wake": ("int", 0), "wake_current_interval_ms": ("bigint", 3_600_000), "warmup_backoff_factor": ("int", 0), "warmup_topic_cooldowns": ("string", "{}"),
}


def decode_state(state: DataFrame) -> DataFrame:
    """One row a chat from its stored map of strings: each key in its type, and its default where it is missing or cannot be read."""
    def field(key: str, kind: str, default: object) -> Column:
        raw = F.try_element_at("state", F.lit(key))
        value = raw.try_cast(kind) if kind != "boolean" else F.when(raw == "1", True).when(raw == "0", False)
        return F.coalesce(value, F.lit(default).cast(kind)).alias(key)

    return state.select("chat_id", *[field(k, t, d) for k, (t, d) in STATE_KEYS.items()])


def encode_state(decoded: DataFrame) -> DataFrame:
    """The map of strings again; what is unknown is an empty string."""
    def text(key: str, kind: str) -> Column:
        c = F.col(key)
        if kind == "boolean":
            return F.when(c, "1").otherwise("0")
        return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if kind == "timestamp" else c.cast("string"), F.lit(""))

    pairs = [x for k, (t, _) in STATE_KEYS.items() for x in (F.lit(k), text(k, t))]
    return decoded.select("chat_id", F.create_map(*pairs).alias("state"))
