"""Repair of conversation structure by a time-major tensor DP.

A sound conversation is empty or has an optional system turn and then pairs of a user's and an assistant's turn, read by the
roles' initials: (s?(ua)+)?. Each row is kept (free), given another role (2) or deleted (3, a must for blank and duplicate rows),
and empty turns can be inserted anywhere (2); a truncated row that stays costs 1. The automaton has four states: start, after
s, after u, after a. Of equally cheap repairs the one whose letters (D, I, K, R) come first is taken.

Rows stand in the order of turn (nulls first), then role, then MD5 of role and text. Conversations are cut into segments of
SEGMENT rows; nearly all have one. Segments are dealt to tasks by hash, and a task takes some thousand rows at a time, buckets
them by length and lays each bucket out as a tensor, turn x conversation. Going back in time, the costs of all conversations'
four states are updated at once and stored; going forward, the edits of all are traced at once.

A conversation of several segments needs the costs at each segment's end and its state at each start. Both come from what a
segment does as a whole: the least cost from each state to each (4 x 4), which are chained backwards, and the state that each
leads to, which are chained forwards. Only these few numbers of a segment pass one task, in a stream.

repair() gives each row its fault and its edit, repaired() the rows of the sound conversations, digest() one row for each
conversation. A digest hashes a conversation's rows one after the other, as the hash demands, in a stream: a task holds a batch
of rows and one letter a row. damage() breaks rows by a hash of conversation and turn, for trials.

Defined cases: null roles and texts are one space each, so such rows are blank, or cannot keep their role; an empty role has no
initial; a null conv_id is a conversation of its own; a null turn comes first and leaves no gap; repeated rows are duplicates
after the first; texts of any length are read whole; an empty table gives an empty result; only conv_id, turn, role and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, ranked, read_table

SEGMENT = 1024
FLUSH_ROWS, FLUSH_BYTES = 1 << 15, 16 << 20  # what a task gathers before it lays out tensors
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
START, S, U, A = range(4)
NEXT = np.array([U, U, A, U])  # where an inserted or re-roled turn leads, which is a user's but after u
KEPT = np.array([[-1] * 4, [S, -1, -1, -1], [U, U, -1, U], [-1, -1, A, -1]])  # by initial (none, s, u, a) and state
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)  # what is still to insert at the end
NEVER = 1 << 40
BLANK = r"[^\x20\x09-\x0D]"
TURNS = ("", "u", "a", "ua", "au")  # inserted turns, by number
NAMES = {"u": "user", "a": "assistant"}

# ---------------------------------------------------------------- one bucket


class Tensors:
    """Turn x segment: initials, and whether a row must go, is truncated, or is not there."""

    def __init__(self, initial: np.ndarray, forced: np.ndarray, truncated: np.ndarray, absent: np.ndarray):
        self.initial, self.forced, self.truncated, self.absent = initial, forced, truncated, absent

    def repeat(self, k: int) -> "Tensors":
        return Tensors(*(np.repeat(x, k, axis=1) for x in (self.initial, self.forced, self.truncated, self.absent)))

    def costs(self, t: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs (segment x state) of deleting, keeping and re-roling turn t and all that follows."""
        stays = (TRUNCATED * self.truncated[t] + NEVER * self.forced[t])[:, None]
        to = KEPT[self.initial[t]]
        kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), NEVER)
        return DELETE + after, stays + kept, REROLE + stays + after[:, NEXT]

    def backward(self, end: np.ndarray) -> np.ndarray:
        """(turns + 1) x segment x state: the least cost from there on; end (segment x state) is what follows the segment."""
        out = np.empty((len(self.initial) + 1, *end.shape), np.int64)
        out[-1] = end
        for t in range(len(self.initial) - 1, -1, -1):
            here = np.minimum.reduce(self.costs(t, out[t + 1]))
            for _ in range(2):
                here = np.minimum(here, INSERT + here[:, NEXT])
            out[t] = np.where(self.absent[t][:, None], out[t + 1], here)
        return out

    def trace(self, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Turn x segment: inserted turns before (by number), letter, new role's initial; and the state at each segment's end."""
        n = np.arange(len(state))
        before, letter, role = (np.zeros(self.initial.shape, np.uint8) for _ in range(3))
        for t in range(len(self.initial)):
            delete, keep, rerole = (x[n, :] for x in self.costs(t, costs[t + 1]))
            todo = ~self.absent[t]
            for _ in range(3):
                least = costs[t][n, state]
                gone = todo & (delete[n, state] == least)
                more = todo & ~gone & (INSERT + costs[t][n, NEXT[state]] == least)
                stay = todo & ~gone & ~more & (keep[n, state] == least)
                other = todo & ~gone & ~more & ~stay
                for on, c in ((gone, "D"), (stay, "K"), (other, "R")):
                    letter[t][on] = ord(c)
                role[t][other] = np.where(NEXT[state] == U, ord("u"), ord("a"))[other]
                before[t][more] = np.where(before[t] == 0, np.where(NEXT[state] == U, 1, 2), before[t] + 2)[more]
                state = np.where(stay, KEPT[self.initial[t], state], np.where(other | more, NEXT[state], state))
                todo = more
        return before, letter, role, state


# ---------------------------------------------------------------- streams of segments

#: Entries of a segment, in order: its bounds (if it is one of several), a mark for each first row of its kind, and the rows.
BOUNDS, MARK, ROW = range(3)


def _segments(table: pa.Table) -> np.ndarray:
    """The first entry of each segment."""
    change = np.zeros(table.num_rows, bool)
    for c in ("g", "_seg"):
        ends = pc.run_end_encode(table.column(c).combine_chunks()).run_ends.to_numpy(zero_copy_only=False).astype(np.int64)
        change[np.concatenate(([0], ends[:-1]))] = True
    return np.flatnonzero(change)


def _by_segments(work):
    """Takes entries in order and calls work for tables of whole segments."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows < FLUSH_ROWS and size < FLUSH_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(_segments(table)[-1])
            rows = size = 0
            if cut:
                yield from work(table.slice(0, cut))
                table = table.slice(cut)
            held = table.to_batches()
        if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield from work(table)

    return run


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).fill_null(0).to_numpy()


class Layout:
    """The rows of some segments, and their tensors by buckets of length."""

    def __init__(self, table: pa.Table, segment: int):
        first = _segments(table)
        kind, pos = _numbers(table, "_kind"), _numbers(table, "_pos")
        of = np.searchsorted(first, np.arange(table.num_rows), "right") - 1
        self.rows = np.flatnonzero(kind == ROW)
        self.of = of[self.rows]
        marked = np.zeros(table.num_rows, bool)
        marked[1:] = (kind[:-1] == MARK) & (pos[:-1] == pos[1:]) & (of[:-1] == of[1:])
        flags = _numbers(table, "_flags")[self.rows]  # initial, and 4 if truncated, 8 if blank
        self.blank, self.duplicate = (flags & 8) > 0, ~marked[self.rows]
        self.initial, self.truncated = flags & 3, (flags & 4) > 0
        self.turn = pos[self.rows] % segment
        self.length = np.bincount(self.of, minlength=len(first))
        self.first, self.last = first, np.ones(len(first), bool)
        self.entry = np.zeros(len(first), np.int64)
        self.end = np.tile(END, (len(first), 1))
        at = np.flatnonzero(kind == BOUNDS)
        if len(at):
            self.entry[of[at]] = _numbers(table, "_entry")[at]
            self.last[of[at]] = _numbers(table, "_last")[at] > 0
            self.end[of[at]] = np.array(table.column("_end").take(pa.array(at)).to_pylist(), np.int64)

    def buckets(self):
        """(segments, tensors, rows, their turns, their columns) of each bucket; lengths in one differ by a factor of 2 at most."""
        size = np.ceil(np.log2(np.maximum(1, self.length))).astype(int)
        for b in np.unique(size[self.length > 0]):
            own = np.flatnonzero((size == b) & (self.length > 0))
            column = np.full(len(self.length), -1)
            column[own] = np.arange(len(own))
            r = np.flatnonzero(column[self.of] >= 0)
            t, c = self.turn[r], column[self.of[r]]
            shape = (int(self.length[own].max()), len(own))

            def laid(values, empty=0):
                out = np.full(shape, empty, values.dtype)
                out[t, c] = values[r]
                return out

            yield own, Tensors(laid(self.initial), laid(self.blank | self.duplicate), laid(self.truncated), laid(np.zeros(len(self.of), bool), True)), r, t, c


def _whole(segment: int, what: str):
    """Of each segment of several: the least cost from each state to each, or the state to which each leads."""

    def run(table: pa.Table):
        lay = Layout(table, segment)
        out = np.zeros((len(lay.first), 16 if what == "costs" else 4), np.int64)
        for own, tensors, *_ in lay.buckets():
            k = len(own)
            wide = tensors.repeat(4)
            if what == "costs":
                end = np.tile(np.where(np.eye(4, dtype=bool), 0, NEVER), (k, 1))
                out[own] = wide.backward(end)[0].reshape(k, 4, 4).transpose(0, 2, 1).reshape(k, 16)
            else:
                costs = wide.backward(np.repeat(lay.end[own], 4, axis=0))
                out[own] = wide.trace(costs, np.tile(np.arange(4), k))[3].reshape(k, 4)
        at = pa.array(lay.first)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.reshape(-1)))
        yield pa.RecordBatch.from_arrays([table.column("g").take(at).combine_chunks(), table.column("_seg").take(at).combine_chunks(), values], ["g", "_seg", "_x"])

    return run


def _chain_back(batches):
    """Segments from the last to the first: what follows each."""
    now, cost = None, END
    for batch in batches:
        ends, last = [], []
        for g, x in zip(batch.column("g").to_pylist(), batch.column("_x").to_pylist()):
            last.append(int(g != now))
            now, cost = g, END if g != now else cost
            ends.append(cost.tolist())
            cost = (np.array(x).reshape(4, 4) + cost).min(1)
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("_seg"), pa.array(ends, pa.list_(pa.int64())), pa.array(last, pa.int32())], ["g", "_seg", "_end", "_last"])


def _chain_on(batches):
    """Segments from the first to the last: the state in which each is entered."""
    now, state = None, START
    for batch in batches:
        out = []
        for g, x in zip(batch.column("g").to_pylist(), batch.column("_x").to_pylist()):
            now, state = g, START if g != now else state
            out.append(state)
            state = x[state]
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("_seg"), batch.column("_end"), batch.column("_last"), pa.array(out, pa.int64())], ["g", "_seg", "_end", "_last", "_entry"])


EDITS = ("fault", "before", "edit", "new_role", "after", "cost")


def _editor(segment: int, fields: list[str]):
    """The rows with EDITS."""

    def run(table: pa.Table):
        lay = Layout(table, segment)
        n = len(lay.rows)
        before, letter, role, after = (np.zeros(n, np.uint8) for _ in range(4))
        for own, tensors, r, t, c in lay.buckets():
            x, y, z, state = tensors.trace(tensors.backward(lay.end[own]), lay.entry[own])
            before[r], letter[r], role[r] = x[t, c], y[t, c], z[t, c]
            closing = np.where(lay.last[own], np.array([0, 3, 2, 0], np.uint8)[state], 0)  # ua after s, a after u
            ends = t == lay.length[own][c] - 1
            after[r[ends]] = closing[c[ends]]
        turns = pa.array(TURNS)
        sizes = np.array([len(x) for x in TURNS])
        fault = np.select([lay.blank, lay.duplicate, lay.truncated], [0, 1, 2], -1)
        cost = INSERT * (sizes[before] + sizes[after]) + np.select([letter == ord("D"), letter == ord("R")], [DELETE, REROLE], 0) + TRUNCATED * (lay.truncated & (letter != ord("D")))
        kept = table.take(pa.array(lay.rows)).select(fields).combine_chunks()
        cols = [
            pa.array(["blank", "duplicate", "truncated"]).take(pa.array(fault, mask=fault < 0)), turns.take(pa.array(before)), pa.array([chr(x) for x in letter.tolist()], pa.string()),
            pa.array(["user", "assistant"]).take(pa.array((role == ord("a")).astype(np.int8), mask=role == 0)), turns.take(pa.array(after)), pa.array(cost),
        ]
        for batch in pa.Table.from_arrays([*kept.columns, *cols], [*fields, *EDITS]).to_batches(1 << 13):
            yield batch

    return run


# ---------------------------------------------------------------- all conversations


def damage(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, with rows dropped, emptied, cut, repeated or given to the user by a hash of conversation and turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = convs.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("_kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def conversation(conv_id) -> "F.Column":
    """A key of the conversation that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _dealt(entries: DataFrame) -> DataFrame:
    return entries.repartition("g", "_seg").sortWithinPartitions("g", "_seg", "_pos", "_kind")


def _bounds(entries: DataFrame, rows: DataFrame, segment: int, keep: list[str]) -> DataFrame | None:
    """g, _seg, _end, _last and _entry of the segments of conversations that have several; None if none has.

    entries: marks and rows, without texts."""
    starts = rows.where((F.col("_pos") % segment == 0) & (F.col("_pos") > 0)).select("g", "_pos")
    segs = starts.select("g", F.floor(F.col("_pos") / segment).cast("long").alias("_seg")).union(starts.where(F.col("_pos") == segment).select("g", F.lit(0).cast("long")))
    segs = materialize(segs, "segments", keep)
    if segs.limit(1).count() == 0:
        return None
    own = materialize(entries.join(segs, ["g", "_seg"]), "long", keep)
    costs = _dealt(own).mapInArrow(_by_segments(_whole(segment, "costs")), "g string, _seg long, _x array<long>")
    back = costs.repartition("g").sortWithinPartitions("g", F.desc("_seg")).mapInArrow(_chain_back, "g string, _seg long, _end array<long>, _last int")
    back = materialize(back, "ends", keep)
    leads = _dealt(own.unionByName(_as_entries(back.withColumn("_entry", F.lit(0).cast("long"))), allowMissingColumns=True)).mapInArrow(_by_segments(_whole(segment, "states")), "g string, _seg long, _x array<long>")
    both = back.join(leads, ["g", "_seg"]).repartition("g").sortWithinPartitions("g", "_seg").select("g", "_seg", "_end", "_last", "_x")
    return materialize(both.mapInArrow(_chain_on, "g string, _seg long, _end array<long>, _last int, _entry long"), "bounds", keep)


def _as_entries(bounds: DataFrame) -> DataFrame:
    return bounds.withColumn("_pos", F.lit(-1).cast("long")).withColumn("_kind", F.lit(BOUNDS))


def repair(convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for each row of convs (conv_id, turn, role, text): its place in its conversation, fault, and edits.

    before and after are initials of the turns inserted there, edit is K, R (with new_role) or D; cost is of all of them."""
    keep: list[str] = []
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = convs.select(conversation(F.col("conv_id")).alias("g"), "conv_id", "turn", role.alias("role"), text.alias("text"))
    blank, cut = ~F.col("text").rlike(BLANK), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    flags = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + F.when(cut, 4).otherwise(0) + F.when(blank, 8).otherwise(0)
    rows = rows.withColumn("_h", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).withColumn("_flags", flags)
    rows = ranked(rows, "g", ["turn", "role", "_h"], "turns", []).withColumn("_seg", F.floor(F.col("_pos") / segment).cast("long")).withColumn("_kind", F.lit(ROW))
    marks = rows.groupBy("g", "_h").agg(F.min("_pos").alias("_pos")).select("g", F.floor(F.col("_pos") / segment).cast("long").alias("_seg"), "_pos", F.lit(MARK).alias("_kind"))
    marks = materialize(marks, "firsts")
    extra = F.lit(None).cast("array<long>").alias("_end"), F.lit(None).cast("int").alias("_last"), F.lit(None).cast("long").alias("_entry")
    slim = rows.select("g", "_seg", "_pos", "_kind", "_flags", *extra).unionByName(marks, allowMissingColumns=True)
    bounds = _bounds(slim, rows, segment, keep)
    fields = ["g", "conv_id", "turn", "role", "text", "_pos"]
    entries = rows.select(*fields, "_seg", "_kind", "_flags", *extra).unionByName(marks, allowMissingColumns=True)
    if bounds is not None:
        entries = entries.unionByName(_as_entries(materialize(bounds, "bounds")), allowMissingColumns=True)
    discard(convs.sparkSession, keep)
    of = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {of[c]}" for c in fields), "fault string, before string, edit string, new_role string, after string, cost long"])
    return _dealt(entries).mapInArrow(_by_segments(_editor(segment, fields)), schema).withColumnRenamed("_pos", "place")


def repaired(edits: DataFrame) -> DataFrame:
    """conv_id, place, part, role and text of the turns of the repaired conversations, in the order of place and part."""
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    name = lambda c: F.when(c == "u", NAMES["u"]).otherwise(NAMES["a"])
    made = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: turn(name(x), F.lit("")))
    own = F.when(F.col("edit") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(turn(F.coalesce("new_role", "role"), F.col("text"))))
    return edits.select("conv_id", "place", F.posexplode(F.concat(made("before"), own, made("after"))).alias("part", "x")).select("conv_id", "place", "part", "x.role", "x.text")


class _Summary:
    """One conversation's figures, taken up row by row."""

    def __init__(self, g: str):
        self.g, self.turns, self.low, self.high, self.was = g, 0, None, None, None
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = 0
        self.initial, self.audit, self.hash, self.any = None, [], sha256(), False

    def say(self, role: str, text: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode())
        self.any = True

    def take(self, turn, role, text, fault, before, edit, new_role, after, cost) -> None:
        if turn is not None and turn != self.was:
            self.turns, self.was, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        if fault:
            self.count[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        for x in before:
            self.say(NAMES[x], "")
        if edit != "D":
            self.say(new_role or role, text)
        for x in after:
            self.say(NAMES[x], "")
        self.audit.append("I" * len(before) + edit + "I" * len(after))
        self.cost += cost

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.g, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_DIGEST = "g string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches):
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]

    def batch_of(done):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    now = None
    for batch in batches:
        done = []
        for at in range(0, batch.num_rows, 512):
            for g, *rest in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                if now is None or g != now.g:
                    if now is not None:
                        done.append(now.row())
                    now = _Summary(g)
                now.take(*rest)
        if done:
            yield batch_of(done)
    if now is not None:
        yield batch_of([now.row()])


def digest(edits: DataFrame) -> DataFrame:
    """g and a conversation's figures, for each conversation that edits has rows of."""
    slim = edits.select("g", "place", "turn", "role", F.when(F.col("edit") == "D", "").otherwise(F.col("text")).alias("text"), *EDITS)
    return slim.repartition("g").sortWithinPartitions("g", "place").drop("place").mapInArrow(_digests, _DIGEST)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = read_table(spark, sf_dir, "conversations")
    figures = digest(repair(damage(convs)))
    ids = convs.select("conv_id").distinct().withColumn("g", conversation(F.col("conv_id")))
    none = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(sha256().hexdigest())}
    return ids.join(figures, "g", "left").select("conv_id", *[F.coalesce(c, v).alias(c) for c, v in none.items()])
