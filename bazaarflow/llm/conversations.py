"""Least-cost repair of conversations by the auction algorithm for shortest paths.

A conversation's edits are paths through a lattice: a node is a place between rows and what the roles so far end in (nothing, a
system row, a user row, an assistant row); an arc keeps, re-roles or deletes a row, or inserts an empty one, at an integer cost.
The auction keeps a path from its origin and a price for each node, no price above an arc's cost plus the price at its end. It
extends the path along the arc that attains the price of its last node; if there is none it raises that price and contracts the
path. On arrival the origin's price is its distance. Arcs on which the converged prices are tight make up all
shortest paths, and of these the one of the least letters is traced.

Rows are sorted by range of (conversation, turn), so a long conversation lies in several tasks. There it is cut into segments
of a bounded number of rows. A segment's costs between its first and last states are a 4 x 4 table; these compose from the
last segment to the first, so no task holds a conversation, and the order of segments is a stream. Conversations whole in one segment take one pass.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import materialise, small_batches

#: Rows and bytes of text of a segment, about, and rows whose lattice one auction prices.
SEGMENT_ROWS = 512
SEGMENT_BYTES = 1 << 20
AUCTION_ROWS = 32

_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
STATES = range(4)
#: Where a row of each role leads from a state, and where an inserted or re-roled row does.
_LEGAL = {("s", _NONE): _SYSTEM, ("u", _NONE): _USER, ("u", _SYSTEM): _USER, ("a", _USER): _ASSISTANT, ("u", _ASSISTANT): _USER}
_NEXT = {_NONE: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
COST = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
#: What it costs to end in a state, and the insertions that do so.
ENDS = (0, 2 * INSERT, INSERT, 0)
SUFFIX = ("", "II", "I", "")
FAR = 1 << 60
#: Codes of rows: twice the place of the initial in this, plus one if truncated; the last must be deleted.
_INITIALS = ("s", "u", "a", None)
_GONE = 8
BLANK = " \t\n\x0b\x0c\r"


@functools.cache
def arcs(code: int) -> tuple:
    """By state, a row's arcs in the order of their letters: (letter, rows on, state, cost)."""
    out = []
    for state in STATES:
        here = [("D", 1, state, DELETE), ("I", 0, _NEXT[state], INSERT)]
        if code != _GONE:
            extra = TRUNCATED * (code & 1)
            if (_INITIALS[code >> 1], state) in _LEGAL:
                here.append(("K", 1, _LEGAL[_INITIALS[code >> 1], state], extra))
            here.append(("R", 1, _NEXT[state], REROLE + extra))
        out.append(tuple(here))
    return tuple(out)


def auction(lattice: list, price: list, origin: int, live: frozenset) -> None:
    """Raise ``price`` (a row of four for each place, the last ones fixed) until that of state ``origin`` at place 0 is its distance."""
    path, last = [(0, origin)], len(lattice)
    while True:
        at, state = path[-1]
        if at == last:
            return
        best, follow = FAR, None
        for _, step, then, cost in lattice[at][state]:
            if then in live and cost + price[at + step][then] < best:
                best, follow = cost + price[at + step][then], (at + step, then)
        if price[at][state] < best:
            price[at][state] = best
            if len(path) > 1:
                path.pop()
        elif follow is None:
            return
        else:
            path.append(follow)


def prices(codes: bytes, ends: tuple) -> list:
    """Converged prices of all places of a run of rows whose last states cost ``ends``; exact at place 0 and where blocks meet.

    Blocks of ``AUCTION_ROWS`` are priced from the last to the first, each from the exact prices behind it, so the work is in
    proportion to the rows. States from which no end is in reach stay ``FAR``.
    """
    reach = [e for e in STATES if ends[e] < FAR]
    live = frozenset(STATES) if any(e >= _USER for e in reach) else frozenset(range(max(reach) + 1))
    price = [None] * len(codes) + [list(ends)]
    for first in range((max(len(codes), 1) - 1) // AUCTION_ROWS * AUCTION_ROWS, -1, -AUCTION_ROWS):
        after = min(first + AUCTION_ROWS, len(codes))
        if first == after:
            break
        least = min(price[after])
        block = [[least if s in live else FAR for s in STATES] for _ in range(first, after)] + [price[after]]
        lattice = [arcs(c) for c in codes[first:after]]
        for state in live:
            auction(lattice, block, state, live)
        price[first:after] = block[:-1]
    return price


def traces(codes: bytes, ends: tuple) -> list[tuple[str, int]]:
    """For each first state, the least letters among the cheapest edits, and the state that they end in."""
    price, n = prices(codes, ends), len(codes)
    leads = [[True] * 4]
    letters: list[list] = []
    for at in range(n - 1, -1, -1):
        here = [[(letter, step, then) for letter, step, then, cost in a if price[at][s] == cost + price[at + step][then]] for s, a in enumerate(arcs(codes[at]))]
        ok = [any(step and leads[-1][then] for _, step, then in a) for a in here]
        for s in (_USER, _ASSISTANT, _NONE, _SYSTEM):  # an insertion stays at its place; two in a row are never tight in a circle
            ok[s] = ok[s] or any(not step and (ok[then] or any(not more and ok[on] for _, more, on in here[then])) for _, step, then in here[s])
        letters.append([next((a for a in here[s] if (leads[-1] if a[1] else ok)[a[2]]), None) for s in STATES])
        leads.append(ok)
    letters.reverse()
    out = []
    for state in STATES:
        at, audit = 0, []
        while at < n:
            letter, step, state = letters[at][state]
            audit.append(letter)
            at += step
        out.append(("".join(audit), state))
    return out


@functools.lru_cache(1 << 16)
def _traces_of_short(codes: bytes, ends: tuple) -> list[tuple[str, int]]:
    return traces(codes, ends)


def between(codes: bytes) -> list[int]:
    """Cheapest edits from each first to each last state, row by row."""
    by_end = [prices(codes, tuple(0 if s == e else FAR for s in STATES))[0] for e in STATES]
    return [by_end[e][s] for s in STATES for e in STATES]


def faults(roles: list[str], texts: list[str], late: frozenset) -> list[str]:
    """Each row's first fault: blank, duplicate, truncated or none. ``late``: digests of rows that earlier segments hold."""
    seen, out = set(), []
    for role, text in zip(roles, texts):
        shown = text.rstrip(BLANK)
        if not shown:
            out.append("blank")
        elif (role, text) in seen or late and hashlib.md5(f"{role}\0{text}".encode()).hexdigest() in late:
            out.append("duplicate")
        else:
            out.append("" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def coded(roles: list[str], found: list[str]) -> bytes:
    return bytes(_GONE if f in ("blank", "duplicate") else 2 * (_INITIALS.index(r[:1]) if r[:1] in ("s", "u", "a") else 3) + (f == "truncated") for r, f in zip(roles, found))


def edited(audit: str, state: int, rows: Iterator) -> Iterator[tuple]:
    """Repaired rows (turn, role, text, letter) of ``rows`` (turn, role, text) under ``audit``, from ``state`` on."""
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            yield None, _ROLE[state], "", letter
            continue
        turn, role, text = next(rows)
        if letter == "R":
            state = _NEXT[state]
            yield turn, _ROLE[state], text, letter
        elif letter == "K":
            state = _LEGAL[role[:1], state]
            yield turn, role, text, letter


_SEGMENT = "conv_id long, segment long, open boolean, turns array<long>, roles array<string>, texts array<string>"
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
_NAMES = ["conv_id", "segment", "open", "turns", "roles", "texts"]


def _segments(rows_a_segment: int):
    """Rows in order of conversation and turn -> segments; ``open`` ones may go on in another segment."""

    def run(batches):
        number, conv, open_, rows, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, None, True, [], 0
        begun = False

        def segment(cut):
            out = [conv, number, open_ or cut, *([r[k] for r in rows] for k in range(3))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, _TYPES)], _NAMES)

        for batch in H.slices(batches, 3):
            for c, turn, role, text, gone in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if begun and (c != conv or len(rows) >= rows_a_segment or size > SEGMENT_BYTES):
                    yield segment(c == conv)
                    open_, rows, size, number = c == conv, [], 0, number + 1
                begun, conv = True, c
                if not gone:
                    rows.append((turn, role, text))
                    size += len(text)
        if begun:
            yield segment(True)

    return run


def _between(batches):
    """Segments with the digests of rows held before -> their 4 x 4 costs."""
    for batch in batches:
        rows = batch.to_pylist()
        costs = [between(coded(r["roles"], faults(r["roles"], r["texts"], frozenset(r["late"] or ())))) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "segment", "costs"])


def _ends(batches):
    """A conversation's segments from the last to the first with their costs -> what each segment's last states cost."""
    conv, ends, begun = None, ENDS, False
    for batch in batches:
        out = []
        for c, costs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if not begun or c != conv:
                conv, ends, begun = c, ENDS, True
            out.append(list(ends))
            ends = tuple(min(costs[4 * s + e] + ends[e] for e in STATES) for s in STATES)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["segment", "ends"])


_TRACED = "conv_id long, segment long, turns array<long>, roles array<string>, texts array<string>, faults array<string>, audits array<string>, leave array<int>"


def _traced(batches):
    """Segments with their ends and late digests -> faults, and edits from each first state."""
    for batch in batches:
        rows = batch.to_pylist()
        found = [faults(r["roles"], r["texts"], frozenset(r["late"] or ())) for r in rows]
        codes = [coded(r["roles"], f) for r, f in zip(rows, found)]
        done = [(_traces_of_short if len(c) <= AUCTION_ROWS else traces)(c, tuple(r["ends"])) for c, r in zip(codes, rows)]
        extra = [pa.array(found, pa.list_(pa.string())), pa.array([[a for a, _ in d] for d in done], pa.list_(pa.string())), pa.array([[s for _, s in d] for d in done], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "segment", "turns", "roles", "texts")), *extra], ["conv_id", "segment", "turns", "roles", "texts", "faults", "audits", "leave"])


class Report:
    """A conversation's figures and digest, gathered segment by segment."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.audit = conv, _NONE, []
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.first = self.last = self.role = None
        self.turns, self.sha, self.empty = 0, hashlib.sha256(), True

    def write(self, rows) -> None:
        for _, role, text, _ in rows:
            self.sha.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
            self.empty = False

    def add(self, r: dict) -> None:
        for turn, role, fault in zip(r["turns"], r["roles"], r["faults"]):
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            if self.role is not None and self.role + role[:1] not in ("su", "ua", "au"):
                self.count["illegal"] += 1
            self.role = role[:1]
            if fault:
                self.count[fault] += 1
        audit = r["audits"][self.state]
        left = iter(r["faults"])
        for letter in audit:
            fault = next(left) if letter != "I" else ""
            self.count["cost"] += COST[letter] + TRUNCATED * (fault == "truncated" and letter != "D")
        self.write(edited(audit, self.state, zip(r["turns"], r["roles"], r["texts"])))
        self.audit.append(audit)
        self.state = r["leave"][self.state]

    def row(self) -> tuple:
        self.write(edited(SUFFIX[self.state], self.state, iter(())))
        self.audit.append(SUFFIX[self.state])
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        c = self.count
        return self.conv, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"] + INSERT * len(SUFFIX[self.state]), "".join(self.audit), self.sha.hexdigest()


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(batches):
    """Traced segments in order -> a row for each conversation; what is held is its figures and its audit."""
    names, types = [c.split()[0] for c in _REPORT.split(", ")], [pa.int64()] * 7 + [pa.string()] * 2
    now = None

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names)

    for batch in batches:
        done = []
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            if now is None or r["conv_id"] != now.conv:
                if now is not None:
                    done.append(now.row())
                now = Report(r["conv_id"])
            now.add(r)
        if done:
            yield out(done)
    if now is not None:
        yield out([now.row()])


_REPAIRED = "conv_id long, place long, turn long, role string, text string, edit string"


def _repaired(batches):
    """Traced segments in order -> the repaired rows in order."""
    conv, state, place, begun = None, _NONE, 0, False

    def out(rows, c, place):
        columns = [[c] * len(rows), range(place, place + len(rows)), *([r[k] for r in rows] for k in range(4))]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 3)], ["conv_id", "place", "turn", "role", "text", "edit"])

    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            if not begun or r["conv_id"] != conv:
                if begun:
                    yield out(list(edited(SUFFIX[state], state, iter(()))), conv, place)
                conv, state, place, begun = r["conv_id"], _NONE, 0, True
            rows = list(edited(r["audits"][state], state, zip(r["turns"], r["roles"], r["texts"])))
            yield out(rows, conv, place)
            state, place = r["leave"][state], place + len(rows)
    if begun:
        yield out(list(edited(SUFFIX[state], state, iter(()))), conv, place)


def _then(*steps):
    def run(batches):
        for step in steps:
            batches = step(batches)
        return batches

    return run


def digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(role, F.lit("\0"), text).cast("binary"))


def _solved(rows: DataFrame, rows_a_segment: int, last, schema: str) -> DataFrame:
    spark = rows.sparkSession
    ordered = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 256), F.xxhash64("text"), "_copy"]
    placed = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "gone", F.monotonically_increasing_id().alias("_copy"))
    placed = placed.repartitionByRange(*ordered).sortWithinPartitions(*ordered).drop("_copy")
    with small_batches(spark):
        segments = materialise(placed.mapInArrow(_segments(rows_a_segment), _SEGMENT), "conversation-segments")
    none = F.lit(None).cast("array<string>").alias("late")
    ends = F.array(*[F.lit(e).cast("long") for e in ENDS]).alias("ends")
    cut = segments.where("open")
    keys = cut.select("conv_id", "segment", F.explode(F.arrays_zip("roles", "texts")).alias("r")).select("conv_id", "segment", digest(F.col("r.roles"), F.col("r.texts")).alias("k")).distinct()
    first = keys.groupBy(F.col("conv_id").alias("c"), F.col("k").alias("d")).agg(F.min("segment").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = keys.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k") == F.col("d")) & (F.col("segment") > F.col("m"))).groupBy(F.col("segment").alias("s")).agg(F.collect_list("k").alias("late"))
    cut = materialise(cut.join(late, F.col("segment") == F.col("s"), "left").drop("s", "open"), "conversation-cut")
    with small_batches(spark, 16):
        costs = materialise(cut.mapInArrow(_between, "conv_id long, segment long, costs array<long>"), "conversation-costs")
        back = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment")).mapInArrow(_ends, "segment long, ends array<long>")
        traced = materialise(cut.join(back, "segment").select("conv_id", "segment", "turns", "roles", "texts", "late", "ends").mapInArrow(_traced, _TRACED), "conversation-traced")
    whole = segments.where("not open").select("conv_id", "segment", "turns", "roles", "texts", none, ends)
    joined = traced.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return whole.mapInArrow(_then(_traced, last), schema).unionByName(joined.mapInArrow(last, schema))


def _given(conversations: DataFrame) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    text = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in names[2:]]
    gone = F.col("gone") if "gone" in conversations.columns else F.lit(False)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *text, F.coalesce(gone, F.lit(False)).alias("gone"))


def repair_report(conversations: DataFrame, rows_a_segment: int = SEGMENT_ROWS) -> DataFrame:
    """Faults, and the cheapest repair, of each conversation (conv_id, turn, role, text; a boolean gone marks rows that are not there).

    Rows go by turn, nulls first, ties by role, then text. A row is blank, a duplicate of an earlier (role, text), or truncated (its
    last character but blanks is no stop); the first of these counts. Edits keep a row (0), re-role it to user or assistant (1),
    delete it (2; a must for blanks and duplicates), or insert an empty one (5); a truncated row that stays adds 5. Roles must then read
    nothing, or user and assistant in turn after at most one system row. Of the cheapest edits ``audit`` has the least letters.

    Returns conv_id, gaps (missing turns), blank, duplicate, truncated, illegal (neighbours of roles that do not follow),
    cost, audit and the SHA-256 of the repaired role:text lines. A conversation without rows has zeros and empty strings, also one
    whose rows are all gone. Null role and text are one space; a null conv_id is a conversation; equal rows of a turn are each
    a row; texts of any length are read whole; other columns are ignored; an empty table gives none. An audit, and a digest, are one
    value: its conversation's segments stream through one task in order, and all else is done segment by segment.
    """
    return _solved(_given(conversations), rows_a_segment, _reports, _REPORT)


def repair(conversations: DataFrame, rows_a_segment: int = SEGMENT_ROWS) -> DataFrame:
    """The repaired rows: conv_id, place from 0, turn (null: inserted), role, text, edit (K, R or I). Rows and ties as in ``repair_report``."""
    return _solved(_given(conversations), rows_a_segment, _repaired, _REPAIRED)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32(conv_id:turn) % 20: 0 drops one, 1 empties it, 2 takes its stops, 3 repeats it, 4 makes it a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), hit.alias("_hit"))
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_hit") == 0).alias("gone"), copies.alias("_c")).drop("_c")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
