"""Conversation structure repair by a bidirectional tight-arc DAG (operator 12).

A conversation is well formed if its role initials read ``(s?(ua)+)?``.  Its rows are edited in order: a
row is kept (0), given the role user or assistant (1) or deleted (2), and an empty user or assistant row
is inserted (5) anywhere; a row whose text is cut short adds 5 unless it is deleted, and a blank or
repeated row has to be deleted.  Nodes of the DAG are a place between rows and a state of the pattern.
Forward and backward minimum costs say which arcs are tight, that is on some cheapest path; a frontier
of nodes then moves over tight arcs, at each step by the least edit letter (D, I, K, R) that any of its
nodes has, so the audit is the ASCII-least of all cheapest ones.

Rows are dealt to ranges of (conversation, turn), so a conversation of any length is spread over tasks
in runs.  A run's costs are a 4 x 4 min-plus matrix; the matrices of conversations that cross ranges (two
for each range at most, 16 numbers each) meet on the driver and give each run the costs before and behind
it, and the runs then walk the DAG by themselves.  Only the SHA-256 of a repaired conversation, a function
that can't be split, reads a conversation's rows in one task, row after row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOT_BLANK, LAST = r"[^\x20\x09-\x0D]", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"
#: States: nothing yet, after s, after u, after a.  A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
FAR = 1 << 60


# the conversation's rows -------------------------------------------------------------------------


def damage(rows: DataFrame, modulus: int = 20) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32(conv_id:turn) % modulus: 0 drops a row, 1 empties its
    text, 2 removes its [.!?], 3 repeats it, 4 makes its role user.  A null counts as one space; conv_id and
    turn themselves keep their nulls."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    name = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    own = own.withColumn("kind", F.crc32(F.encode(name, "UTF-8")) % modulus).where("kind != 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def in_runs(rows: DataFrame) -> DataFrame:
    """Rows in order within ranges of (conversation, turn), written: run is the range, at the place in it.

    Rows of one turn are in order of role and SHA-256 of the text.  late: the same role and text has an
    earlier turn.  Equal rows stand together and may part into two runs."""
    own = rows.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = own.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"), F.max(when).alias("last")).where("first < last")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blank = ~F.col("text").rlike(NOT_BLANK)
    marked = own.join(firsts, same, "left").select(
        "conv_id", "turn", "role", "text", "digest", blank.alias("blank"), F.coalesce(when > F.col("first"), F.lit(False)).alias("late"),
        (~blank & ~F.regexp_extract("text", LAST, 1).isin(".", "!", "?")).alias("cut"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("salt")]
    dealt = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    return materialize(dealt.withColumns({"run": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "runs")


# the DAG -----------------------------------------------------------------------------------------


def row_code(role: str, fault: str) -> str:
    """What the DAG needs of a row: D if it has to go, else its initial, with * if it is truncated."""
    if fault in ("blank", "duplicate"):
        return "D"
    return (role[:1] if role[:1] in ("s", "u", "a") else "-") + ("*" if fault == "truncated" else "")


def arcs(code: str, state: int) -> list[tuple[str, int, int, int, str]]:
    """(letter, cost, next state, rows taken, role initial given) of the arcs at a node; code: the next row's, empty behind the last."""
    new = [(i, MOVES[state, i]) for i in ("u", "a") if (state, i) in MOVES]
    out = [("I", INSERT, to, 0, i) for i, to in new]
    if code:
        out.append(("D", DELETE, state, 1, ""))
    if code and code != "D":
        more = TRUNCATED if code.endswith("*") else 0
        if (state, code[0]) in MOVES:
            out.append(("K", KEEP + more, MOVES[state, code[0]], 1, code[0]))
        out += [("R", REROLE + more, to, 1, i) for i, to in new]
    return out


Costs = tuple[int, ...]


def over(costs: Costs, matrix: tuple[Costs, ...]) -> Costs:
    """Min-plus product of a row of costs and a matrix."""
    return tuple(min(FAR, *(costs[s] + matrix[s][t] for s in STATES)) for t in STATES)


def back(matrix: tuple[Costs, ...], costs: Costs) -> Costs:
    return tuple(min(FAR, *(matrix[s][t] + costs[t] for t in STATES)) for s in STATES)


def _matrix(code: str, taken: int) -> tuple[Costs, ...]:
    rows = [[FAR] * 4 for _ in STATES]
    for s in STATES:
        for _, cost, to, n, _ in arcs(code, s):
            if n == taken:
                rows[s][to] = min(rows[s][to], cost)
        if not taken:
            rows[s][s] = 0
    return tuple(map(tuple, rows))


def _inserts() -> tuple[Costs, ...]:
    """Least costs of any number of inserted rows."""
    once = _matrix("", 0)
    more = once
    for _ in STATES:
        more = tuple(over(row, once) for row in more)
    return more


FREE = _inserts()
#: For each of the eight codes: inserted rows, then the row.
STEP = {c: tuple(over(row, _matrix(c, 1)) for row in FREE) for c in ("D", "s", "u", "a", "-", "s*", "u*", "a*", "-*")}
BEGIN: Costs = tuple(0 if s == START else FAR for s in STATES)
END: Costs = back(FREE, tuple(0 if s in ENDS else FAR for s in STATES))


def run_matrix(codes: list[str]) -> tuple[Costs, ...]:
    rows = [tuple(0 if s == t else FAR for t in STATES) for s in STATES]
    for code in codes:
        rows = [over(row, STEP[code]) for row in rows]
    return tuple(rows)


@dataclass
class Around:
    """What a run of a conversation knows of the rest: least costs on arrival and behind it, the frontier
    on arrival, whether it is the last run, and the role initial of the row before."""

    start: Costs = BEGIN
    end: Costs = END
    frontier: frozenset[int] = field(default_factory=lambda: frozenset({START}))
    last: bool = True
    before: str | None = None


def walk(codes: list[str], around: Around) -> tuple[list[tuple[str, int, str, int]], frozenset[int]]:
    """([(letter, row, initial given, cost)], frontier at the end) of the ASCII-least cheapest path through a run."""
    forward, arrival = [over(around.start, FREE)], around.start
    for code in codes:
        arrival = over(arrival, STEP[code])
        forward.append(over(arrival, FREE))
    backward = [around.end]
    for code in reversed(codes):
        backward.append(back(STEP[code], backward[-1]))
    backward.reverse()
    best = min(a + b for a, b in zip(forward[0], backward[0]))
    edits: list[tuple[str, int, str, int]] = []
    nodes = {(0, s) for s in around.frontier}
    while True:
        tight: dict[str, dict[tuple[int, int], tuple[str, int, str, int]]] = {}
        for place, state in sorted(nodes):
            if place == len(codes) and not around.last:
                continue  # its arcs are the next run's
            for letter, cost, to, taken, initial in arcs(codes[place] if place < len(codes) else "", state):
                if forward[place][state] + cost + backward[place + taken][to] == best:
                    tight.setdefault(letter, {})[place + taken, to] = (letter, place, initial, cost)
        if not tight:
            return edits, frozenset(s for _, s in nodes)
        chosen = tight[min(tight)]
        edits.append(next(iter(chosen.values())))
        nodes = set(chosen)


# runs on Spark -----------------------------------------------------------------------------------


@dataclass
class Segment:
    """The rows of one conversation within one run."""

    run: int
    conv: object
    at: list[int]
    roles: list[str]
    faults: list[str]

    def codes(self) -> list[str]:
        return [row_code(r, f) for r, f in zip(self.roles, self.faults)]


def segments(batches: Iterator[pa.RecordBatch], carried: set[int]) -> Iterator[tuple[Segment, bool, bool]]:
    """(segment, first of its run, last of its run) from rows in order of run and place.  carried: runs whose
    first row equals the last row before them."""
    held: Segment | None = None
    first = True
    before = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("run", "at", "conv_id", "turn", "role", "digest", "blank", "late", "cut")]
        for run, at, conv, turn, role, digest, blank, late, cut in zip(*cols):
            row = (run, conv, turn, role, digest)
            new_run = before is None or before[0] != run
            again = run in carried if new_run else row == before
            if new_run or before[1] != conv:
                if held is not None:
                    yield held, first, new_run
                    first = new_run
                held = Segment(run, conv, [], [], [])
            held.at.append(at)
            held.roles.append(role)
            held.faults.append("blank" if blank else "duplicate" if late or again else "truncated" if cut else "")
            before = row
    if held is not None:
        yield held, first, True


def _in_order(runs: DataFrame) -> DataFrame:
    narrow = runs.select("run", "at", "conv_id", "turn", "role", "digest", "blank", "late", "cut")
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return narrow.repartition(parts, "run").sortWithinPartitions("run", "at")


def _crossing(runs: DataFrame, kind: str) -> tuple[set[int], dict[tuple, Around]]:
    """(runs that begin with a repeated row, what each run of a conversation in several runs knows of the rest).

    All that is collected here is two rows for each range."""
    identity = F.struct("conv_id", "turn", "role", "digest")
    edges = runs.groupBy("run").agg(F.min_by(identity, "at").alias("first"), F.max_by(identity, "at").alias("last")).orderBy("run").collect()
    carried = {b.run for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]}
    spanning = {b["first"].conv_id for a, b in zip(edges, edges[1:]) if a["last"].conv_id == b["first"].conv_id}
    if not spanning:
        return carried, {}
    ends = {a.run for a, b in zip(edges, edges[1:]) if a["last"].conv_id == b["first"].conv_id} | {b.run for a, b in zip(edges, edges[1:]) if a["last"].conv_id == b["first"].conv_id}
    rows = runs.where(F.col("run").isin(sorted(ends)))  # as many values as there are ranges, at most

    def summaries(batches):
        for seg, first, last in segments(batches, carried):
            if (first or last) and seg.conv in spanning:
                matrix = [x for row in run_matrix(seg.codes()) for x in row]
                yield pa.RecordBatch.from_pylist([{"run": seg.run, "first": seg.roles[0][:1], "last": seg.roles[-1][:1], "conv_id": seg.conv, "matrix": matrix}], pa.schema(fields))

    conv_type = runs.select("conv_id").limit(0).toArrow().schema.field("conv_id").type
    fields = [("run", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("conv_id", conv_type), ("matrix", pa.list_(pa.int64()))]
    found: dict = {}
    for r in sorted(in_batches(_in_order(rows), summaries, f"run int, first string, last string, conv_id {kind}, matrix array<long>").collect(), key=lambda r: r.run):
        found.setdefault(r.conv_id, []).append((r.run, tuple(tuple(r.matrix[4 * s : 4 * s + 4]) for s in STATES), r["last"]))
    around: dict[tuple, Around] = {}
    for conv, parts in found.items():
        costs, end = BEGIN, END
        for k, (run, matrix, _) in enumerate(parts):
            around[run, conv] = Around(costs, END, frozenset(), k == len(parts) - 1, parts[k - 1][2] if k else None)
            costs = over(costs, matrix)
        for run, matrix, _ in reversed(parts):
            around[run, conv].end = end
            end = back(matrix, end)

    def exits(batches):
        for seg, first, last in segments(batches, carried):
            if (seg.run, seg.conv) in around:
                here = around[seg.run, seg.conv]
                for size in (1, 2, 3, 4):
                    for states in combinations(STATES, size):
                        out = walk(seg.codes(), Around(here.start, here.end, frozenset(states), here.last, None))[1]
                        yield pa.RecordBatch.from_pylist([{"run": seg.run, "conv_id": seg.conv, "arrive": list(states), "leave": sorted(out)}], pa.schema(steps))

    steps = [("run", pa.int32()), ("conv_id", conv_type), ("arrive", pa.list_(pa.int32())), ("leave", pa.list_(pa.int32()))]
    leave = {(r.run, r.conv_id, frozenset(r.arrive)): frozenset(r.leave) for r in in_batches(_in_order(rows), exits, f"run int, conv_id {kind}, arrive array<int>, leave array<int>").collect()}
    for conv, parts in found.items():
        frontier = frozenset({START})
        for run, _, _ in parts:
            around[run, conv].frontier = frontier
            frontier = leave[run, conv, frontier]
    return carried, around


def edit_rows(runs: DataFrame) -> DataFrame:
    """The edits of every row, written: (conv_id, run, at, place, letter, role) in order of run, at and place, and
    for each conversation and run one row without a letter that counts its faults.

    role is the new row's initial; at is the row that is edited, or before which a row is inserted, and
    behind the last row one more than its place."""
    kind = runs.schema["conv_id"].dataType.simpleString()
    conv_type = runs.select("conv_id").limit(0).toArrow().schema.field("conv_id").type
    carried, around = _crossing(runs, kind)
    names = ["conv_id", "run", "at", "place", "letter", "role", "cost", "blank", "duplicate", "truncated", "illegal"]
    types = [conv_type, pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5]

    def edit(batches):
        out: list[list] = [[] for _ in names]

        def flush():
            arrays = [pa.array(c, t) for c, t in zip(out, types)]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def put(*row):
            for c, x in zip(out, row):
                c.append(x)

        for seg, _, _ in segments(batches, carried):
            here = around.get((seg.run, seg.conv), Around())
            edits = walk(seg.codes(), here)[0]
            for k, (letter, row, initial, _) in enumerate(edits):
                put(seg.conv, seg.run, seg.at[row] if row < len(seg.at) else seg.at[-1] + 1, k, letter, initial, 0, 0, 0, 0, 0)
            initials = [r[:1] for r in seg.roles]
            pairs = zip([here.before, *initials] if here.before is not None else initials, initials if here.before is not None else initials[1:])
            counts = [seg.faults.count(f) for f in ("blank", "duplicate", "truncated")]
            put(seg.conv, seg.run, -1, -1, None, None, sum(e[3] for e in edits), *counts, sum(a + b not in LEGAL for a, b in pairs))
            if len(out[0]) > 20_000:
                yield flush()
        yield flush()

    return materialize(in_batches(_in_order(runs), edit, f"conv_id {kind}, run int, at long, place int, letter string, role string, cost long, blank long, duplicate long, truncated long, illegal long"), "edits")


def repaired_rows(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, run, at, place, role, text) of the repaired conversations, in order of run, at and place."""
    given = edits.where("letter IN ('K', 'R')").select("run", "at", "place", "letter", F.col("role").alias("initial"))
    name = F.when(F.col("initial") == "u", ROLES["u"]).otherwise(ROLES["a"])
    stay = runs.select("conv_id", "run", "at", "role", "text").join(given, ["run", "at"])
    stay = stay.select("conv_id", "run", "at", "place", F.when(F.col("letter") == "R", name).otherwise(F.col("role")).alias("role"), "text")
    new = edits.where("letter = 'I'").select("conv_id", "run", "at", "place", F.when(F.col("role") == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text"))
    return stay.unionByName(new)


def conversation_hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of role:text of the repaired rows, joined by newlines.  A hash can't be split, so a
    conversation is read by one task, row after row; nothing but the state of the hash is held."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    conv_type = rows.select("conv_id").limit(0).toArrow().schema.field("conv_id").type

    def digest(batches):
        conv, state, seen = None, None, False
        done: list[tuple] = []
        for batch in batches:
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not seen or key != conv:
                    if seen:
                        done.append((conv, state.hexdigest()))
                    conv, state, seen = key, hashlib.sha256(), True
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pack(done)
            done = []
        if seen:
            yield pack([(conv, state.hexdigest())])

    def pack(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], conv_type), pa.array([p[1] for p in pairs], pa.string())], names=["conv_id", "sha256"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("run"), F.col("at"), F.col("place")]
    return in_batches(rows.repartition(parts, "conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text"), digest, f"conv_id {kind}, sha256 string")


@dataclass
class Repair:
    """rows: the repaired rows; edits: the edit letters of every row; report: a row for each conversation."""

    rows: DataFrame
    edits: DataFrame
    report: DataFrame


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None) -> Repair:
    """Repairs conversations (conv_id, turn, role, text), in order of turn, nulls first.

    The report has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of
    every conversation of rows and of ids (conv_id).  The first fault of a row counts: blank (no character but
    white space), duplicate (role and text seen before in the conversation), truncated (doesn't end in . ! or ?).
    Rows of one turn are in order of role and SHA-256 of the text.  A null role or text is one space; a null
    conv_id is a conversation of its own; gaps ignore null turns.  A row whose role begins with anything but
    s, u or a, or is empty, can't be kept as it is.  A conversation without rows has zeros, an empty audit and
    the hash of an empty string.  Further columns are ignored.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    runs = in_runs(rows.select("conv_id", "turn", space("role"), space("text")))
    edits = edit_rows(runs)
    repaired = repaired_rows(runs, edits)
    turns = runs.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    counts = edits.where("letter IS NULL").groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")))
    # letters are put together within runs first, then the runs of a conversation
    letters = edits.where("letter IS NOT NULL").groupBy("conv_id", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda e: e.letter), "").alias("l"))
    audit = letters.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "l"))), lambda e: e.l), "").alias("audit"))
    parts = [turns, counts, audit, conversation_hashes(repaired)]
    report = rows.select("conv_id").distinct() if ids is None else ids.select("conv_id").unionByName(rows.select("conv_id")).distinct()
    for k, part in enumerate(parts):
        part = part.withColumnRenamed("conv_id", f"c{k}")
        report = report.join(part, F.col("conv_id").eqNullSafe(F.col(f"c{k}")), "left").drop(f"c{k}")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    empty = hashlib.sha256(b"").hexdigest()
    report = report.select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"),
    )
    return Repair(repaired, edits.where("letter IS NOT NULL").select("conv_id", "run", "at", "place", "letter", "role"), report)
