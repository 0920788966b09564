r"""Conversation structure repair: cheapest edits by a bidirectional search of the edit lattice.

Turns must come as ``(system? (user assistant)+)?``, told by the first letter of
their roles. A turn is kept (0), gets the role user or assistant (3), or is
deleted (4); an empty user or assistant turn is inserted anywhere (3). Blank turns and
repeats of an earlier (role, text) are deleted for certain; a turn cut off before its end
(its last character is none of ``.!?``) costs 3 more unless it is deleted. The audit
of a conversation is the edits' initials (K, R, D, I) in order; of equally
cheap ones the least by ASCII is taken. It settles the repaired turns.

The lattice has a node per (turns consumed, state), the state being what came
last: nothing, system, user or assistant. From its start and from its accepted
ends Dijkstra heaps grow towards each other; they stop when no undiscovered path
can be as cheap, so that all crossings of equal cost are known, and the least
concatenation over the crossings is read off, edit by edit.

Spark deals the work. Turns are ordered by range partitioning on (conv_id, turn,
role, md5 of the text), without their texts, so a conversation of any length
lies over many tasks. Pieces of at most ``PIECE_ROWS`` turns go into the search as one
letter per turn. The pieces of a longer conversation are searched alone,
between each pair of states, and joined by the same search over pieces. Then the
texts meet the audit once: sorted by conversation they are read as a stream.

Odd input: a null role or text is empty; rows with a null conv_id form one
conversation; null turns come first; ties of a turn are ordered by role, then by
the md5 of the text; repeated rows are repeats; an empty table gives no rows;
other input columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from heapq import heappop, heappush
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.session import stored

PIECE_ROWS = 1024  # a power of two
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
# what user or assistant turn may follow a state
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
# one letter per turn: the role's first letter (x: any other), small when sound, capital when cut off; digits are deleted
SOUND, CUT, GONE = "suax", "SUAX", "1230"

Edge = tuple[str, int, int]  # label, cost, node


def after(state: int, role: str) -> int | None:
    """The state after a turn whose role begins with the letter, or None where it may not stand."""
    if role == "s":
        return SYSTEM if state == NOTHING else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def lattice(codes: str, insert_last: bool) -> list[list[Edge]]:
    """The edges out of node ``STATES * turns consumed + state``; without ``insert_last`` nothing is inserted at the end."""
    out: list[list[Edge]] = []
    for i in range(len(codes) + 1):
        code = codes[i] if i < len(codes) else ""
        here, there = STATES * i, STATES * (i + 1)
        for state in range(STATES):
            edges: list[Edge] = []
            if code:
                edges.append(("D", DELETE, there + state))
                if code not in GONE:
                    more = TRUNCATED if code in CUT else 0
                    kept = after(state, code.lower())
                    if kept is not None:
                        edges.append(("K", KEEP + more, there + kept))
                    edges.append(("R", REROLE + more, there + NEXT[state]))
            if code or insert_last:
                edges.append(("I", INSERT, here + NEXT[state]))
            out.append(edges)
    return out


def cheapest(out: list[list[Edge]], start: int, ends: list[int]) -> tuple[float, list[str]]:
    """Cost and labels of the cheapest path from ``start`` to one of ``ends``, least by label; (inf, []) if there is none.

    The labels out of a node differ, none begins with another, and edges of cost 0 lead to later nodes.
    """
    into: list[list[tuple[int, int]]] = [[] for _ in out]
    for u, edges in enumerate(out):
        for _, cost, v in edges:
            into[v].append((cost, u))
    ahead, back = {start: 0}, dict.fromkeys(ends, 0)
    forward, reverse = [(0, start)], [(0, -e) for e in sorted(ends, reverse=True)]
    seen: list[int] = []  # settled from the start, in order
    met: set[int] = set()  # settled from the ends
    best = inf
    settled: set[int] = set()
    while forward and reverse and forward[0][0] + reverse[0][0] <= best:
        if reverse[0][0] <= forward[0][0]:
            d, v = heappop(reverse)
            v = -v
            if v in met:
                continue
            met.add(v)
            best = min(best, d + ahead.get(v, inf))
            for cost, u in into[v]:
                if d + cost < back.get(u, inf):
                    back[u] = d + cost
                    heappush(reverse, (d + cost, -u))
        else:
            d, u = heappop(forward)
            if u in settled:
                continue
            settled.add(u)
            seen.append(u)
            best = min(best, d + back.get(u, inf))
            for _, cost, v in out[u]:
                if d + cost < ahead.get(v, inf):
                    ahead[v] = d + cost
                    heappush(forward, (d + cost, v))
    if best == inf:
        return inf, []

    def crosses(u: int, cost: int, v: int) -> bool:
        return v in met and ahead[u] + cost + back[v] == best

    # from which of the settled nodes a cheapest path goes on
    good: set[int] = set()
    for u in reversed(seen):
        if u in met and ahead[u] + back[u] == best or any(
                crosses(u, cost, v) or (v in good and ahead[u] + cost == ahead[v]) for _, cost, v in out[u]):
            good.add(u)
    labels, u, crossed = [], start, start in met and back[start] == best
    last = set(ends)
    while not (u in last and (back[u] == 0 if crossed else ahead[u] == best)):
        if crossed:
            label, cost, v = min(e for e in out[u] if e[2] in met and e[1] + back[e[2]] == back[u])
        else:
            label, cost, v = min(e for e in out[u] if crosses(u, e[1], e[2]) or (
                e[2] in good and ahead[u] + e[1] == ahead[e[2]]))
            crossed = crosses(u, cost, v)
        labels.append(label)
        u = v
    return best, labels


def audit_of(codes: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    n = STATES * len(codes)
    cost, labels = cheapest(lattice(codes, True), NOTHING, [n + NOTHING, n + ASSISTANT])
    return int(cost), "".join(labels)


def ways(codes: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a piece of a conversation, nothing inserted at its end."""
    out, n = lattice(codes, False), STATES * len(codes)
    found = [(a, b, *cheapest(out, a, [n + b])) for a in range(STATES) for b in range(STATES)]
    return [(a, b, int(cost), "".join(labels)) for a, b, cost, labels in found if cost < inf]


def joined(pieces: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """Cost of a conversation in pieces and the audit of each; the last one takes what is inserted at the end."""
    out: list[list[Edge]] = [[] for _ in range(STATES * (len(pieces) + 1))]
    for i, found in enumerate(pieces):
        for a, b, cost, audit in found:
            out[STATES * i + a].append((audit, cost, STATES * (i + 1) + b))
    n = STATES * len(pieces)
    for state in range(STATES):
        out[n + state].append(("I", INSERT, n + NEXT[state]))
    cost, labels = cheapest(out, NOTHING, [n + NOTHING, n + ASSISTANT])
    return int(cost), labels[:len(pieces) - 1] + ["".join(labels[len(pieces) - 1:])]


def illegal_pairs(codes: str) -> int:
    """Neighbouring turns whose roles may not follow each other."""
    roles = codes.lower().translate(str.maketrans(GONE, SOUND))
    return sum(roles[i:i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, role, fault) of the turns, ordered by ``seq`` and stored; texts are left behind."""
    text = F.coalesce("text", F.lit(""))
    last = F.rtrim(text, F.lit(BLANKS))
    slim = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(text).alias("tie"),
        (last == "").alias("blank"), (~F.substring(last, -1, 1).isin(".", "!", "?")).alias("cut"),
        # repeated rows are dealt over tasks as well; their order among themselves doesn't matter
        F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "tie", "row"]
    laid = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    laid = stored(laid.drop("row"), "turns")
    # a turn is a repeat unless it is the first of its (role, text)
    first = laid.groupBy("conv_id", "role", "tie").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    return laid.join(first, "seq", "left").select("conv_id", "turn", "seq", "role", fault.alias("fault"))


def pieces_of(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv_id, first, codes): at most ``piece_rows`` neighbouring turns of a conversation, a letter each."""
    kind = F.instr(F.lit(SOUND[:3]), F.substring("role", 1, 1))
    kind = F.when((F.col("role") == "") | (kind == 0), 4).otherwise(kind)
    row = F.when(F.col("fault").isNull(), SOUND).when(F.col("fault") == "truncated", CUT).otherwise(GONE)
    code = F.substring(row, kind, F.lit(1))
    block = F.call_function("div", F.col("seq"), F.lit(piece_rows))
    return turns.select("conv_id", "seq", block.alias("block"), code.alias("code")).groupBy("conv_id", "block").agg(
        F.min("seq").alias("first"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"]), "").alias("codes"))


def _per_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, its rows without it) of a sorted stream."""
    key, held = None, []
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and conv != key:
                yield key, held
                held = []
            key = conv
            held.append(tuple(row))
    if held:
        yield key, held


def _frames(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size; the last column is the long one."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if len(held) >= most or size > chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


AUDITS = pa.schema([("conv_id", pa.int64()), ("first", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()),
                    ("audit", pa.string())])
AUDITS_DDL = "conv_id long, first long, cost long, illegal long, audit string"


def _mapped(make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _frames(make(batches), schema)
    return work


def audits(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv_id, first, cost, illegal, audit) per piece; cost and pairs of a conversation are the sums over its pieces."""
    pieces = stored(pieces_of(turns, piece_rows), "pieces")
    many = pieces.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("__llm_id"))
    in_many = F.col("conv_id").eqNullSafe(F.col("__llm_id"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for conv, first, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cost, audit = audit_of(codes)
                yield conv, first, cost, illegal_pairs(codes), audit

    ways_schema = pa.schema([("conv_id", pa.int64()), ("first", pa.int64()), ("ends", pa.string()), ("illegal", pa.int64()),
                             ("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for conv, first, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b, cost, audit in ways(codes):
                    yield conv, first, codes[0] + codes[-1], illegal_pairs(codes), a, b, cost, audit

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, rows in _per_conversation(batches):
            found: dict[int, list] = {}
            for first, ends, illegal, *way in rows:
                found.setdefault(first, [ends, illegal, []])[2].append(tuple(way))
            cost, labels = joined([p[2] for p in found.values()])
            last = ""
            for (first, (ends, illegal, _)), audit in zip(found.items(), labels, strict=True):
                yield conv, first, cost, illegal + illegal_pairs(last + ends[0]), audit
                cost, last = 0, ends[1]

    cols = ["conv_id", "first", "codes"]
    short = pieces.join(many, in_many, "left_anti").select(*cols).mapInArrow(_mapped(whole, AUDITS), AUDITS_DDL)
    # the pieces of a long conversation are searched in many tasks; only their ends and costs come together
    long = pieces.join(many, in_many, "left_semi").select(*cols).repartition("conv_id", "first").mapInArrow(
        _mapped(searched, ways_schema), "conv_id long, first long, ends string, illegal long, before int, after int, cost long, "
                                        "audit string")
    long = long.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(
        _mapped(put_together, AUDITS), AUDITS_DDL)
    return short.unionByName(long)


EDITS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                   ("text", pa.string())])


def edited_turns(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): every edit in order, each conversation in one partition.

    A deleted turn is there with its old role; the repaired conversation is the others.
    """

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        def inserted() -> Iterator[tuple]:
            nonlocal at, state
            while letters[at:at + 1] == "I":
                state = NEXT[state]
                yield key, at, "I", ROLE[state], ""
                at += 1

        key, letters, at, state = object(), "", 0, NOTHING
        for batch in batches:
            for conv, part, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != key:
                    yield from inserted()  # at the end of the conversation before
                    key, held, letters, at, state = conv, [], None, 0, NOTHING
                if part is not None:  # the audits come before the turns
                    held.append(part)
                    continue
                if letters is None:
                    letters = "".join(held)
                yield from inserted()
                letter = letters[at]
                if letter == "R":
                    state = NEXT[state]
                    role = ROLE[state]
                elif letter == "K":
                    state = after(state, role[0])
                yield key, at, letter, role, text
                at += 1
        yield from inserted()

    turns = rows.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "turn",
                        F.lit(None).cast("string").alias("part"), F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.md5("text"))
    parts = audit.select("conv_id", F.lit(0).alias("kind"), "first", F.col("audit").alias("part"))
    both = turns.unionByName(parts, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", "first", "turn", "role", "tie").select(
        "conv_id", "part", "role", "text").mapInArrow(
        _mapped(edit, EDITS), "conv_id long, place long, edit string, role string, text string")


def damage(rows: DataFrame) -> DataFrame:
    """Fixed faults by crc32 of ``conv_id:turn``: dropped, emptied, unpunctuated, repeated or made user turns."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    h = F.crc32(key.cast("binary")) % 20
    faulty = rows.select("conv_id", "turn", h.alias("__llm_h"), F.when(h == 4, "user").otherwise(role).alias("role"),
                         F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    times = F.when(F.col("__llm_h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return faulty.where("__llm_h <> 0").withColumn("__llm_n", F.explode(times)).drop("__llm_h", "__llm_n")


def reports(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation: its gaps and faults, the cost and audit of its repair, and the repaired turns' hash."""
    turns = stored(faults(rows), "faults")
    searched = stored(audits(turns, piece_rows), "audits")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counted = turns.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.coalesce(F.col("fault") == k, F.lit(False))).alias(k) for k in ("blank", "duplicate", "truncated")])
    costs = searched.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    hashes = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string()), ("audit", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, state, letters, lines = None, None, [], 0
        for batch in batches:
            for conv, letter, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        yield key, state.hexdigest(), "".join(letters)
                    key, state, letters, lines = conv, sha256(), [], 0
                letters.append(letter)
                if letter != "D":
                    state.update(("\n" * (lines > 0) + f"{role}:{text}").encode())
                    lines += 1
        if state is not None:
            yield key, state.hexdigest(), "".join(letters)

    digests = edited_turns(rows, searched).select("conv_id", "edit", "role", "text").mapInArrow(
        _mapped(digest, hashes), "conv_id long, repaired_sha256 string, audit string")
    every = counted.unionByName(costs, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return every.groupBy("conv_id").agg(*[F.max(n).alias(n) for n in names])


def with_empty(reported: DataFrame, rows: DataFrame) -> DataFrame:
    """The reports, and zeros for conversations of ``rows`` that have no turn left."""
    every = reported.unionByName(rows.select("conv_id").distinct(), allowMissingColumns=True)
    blank = {"audit": "", "repaired_sha256": sha256().hexdigest()}
    return every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(blank.get(c, 0))).alias(c)
                                          for c in reported.columns if c != "conv_id"])
