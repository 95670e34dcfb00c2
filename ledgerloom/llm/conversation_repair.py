"""Repair of conversations' structure by generalised LR parsing with edits.

The grammar of role initials is S -> (nothing) | P | s P and P -> u a | P u a. Its LR(0) automaton is built from these
productions. A conversation is read row by row; the frontier of the graph-structured stack holds every stack that some
edits of the rows so far reach, each a node (state, node below), so that stacks share what lies below. Edits shift the
row as it is, shift it under another role, skip it, or shift an inserted role first; equal stacks merge, and the least
(cost, audit) stays.

That merge is exact: audits of equal cost at one place are never beginnings of one another (what comes on top would be
insertions, which cost), so whatever follows keeps their order. A stack that costs more than SLACK above the cheapest
cannot win: with one finished pair and one deleted system row the cheapest can do whatever it does. So there are few
frontiers, up to a common cost, and the step from one to the next is remembered per kind of row: a row costs a look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.llm.exact_dedup import from_files, located

PRODUCTIONS = (("S", ""), ("S", "P"), ("S", "sP"), ("P", "ua"), ("P", "Pua"))
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SLACK = 12
ROLES = {"u": "user", "a": "assistant"}
#: A conversation of more rows, or bytes of text, than these is dealt over tasks in segments of about as much at most.
LARGE_ROWS, LARGE_BYTES = 20_000, 8 << 20

# --- LR(0) automaton and stacks -------------------------------------------------------------------------------------


@cache
def closure(items: frozenset) -> frozenset:
    items = set(items)
    todo = list(items)
    while todo:
        p, dot = todo.pop()
        after = PRODUCTIONS[p][1][dot : dot + 1]
        for i, (left, _) in enumerate(PRODUCTIONS):
            if left == after and (i, 0) not in items:
                items.add((i, 0))
                todo.append((i, 0))
    return frozenset(items)


@cache
def goto(state: frozenset, symbol: str) -> frozenset | None:
    moved = frozenset((p, dot + 1) for p, dot in state if PRODUCTIONS[p][1][dot : dot + 1] == symbol)
    return closure(moved) if moved else None


#: The stack of an empty beginning: a node is (state, node below).
BOTTOM = (closure(frozenset((i, 0) for i, (left, _) in enumerate(PRODUCTIONS) if left == "S")), None)


@cache
def reduced(stack: tuple) -> frozenset:
    """The stack itself and all that reductions, but to the start symbol, make of it."""
    found, todo = {stack}, [stack]
    while todo:
        top = todo.pop()
        for p, dot in top[0]:
            left, right = PRODUCTIONS[p]
            if dot == len(right) and left != "S":
                below = top
                for _ in right:
                    below = below[1]
                to = (goto(below[0], left), below)
                if to not in found:
                    found.add(to)
                    todo.append(to)
    return frozenset(found)


@cache
def shifted(stack: tuple, symbol: str) -> tuple:
    """The stacks after ``symbol``. A state that can only be reduced is reduced at once: what it was is of no use."""
    tops = [(to, s) for s in reduced(stack) if (to := goto(s[0], symbol)) is not None]
    return tuple(r for top in tops for r in reduced(top) if not all(dot == len(PRODUCTIONS[p][1]) and PRODUCTIONS[p][0] != "S" for p, dot in r[0]))


@cache
def accepted(stack: tuple) -> bool:
    return any(dot == len(PRODUCTIONS[p][1]) and PRODUCTIONS[p][0] == "S" for s in reduced(stack) for p, dot in s[0])


# --- Frontiers ------------------------------------------------------------------------------------------------------
# A frontier is a tuple of (stack, cost above the cheapest) in the order of the audits. Edits of a row are a string: each
# inserted role's initial, then K, D, or U and A for a row that becomes the user's or the assistant's.

_numbers: dict[tuple, int] = {}
_frontiers: list[tuple] = []
_LETTER = {"u": "I", "a": "I", "K": "K", "D": "D", "U": "R", "A": "R"}


def numbered(frontier: tuple) -> int:
    """A number for each frontier that this process has met: a step is then found by two small keys."""
    if frontier not in _numbers:
        _numbers[frontier] = len(_frontiers)
        _frontiers.append(frontier)
    return _numbers[frontier]


START = numbered(((BOTTOM, 0),))


def audit_of(edits: str) -> str:
    return "".join(_LETTER[e] for e in edits)


def _with_insertions(frontier: tuple) -> dict:
    """stack -> (cost, place of the audit in the frontier, audit letters, edits) with any insertions on top."""
    best = {stack: (cost, rank, "", "") for rank, (stack, cost) in enumerate(frontier)}
    todo = list(best)
    while todo:
        stack = todo.pop()
        cost, rank, letters, edits = best[stack]
        for role in ROLES:
            for to in shifted(stack, role):
                new = (cost + INSERT, rank, letters + "I", edits + role)
                if to not in best or new[:3] < best[to][:3]:
                    best[to] = new
                    todo.append(to)
    return best


@cache
def step(frontier: int, code: str) -> tuple:
    """(frontier after a row of this ``code``, its cheapest cost, for each of its stacks the place before and the edits)."""
    forced, initial, extra = code.isdigit(), code.lower(), TRUNCATED if code.isupper() else 0
    best: dict = {}
    for stack, (cost, rank, letters, edits) in _with_insertions(_frontiers[frontier]).items():
        ways = [(stack, cost + DELETE, "D", "D")]
        if not forced:
            ways += [(to, cost + extra, "K", "K") for to in shifted(stack, initial)]
            ways += [(to, cost + REROLE + extra, "R", role.upper()) for role in ROLES for to in shifted(stack, role)]
        for to, total, letter, edit in ways:
            new = (total, rank, letters + letter, edits + edit)
            if to not in best or new[:3] < best[to][:3]:
                best[to] = new
    least = min(x[0] for x in best.values())
    kept = sorted(((x[1:3], to, x) for to, x in best.items() if x[0] <= least + SLACK), key=lambda y: y[0])
    return numbered(tuple((to, x[0] - least) for _, to, x in kept)), least, tuple((x[1], x[3]) for _, _, x in kept)


@cache
def finish(frontier: int) -> tuple[int, int, str]:
    """(cost, place in the frontier, insertions) of the cheapest end."""
    return min((cost, rank, edits) for stack, (cost, rank, _, edits) in _with_insertions(_frontiers[frontier]).items() if accepted(stack))


def repair(codes: str) -> tuple[int, list[str], str]:
    """(cost, edits of each row, insertions at the end) of the cheapest repair, with the ASCII-least audit.

    ``codes`` has a letter per row: s, u, a by the role's initial, x for others; upper case for truncated rows; 1 to 4, in
    the same order, for rows that must be deleted. Time is linear in the rows; a row holds one reference.
    """
    frontier, total, back = START, 0, []
    for code in codes:
        frontier, least, before = step(frontier, code)
        total += least
        back.append(before)
    cost, at, last = finish(frontier)
    edits = [""] * len(back)
    for i in range(len(back) - 1, -1, -1):
        at, edits[i] = back[i][at]
    return total + cost, edits, last


def lines(edits: list[str], last: str, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows as ``role:text``."""
    out: list[str] = []
    for edit, role, text in zip(edits, roles, texts):
        out += [f"{ROLES[e]}:" for e in edit[:-1]]
        if edit[-1] != "D":
            out.append(f"{role if edit[-1] == 'K' else ROLES[edit[-1].lower()]}:{text}")
    return out + [f"{ROLES[e]}:" for e in last]


# --- Rows -----------------------------------------------------------------------------------------------------------

_SPACES = "\t\n\x0b\x0c\r "


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, gone, after the damage by crc32 of ``conv_id:turn``; rows that it drops are
    marked ``gone``. Nulls are one space, in that key too."""
    names = {c.lower(): c for c in rows.columns}
    conv, turn = (F.col(f"`{names[c]}`").cast("long") for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(f"`{names[c]}`").cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = located(rows, conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_n"))
    n = F.col("_n")
    hurt = F.when(n.isin(0, 1), "").when(n == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(n == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(n == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), "file", "row", F.explode(copies).alias("copy"), (n == 0).alias("gone"))


def described(rows: DataFrame) -> DataFrame:
    """With ``digest`` of the text and ``code``: the letter of the row for ``repair``, without regard to duplicates."""
    text = F.rtrim("text", F.lit(_SPACES))
    initial = F.substring("role", 1, 1)
    letter: Column = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(text == "", F.translate(letter, "suax", "1234")).when(F.substring(text, -1, 1).isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    return rows.withColumns({"digest": F.sha2("text", 256), "code": code})


#: The order of a conversation's rows. Rows of one turn stand by role, then by their texts' digests.
ORDER = (F.asc_nulls_first, "turn"), (F.asc, "role"), (F.asc, "digest")


def _order() -> list[Column]:
    return [f(c) for f, c in ORDER]


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FORCED = str.maketrans("suaxSUAX", "12341234")
_CLASS = str.maketrans("SUAX1234", "suaxsuax")


def counts(codes: str, duplicates: int) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated and illegal of a conversation's codes, in which duplicates are to be deleted already."""
    classes = codes.translate(_CLASS)
    pairs = max(len(classes) - 1, 0) - sum(classes.count(p) for p in ("su", "ua", "au"))
    return sum(map(codes.count, "1234")) - duplicates, duplicates, sum(map(codes.count, "SUAX")), pairs


def span(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return min(max(known) - min(known) + 1 - len(known), (1 << 63) - 1) if known else 0


def _usual(rows: DataFrame) -> DataFrame:
    """The results of conversations that fit into a task: one shuffle by conversation, rows in order, one at a time."""

    def result(conv: int | None, turns: list, roles: list, texts: list, digests: list, codes: list) -> tuple:
        seen: set = set()
        duplicates = 0
        for i, key in enumerate(zip(roles, digests)):
            if not codes[i].isdigit():
                if key in seen:
                    codes[i] = codes[i].translate(_FORCED)
                    duplicates += 1
                seen.add(key)
        joined = "".join(codes)
        cost, edits, last = repair(joined)
        audit = "".join(map(audit_of, edits)) + audit_of(last)
        digest = hashlib.sha256("\n".join(lines(edits, last, roles, texts)).encode("utf-8", "surrogatepass")).hexdigest()
        return (conv, span(turns), *counts(joined, duplicates), cost, audit, digest)

    names = ["conv_id", "turn", "role", "text", "digest", "code", "gone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in _columns()])
        now, gathered = (False, None), [[] for _ in range(5)]
        for batch in batches:
            done = []
            conv, turn, role, text, digest, code, gone = (c.to_pylist() for c in batch.columns)
            for i in range(batch.num_rows):
                if now != (True, conv[i]):
                    if now[0]:
                        done.append(result(now[1], *gathered))
                    now, gathered = (True, conv[i]), [[] for _ in range(5)]
                if not gone[i]:
                    for to, x in zip(gathered, (turn, role, text, digest, code)):
                        to.append(x[i])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
        if now[0]:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(result(now[1], *gathered), schema)], schema=schema)

    dealt = rows.select(*names).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *_order())
    return dealt.mapInArrow(run, RESULT)


def _columns() -> list[str]:
    return [c.split()[0] for c in RESULT.split(", ")]


def segments(rows: DataFrame, most_rows: int = LARGE_ROWS, most_bytes: int = LARGE_BYTES) -> DataFrame:
    """Rows in order, in lists: part, seg, conv_id, roles, texts, digests, codes; (part, seg) follow the order of rows.

    Rows are dealt by ranges of (conversation, turn, role, digest, locator), so neither a conversation nor repeated rows go to one task.
    """
    schema = "part int, seg int, conv_id long, roles array<string>, texts array<string>, digests array<string>, codes string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        arrow = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        seg, now, held, size = 0, (False, None), [[] for _ in range(4)], 0

        def flush():
            roles, texts, digests, codes = held
            values = (part, seg, now[1], roles, texts, digests, "".join(codes))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, arrow)], names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            conv, role, text, digest, code = (c.to_pylist() for c in batch.columns)
            for i in range(batch.num_rows):
                if now != (True, conv[i]) or len(held[0]) >= most_rows or size >= most_bytes:
                    if held[0]:
                        yield flush()
                        seg += 1
                    now, held, size = (True, conv[i]), [[] for _ in range(4)], 0
                for to, x in zip(held, (role, text, digest, code)):
                    to.append(x[i])
                size += len(text[i])
        if held[0]:
            yield flush()

    order = [F.asc_nulls_first("conv_id"), *_order(), F.asc("file"), F.asc("row"), F.asc("copy")]
    dealt = rows.where("NOT gone").repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.select("conv_id", "role", "text", "digest", "code").mapInArrow(run, schema), "conv-segments")


def _large(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """The results of conversations that are dealt over tasks in segments.

    Duplicates are found by grouping rows on role and digest, with partial minima. One task then reads the codes of a
    conversation, a byte per row, as its audit, which is one value of the result, has a letter per row. Segments are
    repaired apart; only the digest of a repaired conversation, which is one hash over its bytes in order, streams through
    one task, a segment at a time.
    """
    parts = segments(rows, most_rows, most_bytes)
    each = parts.select("part", "seg", "conv_id", F.posexplode(F.arrays_zip("roles", "digests")).alias("at", "key"), "codes")
    each = each.where(~F.substring("codes", F.col("at") + 1, F.lit(1)).isin("1", "2", "3", "4"))
    place = F.struct("part", "seg", "at")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv")
    each = each.select("part", "seg", "at", conv, F.col("key.roles").alias("role"), F.col("key.digests").alias("digest"))
    repeated = each.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = each.join(repeated, ["conv", "role", "digest"]).where(place != F.col("first")).groupBy("part", "seg").agg(F.collect_list("at").alias("again"))
    pieces = parts.select("part", "seg", "conv_id", "codes").join(again, ["part", "seg"], "left")
    gathered = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seg", "codes", "again"))).alias("pieces"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                codes, duplicates = [], 0
                for p in pieces:
                    text = list(p["codes"])
                    for i in p["again"] or []:
                        text[i] = text[i].translate(_FORCED)
                    duplicates += len(p["again"] or [])
                    codes.append("".join(text))
                joined = "".join(codes)
                cost, edits, last = repair(joined)
                plans, start = [], 0
                for p, text in zip(pieces, codes):
                    plans.append({"part": p["part"], "seg": p["seg"], "edits": edits[start : start + len(text)], "last": ""})
                    start += len(text)
                plans[-1]["last"] = last
                out.append((conv, *counts(joined, duplicates), cost, "".join(map(audit_of, edits)) + audit_of(last), plans))
            types = [pa.int64()] * 6 + [pa.string(), plan_type]
            names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "plans"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    plan_type = pa.list_(pa.struct([("part", pa.int32()), ("seg", pa.int32()), ("edits", pa.list_(pa.string())), ("last", pa.string())]))
    planned = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, plans array<struct<part:int,seg:int,edits:array<string>,last:string>>"
    plans = written(gathered.mapInArrow(plan, planned), "conv-plans")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                conv, part, seg, edits, last, roles, texts = (c[i].as_py() for c in batch.columns)
                made = lines(edits, last, roles, texts)
                if made:
                    arrays = [pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array(["\n".join(made)])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "part", "seg", "mended"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = (False, None), hashlib.sha256()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now[1]], pa.int64()), pa.array([h.hexdigest()])], names=["conv_id", "repaired_sha256"])
        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if now != (True, conv):
                    if now[0]:
                        yield row()
                    now, h = (True, conv), hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(text.as_buffer())
        if now[0]:
            yield row()

    own = plans.select(F.explode("plans").alias("p")).select("p.*").join(parts.select("part", "seg", "conv_id", "roles", "texts"), ["part", "seg"])
    mended = own.select("conv_id", "part", "seg", "edits", "last", "roles", "texts").mapInArrow(mend, "conv_id long, part int, seg int, mended string")
    mended = mended.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "seg")
    digests = mended.select("conv_id", "mended").mapInArrow(digest, "conv_id long, repaired_sha256 string")
    known = F.col("turn").isNotNull() & ~F.col("gone")
    turn = F.when(known, F.col("turn"))
    spans = rows.groupBy("conv_id").agg((F.max(turn).cast("decimal(38,0)") - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps"))
    gaps = F.when(F.col("gaps").isNull(), 0).otherwise(F.least("gaps", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long"))
    same = lambda other: F.col("c.conv_id").eqNullSafe(F.col(f"{other}.conv_id"))
    full = spans.alias("c").join(plans.alias("p"), same("p"), "left").join(digests.alias("d"), same("d"), "left")
    zeros = [F.coalesce(F.col(f"p.{c}"), F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return full.select("c.conv_id", gaps.alias("gaps"), *zeros, F.coalesce("p.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", empty).alias("repaired_sha256"))


def repaired(conversations: DataFrame, large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of
    ``conversations`` (conv_id, turn, role, text; others are not read), after the damage.

    A null conv_id is a conversation of its own. Null roles and texts are one space; roles are told apart by their first
    character, and one that is not s, u or a must be given another role or deleted. Rows of one turn stand by role, then
    by digest of the text; null turns come first. Conversations without a row after the damage have zeros, an empty
    audit and the digest of nothing. An empty table gives no rows. Gaps beyond a long are the largest long.

    Conversations larger than the bounds, be it a third of all rows, are dealt over tasks; the results are the same.
    """
    source = from_files(conversations)
    rows = damaged(source)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = written(sizes.where((F.col("n") > large_rows) | (F.col("bytes") > large_bytes)).select(F.col("conv_id").alias("large_id"), F.lit(True).alias("large")), "conv-large")
    rows = described(rows)
    if not large.limit(1).count():
        return _usual(rows)
    dealt = rows.join(large, rows["conv_id"].eqNullSafe(large["large_id"]), "left")
    return _usual(dealt.where("large IS NULL")).unionByName(_large(dealt.where("large").drop("large", "large_id"), large_rows, large_bytes))
