"""Near-duplicates by dart-throwing weighted signatures and banding.

A text is a weighted set of its runs of five words; a run that stands n times weighs 1 + ln n. Over the plane of an
element (weight by rank) hashing throws a fixed pattern of darts; a text is hit by the darts below its weight. Each dart
belongs to one coordinate of the signature, which keeps the earliest (lowest rank) dart. Two texts agree on a
coordinate with the probability of their weighted Jaccard similarity. Ranks are walked in doubling stretches, from 0 on
and only until every coordinate has its dart, so a signature costs about as many darts as it has coordinates times
their logarithm, however long the text is.

Texts that agree on a band of coordinates are candidates. They meet in rounds, never all with all: in each round every
bucket that still holds texts of several groups names one leader, and the texts of other groups are compared with it.
The first leader is the text with the most companions over all its buckets, the centre of its group: nearly every link
of a group runs through it. Later leaders are texts that stand outside the bucket's largest group. A round makes at most
as many pairs as there are places in buckets, and a bucket of up to ROUNDS + 1 texts is compared in full. What the rounds
leave in larger buckets, the texts that stand outside their bucket's largest group and have not led, is joined exactly:
of two texts that are similar enough, the rarest runs of each have one in common. So no link between texts of one bucket
is lost, however large and loose it is.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.common import Words, give_back, map_texts, mix, settings, shingles, written
from ledgerloom.llm.exact_dedup import from_files, located, whole

WIDTH = 5
THRESHOLD = 0.8
#: Texts with similarity 0.8 share a band with probability 1 - (1 - 0.8**7)**32 = 0.9994.
BANDS, ROWS = 32, 7
COORDINATES = BANDS * ROWS
#: Leaders that a bucket has at most, before what is left is joined by rare runs.
ROUNDS = 4
#: Pairs that a task holds at a time, each with the runs of two whole texts.
PAIRS_PER_BATCH = 256
#: The first stretch of ranks is [0, 2**-6); each later one is as long as all before it.
FIRST_STRETCH = -6
#: Bits that a dart's place in its stretch has; the others of 64 are for the slot, up to half a million texts at a time.
PLACE_BITS = 36

_U = np.uint64


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def _poisson_table(mean: float) -> np.ndarray:
    """Distribution function of the number of darts in an area of ``mean``."""
    p, total, out, k = np.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-15 and k < 1000:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return np.array(out)


def darts(element: np.ndarray, weight: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of one stretch of ranks that hit the elements: (index of the element, coordinate's hash, place in the stretch from 0 to 1).

    The weight axis is cut into [0, 1), [1, 2), [2, 4), ...; each cell's number of darts is Poisson and, as their
    places, a function of the element, cell and stretch alone, so equal elements get equal darts in every text.
    """
    length = 2.0**stretch if stretch == FIRST_STRETCH else 2.0 ** (stretch - 1)
    out = []
    cell = 0
    index = np.arange(len(element))
    while len(index):
        left, width = (0.0, 1.0) if cell == 0 else (2.0 ** (cell - 1), 2.0 ** (cell - 1))
        h = mix(element[index] + _U(((stretch + 64) * 0x9E3779B97F4A7C15 + cell * 0xC2B2AE3D27D4EB4F) % (1 << 64)))
        mean = width * length
        # A large area is cut into equal parts along the ranks, to keep the numbers of darts small.
        parts = max(1, int(np.ceil(mean / 8)))
        table = _poisson_table(mean / parts)
        for part in range(parts):
            own = h if parts == 1 else mix(h + _U(part))
            n = np.searchsorted(table, _uniform(own), side="right")
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            n = n[hit]
            who = np.repeat(index[hit], n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seed = mix(np.repeat(own[hit], n) ^ (nth.astype(np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03))
            below = left + _uniform(seed) * width < weight[who]
            who, seed = who[below], seed[below]
            out.append((who, mix(seed + _U(2)), (part + _uniform(mix(seed + _U(1)))) / parts))
        cell += 1
        index = index[weight[index] > 2.0 ** (cell - 1)]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int = COORDINATES) -> np.ndarray:
    """n x size matrix of the earliest darts' hashes; texts are given as (text, element, weight) rows in order of text.

    Rows of texts without elements are 0 throughout.
    """
    value = np.zeros(n * size, np.uint64)
    taken = np.zeros(n * size, bool)
    missing = np.where(np.bincount(text, minlength=n) > 0, size, 0)
    stretch = FIRST_STRETCH
    active = missing[text] > 0
    while active.any():
        t, e, w = text[active], element[active], weight[active]
        who, coordinate, place = darts(e, w, stretch)
        slot = t[who].astype(np.uint64) * _U(size) + coordinate % _U(size)
        # One sort of packed numbers; the place in its stretch also tells a dart from all others of the coordinate.
        packed = np.sort((slot << _U(PLACE_BITS)) | np.minimum(place * 2.0**PLACE_BITS, 2.0**PLACE_BITS - 1).astype(np.uint64))
        slot = (packed >> _U(PLACE_BITS)).astype(np.int64)
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        slot, packed = slot[first], packed[first]
        # Later stretches have higher ranks: only coordinates without a dart take one.
        free = ~taken[slot]
        slot, packed = slot[free], packed[free]
        taken[slot] = True
        value[slot] = mix((packed & _U((1 << PLACE_BITS) - 1)) * _U(64) + _U(stretch - FIRST_STRETCH) + _U(1))
        missing -= np.bincount(slot // size, minlength=n)
        active = missing[text] > 0
        stretch += 1
    return value.reshape(n, size)


def counted(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, count) of the distinct word runs of each text, ordered by text and element."""
    text, h = shingles(Words(texts), width)
    if not len(h):
        return text, h, np.zeros(0, np.uint32)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))
    return text[first], h[first], np.diff(np.concatenate([first, [len(h)]])).astype(np.uint32)


def weight_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count.astype(float))


def sketch(texts: list[str | None]) -> dict:
    """fp (digest of the runs and their counts, null without words), total (weight of all) and one key per band."""
    text, element, count = counted(texts)
    n = len(texts)
    weight = weight_of(count)
    value = signatures(text, element, weight, n)
    cuts = np.searchsorted(text, np.arange(n + 1))
    fps = [hashlib.sha256(element[a:b].tobytes() + count[a:b].tobytes()).hexdigest()[:32] if b > a else None for a, b in zip(cuts, cuts[1:])]
    keys = np.zeros((n, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            keys = mix(keys * _U(0x100000001B3) + value[:, j * BANDS : (j + 1) * BANDS])
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    return {"fp": fps, "total": np.bincount(text, weight, minlength=n), "bands": _lists(keys)}


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix of 64-bit numbers."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).view(np.int64).reshape(-1)))


def runs_of(texts: list[str | None]) -> dict:
    """runs (64-bit hashes in order) and times (32-bit counts) of each text, as bytes."""
    text, element, count = counted(texts)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    parts = list(zip(cuts, cuts[1:]))
    return {"runs": [element[a:b].tobytes() for a, b in parts], "times": [count[a:b].tobytes() for a, b in parts]}


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (elements in order, weights): the sum of minima by the sum of maxima."""
    (ea, wa), (eb, wb) = a, b
    if not len(ea) or not len(eb):
        return 0.0
    at = np.minimum(np.searchsorted(eb, ea), len(eb) - 1)
    same = eb[at] == ea
    common = np.minimum(wa[same], wb[at[same]]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity ``sim``; sets has (id, runs, times) of both sides. A task holds one Arrow batch."""
    side = lambda k: sets.select(F.col("id").alias(k), F.col("runs").alias(f"{k}_runs"), F.col("times").alias(f"{k}_times"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(2, 6)]
            sims = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                ra, ta, rb, tb = (c[i].as_buffer() for c in columns)
                a, b = ((np.frombuffer(r, np.uint64), weight_of(np.frombuffer(t, np.uint32))) for r, t in ((ra, ta), (rb, tb)))
                sims[i] = similarity(a, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["a", "b", "sim"])
        give_back()

    return both.select("a", "b", "a_runs", "a_times", "b_runs", "b_times").mapInArrow(run, "a long, b long, sim double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of ``edges`` (a, b), for nodes with an edge.

    Rounds of contraction: every node points to its smallest neighbour or itself, pointers are followed to their ends,
    and edges between the ends make the next, smaller graph. Each round leaves half of the joined nodes at most.
    """
    edges = written(edges.select("a", "b").where("a != b"), "cc-edges")
    maps = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")), "cc-roots")
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        parent = written(parent, "cc-parent")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = parent.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            jumped = written(jumped, "cc-jump")
            parent = jumped.select("node", "root")
            if not jumped.where("moved").limit(1).count():
                break
        step = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
        maps = written(maps.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-roots")
        ends = edges.join(parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(parent.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = written(ends.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
    return maps


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, file, row, fp, total and bands of every row, as a written table."""
    texts = located(docs, docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return written(map_texts(texts, sketch, "fp string, total double, bands array<long>"), "near-sketch")


def representatives(rows: DataFrame) -> DataFrame:
    """One row per set of runs: id (valid in the written table), fp, total, bands and at, where a text with them stands."""
    one = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.first("total").alias("total"), F.first("bands").alias("bands"), F.min(F.struct("file", "row")).alias("at"))
    return written(one.withColumn("id", F.monotonically_increasing_id()), "near-reps")


def buckets(reps: DataFrame) -> DataFrame:
    """band, id, total and central of the texts of buckets that hold several.

    central orders texts for the first leader: most companions over all buckets first, to a thousandth of a doubling; then by a hash.
    """
    members = reps.select("id", "total", F.xxhash64("fp").alias("tie"), F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    found = written(members.join(shared, "band"), "near-members")
    companions = found.groupBy("id").agg(F.sum("n").alias("companions"))
    central = F.shiftleft(F.floor(F.log2("companions") * 1000).cast("long"), 46) + F.shiftrightunsigned("tie", 18)
    return written(found.join(companions, "id").select("band", "id", "total", central.alias("central")), "near-buckets")


def pairs_with(leaders: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the leaders and the members of their buckets; sizes alone rule out a link if one text has less than
    ``threshold`` of the other's weight. Both have band, id, total and root; equal roots are linked already."""
    lead = leaders.select("band", F.col("id").alias("lead"), F.col("total").alias("lead_total"), F.col("root").alias("lead_root"))
    both = members.join(lead, "band").where("root != lead_root")
    both = both.where(F.least("total", "lead_total") >= (threshold - 1e-9) * F.greatest("total", "lead_total"))
    return both.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def standing(places: DataFrame, roots: DataFrame) -> DataFrame:
    """The places of buckets with the group (root) of each text, which is its own without a link."""
    return places.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def still_open(here: DataFrame) -> DataFrame:
    """The places of buckets of several groups, and the largest group (main) of each."""
    groups = here.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("groups"))
    return written(here.join(groups.where("groups > 1").select("band", "main"), "band"), "near-open")


def elements(sets: DataFrame) -> DataFrame:
    """id, element and weight: a row for every run of the texts."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                weight = weight_of(np.frombuffer(batch.column(2)[i].as_buffer(), np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), batch.column(0)[i].as_py())), pa.array(found), pa.array(weight)], names=["id", "element", "weight"])
        give_back()

    return sets.select("id", "runs", "times").mapInArrow(run, "id long, element long, weight double")


def rare_pairs(texts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of ``texts`` (id, root, total, free) of different groups, one of them free, that can be similar enough: an
    exact join, that loses no link.

    Runs stand in one order for all texts, those of the fewest texts first. From the first run that two similar texts
    share, the rest of either text weighs at least what they have in common, which is threshold / (1 + threshold) of
    both weights. Only runs with such a rest are joined; texts that share no more than common runs never meet.
    """
    own = written(elements(sets.join(texts.select("id"), "id", "left_semi")).join(texts, "id"), "near-elements")
    known = own.groupBy("element").agg(F.count("*").alias("n"))
    before = W.Window.partitionBy("id").orderBy("n", "element").rowsBetween(W.Window.unboundedPreceding, -1)
    left = own.join(known, "element").withColumn("rest", F.col("total") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    left = written(left.where((F.col("n") > 1) & (F.col("rest") >= (threshold - 1e-9) * F.col("total"))).select("element", "id", "root", "total", "free", "rest"), "near-rare")
    lead = left.where("free").select("element", *[F.col(c).alias(f"lead_{c}") for c in ("id", "root", "total", "rest")])
    common = (threshold / (1 + threshold) - 1e-9) * (F.col("total") + F.col("lead_total"))
    met = left.join(lead, (left["element"] == lead["element"]) & (F.col("root") != F.col("lead_root")) & (F.least("rest", "lead_rest") >= common))
    return met.select(F.least("id", "lead_id").alias("a"), F.greatest("id", "lead_id").alias("b")).distinct()


def links(docs: DataFrame, reps: DataFrame, threshold: float = THRESHOLD, rounds: int | None = ROUNDS) -> DataFrame:
    """(node, root) of every representative that a link joins to another: the groups of texts.

    A round without pairs is no end: its leaders were ruled out by size or tested before, and others come after them. The
    end is a round without leaders, when no bucket is open, or the last of ``rounds``; what is then left is joined by rare runs.
    """
    spark = docs.sparkSession
    places = buckets(reps)
    wanted = places.select("id").distinct().join(reps.select("id", "at.file", "at.row"), "id")
    texts = located(docs, docs["text"].cast("string").alias("text")).join(wanted, ["file", "row"]).select("id", "text")
    sets = written(map_texts(texts, runs_of, "runs binary, times binary"), "near-runs")
    roots = spark.createDataFrame([], "node long, root long")
    led = tested = found = None

    def linked(pairs: DataFrame) -> None:
        """Compare ``pairs`` that were not compared before; ``roots`` are then those of all links."""
        nonlocal tested, found, roots
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        if not pairs.limit(1).count():
            return
        with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": PAIRS_PER_BATCH}):
            new = written(compared(pairs, sets).where(F.col("sim") >= threshold).select("a", "b"), "near-links")
        tested = pairs if tested is None else tested.union(pairs)
        if new.limit(1).count():
            found = new if found is None else found.union(new)
            roots = components(found)

    for nth in count() if rounds is None else range(rounds):
        here = standing(places, roots)
        if nth:
            here = still_open(here)
            free = here.where("root != main").join(led, ["band", "id"], "left_anti")
            turn = F.xxhash64("central", F.lit(nth))
        else:
            free, turn = here, F.col("central")
        leaders = free.groupBy("band").agg(*[F.max_by(c, turn).alias(c) for c in ("id", "total", "root")])
        leaders = written(leaders, "near-leaders")
        if not leaders.limit(1).count():
            break
        led = leaders.select("band", "id") if led is None else led.union(leaders.select("band", "id"))
        linked(pairs_with(leaders, here, threshold))
    else:
        here = still_open(standing(places, roots))
        waits = here.where("root != main") if led is None else here.where("root != main").join(led, ["band", "id"], "left_anti")
        free = written(waits.select("id").distinct(), "near-free")
        if free.limit(1).count():
            # Only buckets with a text that waits have anything left.
            bands = here.join(free, "id", "left_semi").select("band").distinct()
            texts = here.join(bands, "band", "left_semi").select("id", "root", "total").distinct().join(free.withColumn("free", F.lit(True)), "id", "left")
            linked(rare_pairs(written(texts.withColumn("free", F.coalesce("free", F.lit(False))), "near-left"), sets, threshold))
    return roots


def classes(docs: DataFrame, threshold: float = THRESHOLD, rounds: int | None = ROUNDS) -> DataFrame:
    """doc_id, file, row, class (null for a text without words, which is alone) of every row of ``docs``."""
    docs = from_files(docs)
    rows = sketched(docs)
    reps = representatives(rows)
    roots = links(docs, reps, threshold, rounds)
    named = reps.select("fp", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("fp", F.coalesce("root", "id").alias("class"))
    return written(rows.select("doc_id", "file", "row", "fp").join(named, "fp", "left").drop("fp"), "near-classes")


def _kept(rows: DataFrame) -> DataFrame:
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    return written(rows.where("class IS NOT NULL").groupBy("class").agg(F.min(rank).alias("keep"), F.count("*").alias("class_size")), "near-kept")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, rounds: int | None = ROUNDS) -> DataFrame:
    """doc_id, class_id, class_size and kept of every row of ``docs`` (doc_id, text; others are not read).

    class_id is the smallest doc_id among texts that links of similarity ``threshold`` or more connect; one row of each
    class, the first with that doc_id, has kept = true. Copies with the same runs are one node, so groups of any size
    cost one row each. Null and empty texts, and texts without words, are alone: their class_id is their own doc_id.
    A null doc_id ranks last. An empty table gives no rows. No link between texts of one bucket is lost, whatever
    ``rounds`` is: it only says how many leaders a bucket has before the rest is joined by rare runs (None: no bound).
    """
    rows = classes(docs, threshold, rounds)
    out = rows.join(_kept(rows), "class", "left")
    first = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    return out.select(
        "doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce(first, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row of each class that stays, and every text without words, with all columns of ``docs``."""
    docs = from_files(docs)
    rows = classes(docs, threshold)
    kept = _kept(rows).select(F.col("keep.file").alias("file"), F.col("keep.row").alias("row"))
    kept = kept.union(rows.where("class IS NULL").select("file", "row"))
    return located(docs, whole(docs)).join(kept, ["file", "row"], "left_semi").select("doc.*")
