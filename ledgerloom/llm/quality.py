"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over the counts of vote patterns
estimates how often each labeller votes how on good and on bad texts, without any label; the posterior of a text's
pattern is its weak label. Weak labels of a bounded sample train a linear scorer on hashed shapes of the text, which
then scores every text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.common import apart, ids_and_texts, map_texts, mix, written

#: Texts that the scorer is trained on at most, in the order of a hash of doc_id, and (bucket, share) pairs that come to
#: the driver with them: texts beyond that are left out of the sample, so its bytes are bounded however long texts are.
MAX_TRAIN_ROWS, MAX_TRAIN_PAIRS = 16_000, 6_000_000
BUCKETS = 1 << 14

#: The labellers: (name, bad from this value on, good up to this one), each of a measure of the text. Between: no vote.
LABELLERS = (
    ("symbols", 0.04, 0.02),  # share of bytes that are none of letters, digits, white space and common punctuation
    ("symbol_words", 0.30, 0.10),  # share of words with such a byte
    ("capitals", 0.35, 0.15),  # share of capitals among ASCII letters
    ("shouting", 0.15, 0.02),  # share of words with a doubled ! or ?
    ("echoes", 0.25, 0.05),  # share of words equal to the word before
    ("stutter", 0.15, 0.02),  # share of words equal to both words before
    ("poverty", 0.75, 0.60),  # share of words that stood in the text before
    ("bare_symbols", 0.15, 0.03),  # share of words that are symbols only
)

# Classes of bytes: 0 white space, 1 small letter or non-ASCII, 2 capital, 3 digit, 4 common punctuation, 5 other.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-/"]] = 4


class Parts(NamedTuple):
    """Bytes and words of several texts."""

    data: np.ndarray
    kind: np.ndarray
    byte_text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    n: int


def parts_of(texts: list[str | None]) -> Parts:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    kind = _CLASS[data]
    edge = np.flatnonzero((kind[1:] != 0) != (kind[:-1] != 0)) + 1
    lengths = np.array([len(r) + 1 for r in raw])
    byte_text = np.concatenate([[0], np.repeat(np.arange(len(raw)), lengths)])
    return Parts(data, kind, byte_text, edge[0::2], edge[1::2], byte_text[edge[0::2]], len(raw))


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from ledgerloom.llm.common import _power_table

    up, down = _power_table(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _first_of_text(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of one word of each kind in each text; two kinds of one text are taken for one with odds of 2 ** -64."""
    with np.errstate(over="ignore"):
        return np.unique(mix(hashes + mix(text.astype(np.uint64) + np.uint64(1))), return_index=True)[1]


def measures(p: Parts, hashes: np.ndarray) -> np.ndarray:
    """n x labellers; NaN where a text has too little to judge."""
    n = p.n
    per_text = lambda key, x=None: np.bincount(key, x, minlength=n).astype(float)
    words, inked = per_text(p.text), per_text(p.byte_text, p.kind != 0)
    letters = per_text(p.byte_text, (p.kind == 2) | ((p.kind == 1) & (p.data < 128)))
    symbol = _running(p.kind == 5)
    in_word = symbol[p.ends] - symbol[p.starts]
    doubled = np.concatenate([[False], (p.data[1:] == p.data[:-1]) & ((p.data[1:] == 33) | (p.data[1:] == 63))])
    shouts = _running(doubled)
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (p.text[1:] == p.text[:-1])]) if len(hashes) else np.zeros(0, bool)
    thrice = same & np.concatenate([[False], same[:-1]]) if len(same) else same
    distinct = np.bincount(p.text[_first_of_text(p.text, hashes)], minlength=n)
    few = words < 5
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.stack([
            per_text(p.byte_text, p.kind == 5) / inked,
            per_text(p.text, in_word > 0) / words,
            per_text(p.byte_text, p.kind == 2) / np.where(letters >= 20, letters, np.nan),
            per_text(p.text, shouts[p.ends] - shouts[p.starts] > 0) / words,
            np.where(few, np.nan, per_text(p.text, same) / words),
            np.where(few, np.nan, per_text(p.text, thrice) / words),
            np.where(few, np.nan, 1 - distinct / words),
            np.where(few, np.nan, per_text(p.text, in_word == p.ends - p.starts) / words),
        ], axis=1)
    return np.where(words[:, None] > 0, out, np.nan)


def votes_of(values: np.ndarray) -> np.ndarray:
    """-1 bad, 1 good, 0 no vote."""
    bad, good = np.array([b for _, b, _ in LABELLERS]), np.array([g for _, _, g in LABELLERS])
    with np.errstate(invalid="ignore"):
        return np.where(values >= bad, -1, np.where(values <= good, 1, 0)).astype(np.int8)


def patterns_of(votes: np.ndarray) -> list[str]:
    letters = np.array(list("b-g"))
    return ["".join(row) for row in letters[votes + 1]]


class Accuracies(NamedTuple):
    prior: float  # of good
    good: np.ndarray  # per labeller: probability that its vote on a good text, if it votes, is good
    bad: np.ndarray  # that its vote on a bad text is bad

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good; a labeller that casts no vote says nothing."""
        up = np.log(self.good) - np.log(1 - self.bad)
        down = np.log(1 - self.good) - np.log(self.bad)
        odds = np.log(self.prior / (1 - self.prior)) + np.where(votes > 0, up, np.where(votes < 0, down, 0.0)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Accuracies:
    """From distinct vote patterns and their counts. It starts from labellers whose bad votes are rare but right."""
    m = votes.shape[1]
    model = Accuracies(0.8, np.full(m, 0.98), np.full(m, 0.4))
    last = None
    for _ in range(rounds):
        p = model.posterior(votes)
        good, bad = counts * p, counts * (1 - p)
        cast = votes != 0
        # One pseudo-count, spread as at the start, keeps every probability off 0 and 1.
        right = (good @ (votes > 0) + 0.98) / (good @ cast + 1)
        caught = (bad @ (votes < 0) + 0.4) / (bad @ cast + 1)
        model = Accuracies(float(np.clip((good.sum() + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4)), right, caught)
        if last is not None and np.abs(p - last).max() < 1e-6:
            break
        last = p
    return model


def features(p: Parts, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) rows: shares of hashed word shapes and of pairs of neighbouring shapes in each text.

    A shape is a word with each run of letters or digits of a class as one sign; a word like the one before it has a
    shape of its own.
    """
    shown = np.where(p.kind == 1, np.uint8(97), np.where(p.kind == 2, np.uint8(65), np.where(p.kind == 3, np.uint8(48), p.data)))
    keep = (p.kind != 0) & ~np.concatenate([[False], (shown[1:] == shown[:-1]) & (p.kind[1:] <= 3)])
    at = _running(keep)
    shape = _word_hashes(shown[keep], at[p.starts], at[p.ends])
    if not len(shape):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (p.text[1:] == p.text[:-1])])
    with np.errstate(over="ignore"):
        shape = np.where(again, mix(np.uint64(99) + np.zeros(len(shape), np.uint64)), shape)
        pair = mix(shape[1:] * np.uint64(31) + shape[:-1])[p.text[1:] == p.text[:-1]]
    key = np.concatenate([p.text, p.text[1:][p.text[1:] == p.text[:-1]]]) * BUCKETS + (np.concatenate([shape, pair]) % np.uint64(BUCKETS)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    text = key // BUCKETS
    words = np.bincount(p.text, minlength=p.n)
    return text, key % BUCKETS, np.sqrt(n / words[text])


class Scorer(NamedTuple):
    bias: float
    weights: np.ndarray

    def score(self, text: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(text, self.weights[bucket] * value, minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, seed: int = 5, epochs: int = 25) -> Scorer:
    """Logistic regression on soft labels by Adagrad over mini-batches."""
    rng = np.random.default_rng(seed)
    bias, w = 0.0, np.zeros(BUCKETS)
    gb, gw = 1e-6, np.full(BUCKETS, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            text = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            bucket, value = (np.concatenate([rows[i][k] for i in batch]) for k in (0, 1))
            error = (Scorer(bias, w).score(text, bucket, value, len(batch)) - soft[batch]) / len(batch)
            g = error.sum()
            gb += g * g
            bias -= 0.2 * g / np.sqrt(gb)
            seen = np.unique(bucket)
            d = np.bincount(bucket, error[text] * value, minlength=BUCKETS)[seen] + 1e-6 * w[seen]
            gw[seen] += d * d
            w[seen] -= 0.2 * d / np.sqrt(gw[seen])
    return Scorer(bias, w)


class Model(NamedTuple):
    accuracies: Accuracies
    scorer: Scorer


def vote_patterns(docs: DataFrame) -> DataFrame:
    """doc_id and pattern (a letter per labeller: b, g or -) of every row."""

    def voted(texts: list[str | None]) -> dict:
        p = parts_of(texts)
        return {"pattern": patterns_of(votes_of(measures(p, _word_hashes(p.data, p.starts, p.ends))))}

    return map_texts(ids_and_texts(docs), voted, "pattern string")


def train(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """Fit accuracies on the patterns of all rows (3 ** labellers counts at most come to the driver) and the scorer on a
    sample of ``max_rows`` rows, whose ids are broadcast. None for a table without any word."""
    patterns = written(vote_patterns(docs), "quality-votes")
    counts = patterns.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("pattern") != "-" * len(LABELLERS)).orderBy("pattern").collect()
    if not counts:
        return None
    votes = np.array([["b-g".index(c) - 1 for c in r.pattern] for r in counts])
    accuracies = expectation_maximisation(votes, np.array([r.n for r in counts], float))
    sample = patterns.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = ids_and_texts(docs).join(F.broadcast(sample), "doc_id")

    def described(texts: list[str | None]) -> dict:
        p = parts_of(texts)
        hashes = _word_hashes(p.data, p.starts, p.ends)
        text, bucket, value = features(p, hashes)
        cuts = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
        return {"weak": accuracies.posterior(votes_of(measures(p, hashes))), "buckets": lists[0], "shares": lists[1]}

    made = map_texts(rows, described, "weak double, buckets array<int>, shares array<float>").where(F.size("buckets") > 0)
    made = written(made, "quality-sample").groupBy("doc_id").agg(F.min(F.struct("buckets", "shares", "weak")).alias("one"))
    made = made.select(F.xxhash64("doc_id").alias("place"), "doc_id", "one.*")
    # Three numbers of max_rows rows at most are in one window; the lists join what it leaves.
    upto = F.sum("size").over(W.Window.orderBy("place", "doc_id"))
    within = made.select("place", "doc_id", F.size("buckets").alias("size")).withColumn("upto", upto).where(F.col("upto") <= MAX_TRAIN_PAIRS).select("doc_id")
    local = made.join(F.broadcast(within), "doc_id").orderBy("place", "doc_id").select("weak", "buckets", "shares").toArrow()
    weak, buckets, shares = (local.column(c).combine_chunks() for c in local.column_names)
    if not local.num_rows:
        return Model(accuracies, Scorer(0.0, np.zeros(BUCKETS)))
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(buckets).to_numpy(zero_copy_only=False))])
    flat = buckets.flatten().to_numpy().astype(np.int64), shares.flatten().to_numpy().astype(float)
    return Model(accuracies, fit([(flat[0][a:b], flat[1][a:b]) for a, b in zip(cuts, cuts[1:])], weak.to_numpy()))


def judge(docs: DataFrame, model: Model | None, text: str = "text", keep: bool = False) -> DataFrame:
    """The columns of ``docs``, without ``text`` unless ``keep``, and pattern, weak (posterior of the votes), score and kept."""

    def judged(texts: list[str | None]) -> dict:
        p = parts_of(texts)
        hashes = _word_hashes(p.data, p.starts, p.ends)
        votes = votes_of(measures(p, hashes))
        score = model.scorer.score(*features(p, hashes), len(texts)) if model else np.zeros(len(texts))
        score = np.where(np.bincount(p.text, minlength=len(texts)) > 0, score, 0.0)
        weak = model.accuracies.posterior(votes) if model else np.full(len(texts), 0.5)
        return {"pattern": patterns_of(votes), "weak": weak, "score": score, "kept": score >= 0.5}

    return map_texts(docs, judged, "pattern string, weak double, score double, kept boolean", text, keep)


def classify(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, pattern, weak, score and kept of every row of ``docs`` (doc_id, text; others are not read).

    Null texts and texts without words score 0 and are not kept. Rows with a null doc_id are judged, but never in the
    training sample; of rows that repeat a doc_id one is; each has a row of its own; an empty table gives no rows.
    """
    return judge(ids_and_texts(docs), train(docs, max_rows))


def good_documents(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rows, back, text = apart(docs)
    return judge(rows, train(docs, max_rows), text, keep=True).where("kept").select(*back)
