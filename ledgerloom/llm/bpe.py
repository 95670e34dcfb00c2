"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The corpus is counted once by a grouped aggregation; its most frequent words are compiled, with their token ids as
outputs, into a shared-suffix automaton whose flat arrays every executor memory-maps. A word that the automaton lacks
is merged exactly by the ranks of the vocabulary, so the size of the automaton never changes a result. Words go through
both by the thousand, as columns of a matrix of bytes, each distinct run of a step once.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
import string
import tempfile
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import give_back, ids_and_texts, map_texts, written

#: Words in the automaton at most; the rest is merged by rank, with the same ids.
LEXICON_WORDS = 100_000
#: A word that stands less often is not worth a place in the automaton.
LEAST_COUNT = 4
#: Distinct runs that a task counts before it hands them on.
COUNTED_CHUNKS = 500_000
#: A task keeps the chunks it met last, so many to twice as many, and none of more than so many characters.
CACHE_CHUNKS, CACHED_CHARS = 250_000, 64
#: Words that are looked up or merged together, and the bytes of one at most; a longer word is merged by itself.
BLOCK_WORDS, BLOCK_BYTES = 4096, 64

# White space as the vocabulary's normaliser has it (Unicode White_Space; str.split() also splits at \x1c-\x1f).
_CHUNK = re.compile("[^\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Marks that are one word where they end a run; an apostrophe may begin another.
_MARKS = "".join(c for c in string.punctuation if c != "'")
#: The rank of a pair that does not merge.
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, read from a file of the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.ranks = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Bytes that print stand for themselves, the others for the code points from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: chr(256 + i) for i, b in enumerate(rest)}

        #: code point of the letter of each byte, and its id inside a word and at its end
        spelled = [self.letters.get(b, chr(b)) for b in range(256)]
        self.codes = np.array([ord(x) for x in spelled], np.int64)
        self.inside = np.array([self.ids[x] for x in spelled], np.int64)
        self.last = np.array([self.ids[x + self.end] for x in spelled], np.int64)
        #: pairs of ids that merge in sorted order, with their ranks, then one that no pair reaches; by rank the id that comes of it
        keys = np.array([self.ids[a] << 32 | self.ids[b] for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pairs = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(list(self.ranks.values()), np.int64)[order], _NONE)
        self.merged = np.zeros(len(spec["model"]["merges"]), np.int64)
        self.merged[list(self.ranks.values())] = [self.ids[a + b] for a, b in self.ranks]
        #: ranks of pairs of bytes, the second one inside a word or at its end
        self.first_ranks = np.stack([self.rank(self.inside[:, None], x[None, :]) for x in (self.inside, self.last)])

    def spelled(self, word: str) -> str:
        if word.isascii() and word.isalnum():
            return word
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; -1 is no id and merges with none."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], _NONE)

    def merge_columns(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has. ``data``: their bytes, a word in each column.

        The pair of lowest rank of every word merges at once, the leftmost of equals, until none has a pair. Parts are
        linked by their places in the flat matrix; one more row, of no ids, stands before and after all words.
        """
        (rows, m), row = data.shape, np.arange(len(data))[:, None]
        columns, shift = np.arange(m), max(rows - 1, 1).bit_length()
        ids = np.full((rows + 1, m), -1)
        ids[:rows] = np.where(row < lengths, self.inside[data], -1)
        ids[lengths - 1, columns] = self.last[data[lengths - 1, columns]]
        best = np.full((rows + 1, m), _NONE << shift)  # rank of the pair that begins here, then its row
        ranks = self.first_ranks[(row[:-1] == lengths - 2).astype(np.int8), data[:-1], data[1:]]
        best[: rows - 1] = np.where(row[:-1] < lengths - 1, ranks, _NONE) << shift | row[:-1]
        at = np.arange((rows + 1) * m).reshape(rows + 1, m)
        after, before = at + m, at - m
        after[lengths - 1, columns], before[0] = at[rows], at[rows]
        ids_at, best_at, after, before = ids.ravel(), best.ravel(), after.ravel(), before.ravel()
        while len(on := np.flatnonzero((least := best[:rows].min(axis=0)) < _NONE << shift)):
            rank, i = least[on] >> shift, (least[on] & (1 << shift) - 1) * m + on
            j, made = after[i], self.merged[rank]
            k, h = after[j], before[i]
            ids_at[i], ids_at[j], best_at[j] = made, -1, _NONE << shift
            after[i], before[k] = k, i
            best_at[i] = self.rank(made, ids_at[k]) << shift | i // m
            best_at[h] = self.rank(ids_at[h], made) << shift | h // m
        alive = ids[:rows].T >= 0
        return ids[:rows].T[alive], alive.sum(axis=1)

    def merge(self, word: str) -> list[int]:
        """Ids of one spelled word: the pair of lowest rank merges first, the leftmost of equals."""
        bytes_of = {x: b for b, x in self.letters.items()}
        data = np.array([bytes_of.get(x, ord(x)) for x in word], np.uint8)
        return self.merge_columns(data[:, None], np.array([len(word)]))[0].tolist()

    def merge_long(self, word: str) -> list[int]:
        """As ``merge`` for words of any length, in n log n steps: a heap of pairs over a linked list of parts."""
        parts = [*word[:-1], word[-1] + self.end]
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = left + right, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [self.ids[p] for p, live in zip(parts, alive) if live]


def compile_lexicon(entries: dict[str, list[int]]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of the words, as flat arrays.

    Words are added in sorted order and each finished suffix is replaced by the equal state that is registered already.
    Every state knows how many words end below it, so the path of a word sums to the word's place in sorted order, and
    that place finds its ids: suffixes are shared although outputs differ.
    """
    states: list[dict[str, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, str]] = []

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, letter = path.pop()
            child = states[parent][letter]
            key = (final[child], tuple(sorted(states[child].items())))
            if (known := register.setdefault(key, child)) != child:
                states[parent][letter] = known
                if child == len(states) - 1:
                    states.pop()
                    final.pop()

    words = sorted(entries)
    previous = ""
    for word in words:
        same = len(os.path.commonprefix([previous, word]))
        settle(same)
        at = states[path[-1][0]][path[-1][1]] if path else 0
        for letter in word[same:]:
            states.append({})
            final.append(False)
            states[at][letter] = len(states) - 1
            path.append((at, letter))
            at = len(states) - 1
        final[at] = True
        previous = word
    settle(0)

    below: dict[int, int] = {}
    for state in _children_first(states):
        below[state] = final[state] + sum(below[c] for c in states[state].values())
    first, letters, targets, skipped = [0] * (len(states) + 1), [], [], []
    for state, arcs in enumerate(states):
        first[state] = len(letters)
        passed = int(final[state])
        for letter, child in sorted(arcs.items()):
            letters.append(ord(letter))
            targets.append(child)
            skipped.append(passed)
            passed += below.get(child, 0)
    first[len(states)] = len(letters)
    ids = [entries[w] for w in words]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
    flat = [i for x in ids for i in x]
    return {
        "first": np.array(first, np.int32), "letters": np.array(letters, np.int32), "targets": np.array(targets, np.int32),
        "skipped": np.array(skipped, np.int32), "final": np.array(final, np.int32), "starts": np.array(starts, np.int32), "ids": np.array(flat, np.int32),
    }


def _children_first(states: list[dict[str, int]]):
    seen, stack = set(), [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            yield state
        elif state not in seen:
            seen.add(state)
            stack.append((state, True))
            stack += [(c, False) for c in states[state].values()]


ARRAYS = ("first", "letters", "targets", "skipped", "final", "starts", "ids")


def save_lexicon(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: the lengths of the seven int32 arrays, then the arrays."""
    with open(path, "wb") as f:
        f.write(np.array([len(arrays[a]) for a in ARRAYS], np.int32).tobytes())
        for a in ARRAYS:
            f.write(np.ascontiguousarray(arrays[a], np.int32).tobytes())


class Lexicon:
    """The automaton over a memory-mapped file."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.int32, mode="r")
        at = len(ARRAYS)
        for name, n in zip(ARRAYS, data[: len(ARRAYS)].tolist()):
            setattr(self, name, np.asarray(data[at : at + n]))
            at += n
        #: (state, letter) of each arc in sorted order, then one that no word reaches
        self.arcs = np.append(np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) << 32 | self.letters, np.iinfo(np.int64).max)

    def places(self, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places of words in sorted order, -1 for those that it lacks. ``letters``: their code points, a word in each column."""
        state, place = np.zeros((2, len(lengths)), np.int64)
        on = np.arange(len(lengths))
        for row, codes in enumerate(letters):
            on = on[lengths[on] > row]
            key = state[on] << 32 | codes[on]
            at = np.searchsorted(self.arcs, key)
            known = self.arcs[at] == key
            place[on[~known]], at, on = -1, at[known], on[known]
            place[on] += self.skipped[at]
            state[on] = self.targets[at]
        # a word that fell out of the automaton stands in the state before
        return np.where((place >= 0) & (self.final[state] > 0), place, -1)

    def find(self, word: str) -> list[int] | None:
        codes = np.array([ord(c) for c in word], np.int64)
        place = self.places(codes[:, None], np.array([len(word)]))[0]
        return None if place < 0 else self.ids[self.starts[place] : self.starts[place + 1]].tolist()

    def found(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, one after the other, and how many each has."""
        begin = self.starts[places].astype(np.int64)
        n = self.starts[places + 1] - begin
        return self.ids[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def columns(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which, lengths, bytes): words of up to BLOCK_BYTES bytes as columns, those of like length together."""
    if not words:
        return
    data = np.frombuffer((" ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8)  # no word has a space
    ends = np.flatnonzero(data == 32)
    lengths = np.diff(ends, prepend=-1) - 1
    order = np.argsort(lengths, kind="stable")
    order = order[: np.searchsorted(lengths[order], BLOCK_BYTES, side="right")]
    for a in range(0, len(order), BLOCK_WORDS):
        which = order[a : a + BLOCK_WORDS]
        n = lengths[which]
        row = np.arange(n[-1])[:, None]
        yield which, n, np.where(row < n, data[np.minimum(ends[which] - n + row, ends[which])], 0)


@contextmanager
def uncollected() -> Iterator[None]:
    """Inside, tuples come by the hundred thousand and no cycles: the collector would go through them again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Codec:
    """Encodes and decodes whole texts; ``lexicon`` None merges every word."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.v, self.lexicon = vocabulary, lexicon
        self.names = [str(i) for i in range(max(vocabulary.tokens) + 1)]
        self.forget()

    def forget(self) -> None:
        """Empty the caches, which fill again as texts need them."""
        self.cache, self.older = {}, {}

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # every letter lower by itself
        return text.lower()

    def segments(self, text: str) -> list[str]:
        return self.v.specials.split(text) if self.v.specials and "<|" in text else [text]

    def chunks(self, text: str) -> list[str]:
        text = self.normal(text)
        return _CHUNK.findall(text) if _ODD.search(text) else text.split()

    def split(self, chunk: str) -> list[str]:
        """The words of a run without white space."""
        if chunk.isalpha():
            return [chunk]
        stem = chunk.rstrip(_MARKS)
        if stem.isalpha():
            return [stem, chunk[len(stem) :]]
        return self.v.words.findall(chunk) if stem else [chunk]

    def words(self, words: list[str]) -> tuple[list[tuple[int, str, str]], set[str]]:
        """Of each word the number of ids, the ids in decimal and the decoded tokens; and the words that the automaton lacks."""
        made: list = [None] * len(words)
        rare = []

        def put(which: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
            ids, names, tokens, a = ids.tolist(), self.names, self.v.tokens, 0
            for w, n in zip(which.tolist(), counts.tolist()):
                if n == 1:
                    made[w] = 1, names[ids[a]], tokens[ids[a]]
                else:
                    own = ids[a : a + n]
                    made[w] = n, " ".join([names[i] for i in own]), " ".join([tokens[i] for i in own])
                a += n

        for which, lengths, data in columns(words):
            if self.lexicon:
                places = self.lexicon.places(self.v.codes[data], lengths)
                put(which[places >= 0], *self.lexicon.found(places[places >= 0]))
                which, lengths, data = which[places < 0], lengths[places < 0], data[:, places < 0]
                rare += which.tolist()
            if len(which):
                put(which, *self.v.merge_columns(data, lengths))
        for w, word in enumerate(words):
            if made[w] is None:
                ids = np.array(self.v.merge_long(self.v.spelled(word)))
                put(np.array([w]), ids, np.array([len(ids)]))
                rare.append(w)
        return made, {words[w] for w in rare} if self.lexicon else set()

    def learn(self, chunks: set[str]) -> dict[str, tuple[int, str, str]]:
        """The same of runs without white space that the cache lacks. It keeps those of words of the automaton: others seldom come again."""
        made = {c: p for c in chunks if (p := self.older.get(c))}
        split = {c: self.split(c) for c in chunks if c not in made}
        known = made | {w: p for w in chain.from_iterable(split.values()) if (p := self.cache.get(w) or self.older.get(w))}
        new = list({w for w in chain.from_iterable(split.values()) if w not in known})
        coded, rare = self.words(new)
        known.update(zip(new, coded))
        keep = [*made, *[w for w in new if w not in rare]]
        for c, words in split.items():
            if len(words) == 1:
                made[c] = known[words[0]]
            else:
                parts = [known[w] for w in words]
                made[c] = sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
                if rare.isdisjoint(words):
                    keep.append(c)
        for c in keep:
            if len(c) <= CACHED_CHARS:
                if len(self.cache) >= CACHE_CHUNKS:
                    self.cache, self.older = {}, self.cache
                self.cache[c] = made[c] if c in made else known[c]
        return made

    def parts(self, texts: list[str | None]) -> list[list[tuple[int, str, str]]]:
        """Of each text in order: each special token and each run of which tokens come."""
        marks = {" " + s: (1, str(i), s) for s, i in self.v.special.items()}  # no run has a space
        runs = [[c for s in self.segments(t or "") for c in ([" " + s] if s in self.v.special else self.chunks(s))] for t in texts]
        with uncollected():
            parts = [list(map(self.cache.get, run)) for run in runs]
            made = self.learn({c for run, found in zip(runs, parts) for c, p in zip(run, found) if p is None}.difference(marks)) | marks
            return [[q for p, c in zip(found, run) if (q := p or made[c])[0]] for run, found in zip(runs, parts)]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.parts([text])[0] for i in p[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, special ones too; ids outside the vocabulary are left out."""
        return " ".join(self.v.tokens[i] for i in ids if i in self.v.tokens)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _codec(vocabulary: str, lexicon: str | None) -> Codec:
    return Codec(_vocabulary(vocabulary), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


_shipped: set[tuple[str, str]] = set()


def word_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n): how often each pre-token stands in all texts, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, None)

        def summed(chunks: Counter) -> pa.RecordBatch:
            words: dict[str, int] = defaultdict(int)
            for c, n in chunks.items():
                for w in codec.split(c):
                    words[w] += n
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        chunks: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for segment in codec.segments(text or ""):
                    if segment not in codec.v.special:
                        chunks.update(codec.chunks(segment))
                if len(chunks) > COUNTED_CHUNKS:
                    yield summed(chunks)
                    chunks.clear()
        yield summed(chunks)
        give_back()

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, vocabulary: str, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, ``limit`` at most: those from a frequency on, in steps of an eighth of a doubling.

    Words come here only once their number is known to be within the limit.
    """
    counts = written(word_counts(docs, vocabulary).where((F.length("word") <= 64) & (F.col("n") >= LEAST_COUNT)).withColumn("level", F.floor(F.log2("n") * 8)), "bpe-words")
    cut, total = None, 0
    for r in counts.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # a few hundred levels
        total += r.words
        if total > limit:
            break
        cut = r.level
    return [] if cut is None else [r.word for r in counts.where(F.col("level") >= cut).select("word").collect()]


def ship_lexicon(docs: DataFrame, vocabulary: str, limit: int = LEXICON_WORDS) -> str:
    """Compile the automaton of the frequent words, send its file to every executor and return the file's name."""
    v = _vocabulary(vocabulary)
    words = frequent_words(docs, vocabulary, limit)
    ids = ([int(i) for i in p[1].split()] for p in Codec(v).words(words)[0])
    arrays = compile_lexicon(dict(zip(map(v.spelled, words), ids)))
    context = docs.sparkSession.sparkContext
    name = "lexicon-" + hashlib.sha256(b"".join(arrays[a].tobytes() for a in ARRAYS)).hexdigest()[:24]
    if (context.applicationId, name) not in _shipped:
        path = os.path.join(tempfile.mkdtemp(), name)
        save_lexicon(arrays, path)
        context.addFile(path)
        _shipped.add((context.applicationId, name))
    return name


def encode(docs: DataFrame, vocabulary: str, lexicon: str | None = None) -> DataFrame:
    """Token ids of every document: the columns of ``docs`` and ids array<int>. Null and empty texts have no ids."""
    texts = docs.withColumn("_text", F.col("text").cast("string"))
    ids = lambda x: {"ids": [[int(i) for p in parts for i in p[1].split()] for parts in _codec(vocabulary, lexicon).parts(x)]}
    return map_texts(texts, ids, "ids array<int>", "_text", after=lambda: _codec(vocabulary, lexicon).forget())


def decode(coded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the tokens of the column ``ids`` joined by one space; null ids count as none."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def joined(column):
        codec = _codec(vocabulary, None)
        return column.map(lambda x: codec.decode([] if x is None else list(x)))

    return coded.withColumn("decoded", joined(ids))


def round_trip(docs: DataFrame, vocabulary: str, limit: int = LEXICON_WORDS) -> DataFrame:
    """Digests of encoding and decoding every whole text, one row per row of ``docs`` (doc_id, text; others ignored).

    doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (decoded text in UTF-8). Null and
    empty texts have no tokens; null doc_ids stay null; repeated rows each have their row; an empty table gives none.
    """
    docs = ids_and_texts(docs)
    lexicon = ship_lexicon(docs, vocabulary, limit)

    def digests(texts: list[str | None]) -> dict:
        n, ids, decoded = [], [], []
        for parts in _codec(vocabulary, lexicon).parts(texts):
            counts, numbers, tokens = zip(*parts) if parts else ((), (), ())
            n.append(sum(counts))
            ids.append(hashlib.sha256(" ".join(numbers).encode()).hexdigest())
            decoded.append(hashlib.sha256(" ".join(tokens).encode()).hexdigest())
        return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return map_texts(docs, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", after=lambda: _codec(vocabulary, lexicon).forget())
