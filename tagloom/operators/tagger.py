"""Entity tagger that learns from a term list and finds what is on no list: averaged perceptron and Viterbi.

All sentences of all texts are the examples, with the listed terms that occur in them. A word is described by itself, its
ending, its beginning, its shape, and its neighbours; each description and tag has a weight. Training is shared out: the
examples lie in shards of bounded size, each learns one pass from the common weights, and their means are the next common
weights. A task takes several shards and one step of all of them at once. Only weights reach the driver, and their number is
fixed. For half of the mentions the words themselves are left out in training, so that context and form must carry the decision.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.hashing import uniform
from tagloom.functions.values import as_column
from tagloom.operators.enrich import TRIE_BYTES, TRIE_TERMS, listed_terms
from tagloom.operators.joins import fits
from tagloom.operators.terms import longest
from tagloom.session import stored

#: Weights per tag (a power of two), passes over the examples, shards at least, and sentences of a shard that are learned from at once.
BUCKETS, PASSES, SHARDS, TOGETHER = 1 << 16, 6, 8, 16
#: Characters of text that are worth a shard, weights of shards that one task holds at once, and weights' numbers in a row of sums.
SHARD_CHARS, HELD, SUMMED = 1 << 20, 1 << 22, 1 << 10
#: Where fewer sentences are asked for, the part of them that may be without a mention.
WITHOUT = 0.3
#: Words whose descriptions a task keeps.
KNOWN = 1 << 16
#: Words of a sentence; longer ones are cut.
LONGEST = 60
#: Sentences whose tags are worked out in one step, and texts that are cut into sentences in one.
STEP, TEXTS = 512, 64

# an end of a sentence: a line's end, or marks before a blank (a set in front is searched for faster than two ways)
_WORD, _END = re.compile(r"\w+"), re.compile(r"[.!?\n](?:(?<=\n)|[.!?]*(?=\s))")
_FORMS = 7  # descriptions of a word by itself
_AROUND = ((-2, 0), (-1, 0), (1, 0), (2, 0), (-1, 1), (1, 1), (-1, 5), (1, 5))  # place and description of neighbours
FEATURES = _FORMS + len(_AROUND) + 1


def _cut(text: str) -> list[tuple[list[str], int, int, int]]:
    """The words of each sentence as they are written, the part of the text they stand in, and how many words of it go before."""
    out, at = [], 0
    for end, after in chain((m.span() for m in _END.finditer(text)), [(len(text), 0)]):
        words = _WORD.findall(text, at, end)
        out += [(words[i : i + LONGEST], at, end, i) for i in range(0, len(words), LONGEST)]
        at = after
    return out


def _spans(text: str, at: int, end: int, before: int, n: int) -> list[tuple[int, int]]:
    """Where the ``n`` words of a sentence begin and end in the text."""
    return [m.span() for m in _WORD.finditer(text, at, end)][before : before + n]


def sentences(text: str) -> list[tuple[list[str], list[int], list[int]]]:
    """The words of each sentence as they are written, and where they begin and end in the text."""
    out = []
    for words, *place in _cut(text):
        starts, ends = zip(*_spans(text, *place, len(words)), strict=True)
        out.append((words, list(starts), list(ends)))
    return out


def _code(kind: int, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode())


class _Shapes(dict):
    """What stands for a character in a word's shape."""

    def __missing__(self, key: int) -> str:
        c = chr(key)
        self[key] = kind = "X" if c.isupper() else "9" if c.isdigit() else "x"
        return kind


_SHAPES = _Shapes()


@lru_cache(KNOWN)
def _shape_codes(shape: str) -> tuple[int, ...]:
    short = re.sub(r"(.)\1+", r"\1", shape)
    return _code(4, short), _code(5, str(shape[0] == "X")), _code(6, str("9" in shape))


@lru_cache(KNOWN)
def _forms(word: str) -> tuple[int, ...]:
    """Itself, endings, beginning, shape, its first letter's case, whether it has digits."""
    low = word.lower()
    own = (_code(0, low), _code(1, low[-3:]), _code(2, low[-2:]), _code(3, low[:3]))
    return own + _shape_codes(word.translate(_SHAPES))


def _numbered(found: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the sentences, one after the other, as numbers, the sentences' lengths, and the forms of each different word."""
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(found)], np.int32)
    forms = np.array([_forms(w) for w in numbers], np.uint32).reshape(-1, _FORMS)
    return ids, np.array([len(s) for s in found], np.int32), forms


def _places(lengths: np.ndarray) -> np.ndarray:
    """The place of each word in its sentence."""
    ends = lengths.cumsum()
    return np.arange(lengths.sum()) - np.repeat(ends - lengths, lengths)


def describe(ids: np.ndarray, lengths: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """Weights' numbers of every word of every sentence (word, description), from what ``_numbered`` gives.

    Description 0 is the word itself. Places before and behind a sentence hold no words.
    """
    own, place = np.ascontiguousarray(forms[ids].T).astype(np.uint64), _places(lengths)
    left = np.repeat(lengths, lengths) - place
    out = np.empty((len(ids), FEATURES), np.min_scalar_type(BUCKETS - 1))

    def put(k: int, code: np.ndarray) -> None:
        mixed = (code ^ (code >> np.uint64(17))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = (mixed >> np.uint64(40)) & np.uint64(BUCKETS - 1)

    for k in range(_FORMS):
        put(k, own[k])
    for k, (shift, form) in enumerate(_AROUND):
        moved = np.full(len(ids), _code(9, str(form)), np.uint64)
        there = np.flatnonzero((place + shift >= 0) & (left > shift))
        moved[there] = own[form, there + shift]
        put(_FORMS + k, moved * np.uint64(2 * k + 3) + np.uint64(0x9E3779B97F4A7C15))
    put(FEATURES - 1, np.full(1, _code(8, "bias"), np.uint64))
    return out


def _best_tags(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best tags of every word. ``scores``: word, tag, of sentences one after the other; ``steps``: from tag (the last: the
    start), to tag, and if it has three dimensions, sentence.

    All sentences move on together, the longest first, so a step costs one operation for all that have not ended.
    """
    tags, n, widest = scores.shape[1], len(lengths), int(lengths.max())
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    place, row = _places(lengths), np.repeat(rank, lengths)
    going = n - np.searchsorted(np.sort(lengths), np.arange(widest), side="right")
    placed = np.zeros((widest, n, tags))
    placed[place, row] = scores
    placed = np.ascontiguousarray(placed.transpose(0, 2, 1))
    steps = np.ascontiguousarray(steps[:, :, order]) if steps.ndim == 3 else steps[:, :, None]
    moves = steps[:tags]
    each = np.broadcast_to(moves, (tags, tags, n))
    placed[0] += steps[tags]
    for at in range(1, widest):
        k = going[at]
        placed[at, :, :k] += (placed[at - 1, :, None, :k] + moves[:, :, :k]).max(0)
    out = np.zeros((widest, n), np.int64)
    k = 0
    for at in range(widest - 1, -1, -1):
        # sentences that end here, then the way back of those that go on
        ended, k = k, going[at]
        out[at, ended:k] = placed[at, :, ended:k].argmax(0)
        if ended:
            own = out[at + 1, :ended]
            out[at, :ended] = (placed[at, :, :ended] + each[:, own, np.arange(ended)]).argmax(0)
    return out[place, row]


def viterbi(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best tags of each sentence. ``scores``: sentence, place, tag; ``steps``: from tag (the last: the start), to tag."""
    inside = np.arange(scores.shape[1]) < lengths[:, None]
    out = np.zeros(scores.shape[:2], np.int64)
    out[inside] = _best_tags(scores[inside], lengths, steps)
    return out


def _allowed(labels: int) -> np.ndarray:
    """0 where a tag may follow another, else minus infinity. Tags: 0 outside, 2k + 1 begins label k, 2k + 2 goes on."""
    tags = 2 * labels + 1
    out = np.zeros((tags + 1, tags))
    for k in range(labels):
        inside = 2 * k + 2
        out[:, inside] = -np.inf
        out[[2 * k + 1, inside], inside] = 0.0
    return out


@dataclass(frozen=True)
class Tagger:
    """Weights (bucket, tag) and steps (from tag or start, to tag) for the labels in order."""

    labels: list[str]
    weights: np.ndarray
    steps: np.ndarray

    def tags(self, found: list[list[str]]) -> list[list[int]]:
        """The tags of each sentence's words."""
        out: list[list[int]] = [[] for _ in found]
        # alike lengths together, so that few places are empty
        order = sorted(range(len(found)), key=lambda i: len(found[i]))
        steps = self.steps + _allowed(len(self.labels))
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            ids, lengths, forms = _numbered([found[i] for i in part])
            best = _best_tags(self.weights[describe(ids, lengths, forms)].sum(1), lengths, steps).tolist()
            ends = lengths.cumsum().tolist()
            for i, start, end in zip(part, [0, *ends], ends, strict=False):
                out[i] = best[start:end]
        return out


def spans(tags: list[int]) -> list[tuple[int, int, int]]:
    """(first word, last word, label number) of every mention."""
    out = []
    for i, tag in enumerate(tags):
        if tag % 2 == 1:
            out.append((i, i, tag // 2))
        elif tag and out and out[-1][1] == i - 1 and out[-1][2] == tag // 2 - 1:
            out[-1] = (out[-1][0], i, out[-1][2])
    return out


def _marked(df: DataFrame, sample_id: str, text: str, gazetteer: DataFrame, term: str, label: str) -> tuple[DataFrame, list[str]]:
    """All sentences as (key, words with one blank between, tags), and the labels in order.

    The list's size is checked; longer ones can't be learned from.
    """
    pairs = gazetteer.select(F.lower(as_column(term)).alias("term"), as_column(label).alias("label")).dropna().distinct()
    if not fits(pairs, TRIE_TERMS, TRIE_BYTES):
        raise ValueError(f"more than {TRIE_TERMS} terms or {TRIE_BYTES} bytes of them to learn from")
    trie, rows = listed_terms(pairs)
    labels = sorted({r["label"] for r in rows})
    number = {name: k for k, name in enumerate(labels)}
    kinds = [number[r["label"]] for r in rows]
    shared = df.sparkSession.sparkContext.broadcast((trie, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kinds = shared.value
        begins = trie.root.keys()
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            keys, words, sizes, told = [], [], [], []
            for key, value in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for at, (found, *_) in enumerate(_cut(value or "")):
                    low = [w.lower() for w in found]
                    if not begins.isdisjoint(low):
                        told.append((len(sizes), longest(trie.find(low))))
                    keys.append(f"{key}:{at}")
                    words.append(" ".join(found))
                    sizes.append(len(found))
            starts = np.append(0, np.cumsum(sizes)).astype(np.int32)
            tags = np.zeros(starts[-1], np.int32)
            for row, mentions in told:
                for first, last, n in mentions:
                    tags[starts[row] + first : starts[row] + last + 1] = 2 * kinds[n] + 2
                    tags[starts[row] + first] = 2 * kinds[n] + 1
            columns = [pa.array(keys, pa.string()), pa.array(words, pa.string()), pa.ListArray.from_arrays(starts, tags)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "words", "tags"])

    texts = df.select(as_column(sample_id).cast("string").alias("key"), as_column(text).alias("text"))
    return texts.mapInArrow(run, "key string, words string, tags array<int>"), labels


def examples(
    df: DataFrame, sample_id: str, text: str, gazetteer: DataFrame, term: str = "term", label: str = "label",
    most: int | None = None, seed: int = 0,
) -> tuple[DataFrame, list[str]]:
    """All sentences as (key, words, tags), and the labels in order.

    With ``most``, for a look at them, at most about that many: drawn by a hash of id and sentence, with a mention as many as
    there is room for, and without one up to ``WITHOUT`` of that. Learning takes all.
    """
    cut, labels = _marked(df, sample_id, text, gazetteer, term, label)
    if most is not None:
        # worked out again for the count rather than kept: all sentences of a corpus are as large as it is
        cut = cut.withColumn("draw", uniform(seed, "key")).withColumn("told", F.exists("tags", lambda t: t > 0))
        n = {r["told"]: r["n"] for r in cut.groupBy("told").agg(F.count(F.lit(1)).alias("n")).collect()}
        with_mention = min(1.0, most / max(1, n.get(True, 0)))
        spare = WITHOUT * min(most, n.get(True, 0))
        without = min(1.0, spare / max(1, n.get(False, 0)))
        cut = cut.filter(F.col("draw") <= F.when(F.col("told"), with_mention).otherwise(without))
    return cut.select("key", F.split("words", " ").alias("words"), "tags"), labels


_SHARD = "shard int, forms binary, ids binary, lengths binary, tags binary, hidden binary"


def _packed(rows: pa.Table) -> pa.Table:
    """A shard as one row: the forms of its different words, the words of its sentences as numbers, their tags, and which are hidden."""
    rows = rows.sort_by([("key", "ascending"), ("words", "ascending")])
    ids, lengths, forms = _numbered([w.split(" ") for w in rows["words"].to_pylist()])
    tags = np.asarray(rows["tags"].combine_chunks().flatten(), np.int32)
    hidden = np.array([zlib.crc32(k.encode()) % 2 == 0 for k in rows["key"].to_pylist()])
    data = [pa.array([x.tobytes()], pa.binary()) for x in (forms, ids, lengths, tags, hidden)]
    return pa.table([rows["shard"].slice(0, 1), *data], [c.split()[0] for c in _SHARD.split(", ")])


class _Shards:
    """Some shards with weights of their own, which learn beside each other."""

    def __init__(self, rows: list[dict], weights: np.ndarray, steps: np.ndarray, seed: int):
        n, self.buckets, self.tags = len(rows), *weights.shape
        self.weights, self.late = np.tile(weights.ravel(), n), np.zeros(n * weights.size)
        self.steps, self.late_steps = np.tile(steps.ravel(), n), np.zeros(n * steps.size)
        self.allowed = _allowed((self.tags - 1) // 2)
        lengths = [np.frombuffer(r["lengths"], np.int32) for r in rows]
        forms = [np.frombuffer(r["forms"], np.uint32).reshape(-1, _FORMS) for r in rows]
        ids = [np.frombuffer(r["ids"], np.int32) for r in rows]
        self.numbers = np.empty((sum(map(len, ids)), FEATURES), np.min_scalar_type(BUCKETS - 1))
        at = 0
        for own in zip(ids, lengths, forms, strict=True):
            self.numbers[at : at + len(own[0])] = describe(*own)
            at += len(own[0])
        self.gold = np.concatenate([np.frombuffer(r["tags"], np.int32) for r in rows]).astype(np.int64)
        self.hidden = np.concatenate([np.frombuffer(r["hidden"], np.bool_) for r in rows])
        self.lengths = np.concatenate(lengths).astype(np.int64)
        self.starts = self.lengths.cumsum() - self.lengths
        self.owner = np.repeat(np.arange(n), [len(x) for x in lengths])
        self.rounds = np.array([-(-len(x) // TOGETHER) for x in lengths])
        # the sentences of each shard in the order in which it learns from them
        self.order = np.full((n, self.rounds.max() * TOGETHER), -1)
        first = 0
        for k, (row, own) in enumerate(zip(rows, lengths, strict=True)):
            self.order[k, : len(own)] = first + np.random.default_rng(seed + row["shard"]).permutation(len(own))
            first += len(own)

    def learn(self) -> tuple[np.ndarray, np.ndarray]:
        """One pass: the sums over the shards of the means of their weights after each step."""
        for at in range(self.rounds.max()):
            some = self.order[:, at * TOGETHER : (at + 1) * TOGETHER].ravel()
            self._step(some[some >= 0], at + 1)
        share = 1.0 / (self.rounds + 1)
        mean = lambda now, late: (now.reshape(len(share), -1) - late.reshape(len(share), -1) * share[:, None]).sum(0)
        return mean(self.weights, self.late).reshape(-1, self.tags), mean(self.steps, self.late_steps).reshape(-1, self.tags)

    def _step(self, some: np.ndarray, number: int) -> None:
        lengths, owner, tags = self.lengths[some], self.owner[some], self.tags
        place = _places(lengths)
        words, shard = np.repeat(self.starts[some], lengths) + place, np.repeat(owner, lengths)
        numbers, gold = self.numbers[words].astype(np.int64), self.gold[words]
        # half of the mentions must be told without their words
        unseen = (gold > 0) & np.repeat(self.hidden[some], lengths)
        numbers[:, 0] = np.where(unseen, numbers[:, -1], numbers[:, 0])
        numbers += (shard * self.buckets)[:, None]
        steps = self.steps.reshape(-1, tags + 1, tags)[owner] + self.allowed
        scores = self.weights.reshape(-1, tags).take(numbers, axis=0).sum(1)
        found = _best_tags(scores, lengths, steps.transpose(1, 2, 0))
        wrong = np.flatnonzero(found != gold)
        if not len(wrong):
            return
        # a step is wrong where either of its tags is; the others would be taken off as often as they are added
        turned = np.unique(np.concatenate([wrong, wrong[wrong + 1 < len(gold)] + 1]))
        for truth, way in ((gold, 1.0), (found, -1.0)):
            where = (numbers[wrong] * tags + truth[wrong][:, None]).ravel()
            np.add.at(self.weights, where, way)
            np.add.at(self.late, where, way * number)
            before = np.where(place[turned] > 0, truth[turned - 1], tags)
            step = (shard[turned] * (tags + 1) + before) * tags + truth[turned]
            np.add.at(self.steps, step, way)
            np.add.at(self.late_steps, step, way * number)


def learn(
    df: DataFrame, sample_id: str, text: str, gazetteer: DataFrame, term: str = "term", label: str = "label",
    passes: int = PASSES, seed: int = 0,
) -> Tagger:
    """Learn to find terms like the listed ones, from all sentences. Null texts have none; without any mention nothing is found."""
    cut, labels = _marked(df, sample_id, text, gazetteer, term, label)
    tags = 2 * len(labels) + 1
    # one row
    chars = df.agg(F.sum(F.length(as_column(text))).alias("n")).first()["n"] or 0
    shards, at_once = max(SHARDS, math.ceil(chars / SHARD_CHARS)), max(1, HELD // (BUCKETS * tags))
    shard = F.pmod(F.xxhash64("key", "words"), F.lit(shards)).cast("int")
    # every pass reads these files: about as many shards in each, and as many files as keep all cores busy
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = min(shards, cores * math.ceil(shards / (at_once * cores)))
    packed = stored(cut.withColumn("shard", shard).groupBy("shard").applyInArrow(_packed, _SHARD).repartition(parts), "sentences")
    weights, steps = np.zeros((BUCKETS, tags)), np.zeros((tags + 1, tags))
    for number in range(passes):
        run = _one_pass(weights, steps, seed * 1000 + number, at_once)
        told = packed.mapInArrow(run, "place int, shards int, values array<double>")
        summed = told.groupBy("place").agg(Summarizer.sum(array_to_vector("values")).alias("v"), F.sum("shards").alias("n"))
        weights, steps, n = np.zeros_like(weights), np.zeros_like(steps), 0
        for row in summed.collect():  # at most BUCKETS / SUMMED + 1 rows
            if row["place"] >= 0:
                own = row["v"].toArray().reshape(-1, tags)
                weights[row["place"] : row["place"] + len(own)] = own
            else:
                steps, n = row["v"].toArray().reshape(steps.shape), row["n"]
        weights, steps = weights / max(1, n), steps / max(1, n)
    return Tagger(labels, weights.astype(np.float32), steps)


def _one_pass(weights: np.ndarray, steps: np.ndarray, seed: int, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, moves, n = np.zeros_like(weights), np.zeros_like(steps), 0
        for whole in (b for b in batches if b.num_rows):
            step = math.ceil(whole.num_rows / math.ceil(whole.num_rows / at_once))
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                told = _Shards(batch.to_pylist(), weights, steps, seed).learn()
                new, moves, n = new + told[0], moves + told[1], n + batch.num_rows
        if n:
            used = [at for at in range(0, len(new), SUMMED) if new[at : at + SUMMED].any()]
            values = [moves.ravel(), *(new[at : at + SUMMED].ravel() for at in used)]
            place = pa.array(np.array([-1, *used], np.int32))
            shards = pa.array(np.full(len(values), n, np.int32))
            yield pa.RecordBatch.from_arrays([place, shards, pa.array(values, pa.list_(pa.float64()))], ["place", "shards", "values"])

    return run


def tag_learned(df: DataFrame, sample_id: str, text: str, tagger: Tagger) -> DataFrame:
    """Mentions that the tagger finds: sample_id, term (in lower case, words with one blank between), label, start, end."""
    texts = df.select(as_column(sample_id).alias("sample_id"), as_column(text).alias("text"))
    schema = T.StructType([texts.schema["sample_id"]])
    schema = schema.add("term", "string").add("label", "string").add("start", "integer").add("end", "integer")
    shared = df.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                values, owner, found = batch.column("text").to_pylist(), [], []
                for row, value in enumerate(values):
                    own = _cut(value or "")
                    owner += [row] * len(own)
                    found += own
                rows, terms, labels, start, end = [], [], [], [], []
                for row, (words, *place), tags in zip(owner, found, tagger.tags([f[0] for f in found]), strict=True):
                    if not any(tags):
                        continue
                    there = _spans(values[row], *place, len(words))
                    for first, last, label in spans(tags):
                        rows.append(row)
                        terms.append(" ".join(words[first : last + 1]).lower())
                        labels.append(tagger.labels[label])
                        start.append(there[first][0])
                        end.append(there[last][1])
                ids = batch.column("sample_id").take(pa.array(rows, pa.int64()))
                columns = [pa.array(terms, pa.string()), pa.array(labels, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
                yield pa.RecordBatch.from_arrays([ids, *columns], schema.names)

    return texts.mapInArrow(run, schema)
