"""Best-fit packing of token sequences, after Martello and Toth's dominance reduction.

Texts become pieces of at most ``capacity`` tokens. How many pieces have each length is all that the
packing needs: it fixes, for all pieces of a length at once, small sets that dominate every other
way to fill a sequence with the longest piece (it alone, with one exact partner, or with the one
piece that still fits), and packs the rest best-fit decreasing. The plan has a bounded number of
patterns, whatever the number of pieces; Spark deals the pieces to the patterns' slots.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.shared import blocks, stored

CAPACITY = 1024
END_ID = 2
#: Most words whose ids a worker keeps; beyond it the store starts afresh.
KEPT_WORDS = 150_000
#: Words that are encoded as one text.
JOINED_WORDS = 2_000
#: Parts in which the pieces of one length are numbered.
PARTS = 512


#: White space beside a space or at an end of the text: such texts are encoded whole.
_LOOSE = re.compile(r"^\s| \s|\s |\s$")
#: What makes the search above worth while in ASCII texts, and in others.
_ASCII_LOOSE = [pair for c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f " for pair in {f" {c}", f"{c} "}]
_WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters before this one have had the same Unicode properties in every version.
_NOT_LATIN = "\u0250"


def _loose(text: str) -> bool:
    if not text or text[0].isspace() or text[-1].isspace() or any(p in text for p in _ASCII_LOOSE):
        return True
    return not text.isascii() and any(c in text for c in _WIDE_SPACES) and bool(_LOOSE.search(text))


def _merges_by_rank(tokenizer):
    """A faster encoder with the same vocabulary, or None if the file's ids are not in the order of its merges."""
    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    vocabulary, merges = model.get("vocab", {}), model.get("merges", [])
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    ids = [vocabulary.get(m, -1) for m in joined]
    if not ids or ids != sorted(ids) or len(set(ids)) != len(ids):
        return None
    # The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    alphabet = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    if any(c not in alphabet for token in joined for c in token):
        return None
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes(alphabet[c] for c in t): vocabulary[t] for t in (*alphabet, *joined)}
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, its faster form, which ids begin with a space, and the ids of words after a space."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    spaced = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    spaced[[i for token, i in tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
    return tokenizer, _merges_by_rank(tokenizer), spaced, {}


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[str, ...]:
    """The tokens that the file adds to the model's, as they stand in texts."""
    return tuple(t.content for t in _tokenizer(path)[0].get_added_tokens_decoder().values() if t.content)


@lru_cache(maxsize=2)
def _unmodified(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def file_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as the unmodified tokenizer gives them, where added tokens have ids of their own."""
    added = _added(path)
    marked = [k for k, text in enumerate(texts) if any(token in text for token in added)]
    if not marked:
        return token_ids(texts, path)
    # Texts with added tokens are encoded whole.
    own = _unmodified(path).encode_batch_fast([texts[k] for k in marked], add_special_tokens=False)
    by_place = {k: np.asarray(x.ids, dtype="<u4").tobytes() for k, x in zip(marked, own, strict=True)}
    rest = iter(token_ids([text for k, text in enumerate(texts) if k not in by_place], path))
    return [by_place[k] if k in by_place else next(rest) for k in range(len(texts))]


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as unsigned 32-bit numbers, the same as the tokenizer gives for the whole text if
    it takes special tokens as plain text (:func:`file_ids` doesn't).

    The pattern of the byte-level tokenizer always begins a new piece with a single space between other
    characters, so a text is cut there and each different word is encoded once. The words to encode are
    joined by spaces; the ids that begin with a space tell where each starts. Words of Latin letters go through
    the faster form.
    """
    tokenizer, faster, spaced, known = _tokenizer(path)

    def encode(parts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, dtype="<u4") for x in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    if len(known) > KEPT_WORDS:
        known.clear()
    cut = [None if _loose(text) else text.split(" ") for text in texts]
    missing = set()
    for words in cut:
        if words:
            missing.update(words[1:])
    latin, other = [], []
    for word in missing.difference(known):
        (latin if faster and (word.isascii() or max(word) < _NOT_LATIN) else other).append(word)
    for new in (latin, other):
        for at in range(0, len(new), JOINED_WORDS):
            part = new[at : at + JOINED_WORDS]
            text = " " + " ".join(part)
            ids = np.asarray(faster.encode_ordinary(text), dtype="<u4") if new is latin else encode([text])[0]
            begins = 4 * np.flatnonzero(spaced[ids])
            raw, ends = ids.tobytes(), [*begins[1:].tolist(), 4 * len(ids)]
            known.update(zip(part, [raw[a:b] for a, b in zip(begins.tolist(), ends, strict=True)], strict=True))
    whole = iter(encode([w[0] if w else t for t, w in zip(texts, cut, strict=True)]))
    return [
        next(whole).tobytes() + (b"".join(map(known.__getitem__, w[1:])) if w else b"") for w in cut
    ]


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece; only the first of several may be shorter than the capacity."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    edges = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:], strict=False)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and cut into pieces: doc_id, piece, start, length, ids_crc32.

    A null text counts as empty: only the end id is left of it (no piece at all without an end id).
    """
    end = b"" if end_id is None else np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            texts = block.column("text").fill_null("").to_pylist()
            rows = [
                (i, k, *piece)
                for i, ids in enumerate(file_ids(texts, tokenizer_path))
                for k, piece in enumerate(pieces_of(ids + end, capacity) if ids + end else [])
            ]
            if not rows:
                continue
            which, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pa.array(which)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        _tokenizer(tokenizer_path)[-1].clear()  # the worker goes on to other tasks

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Pack ``counts[length]`` pieces of each length: a list of (number of sequences, lengths in each).

    First the dominance reduction on the longest length left: a sequence with (1) that piece alone
    if nothing else fits, (2) it and a piece that fills the sequence exactly, (3) it and the longest
    piece that fits, if no two pieces fit together, loses nothing against any other packing, and as
    many such sequences are fixed as there are pieces for them. Then best-fit decreasing.
    """
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    plan: list[tuple[int, tuple[int, ...]]] = []
    lengths = sorted(left)

    def fix(*own: int) -> bool:
        number = min(left[n] // own.count(n) for n in own)
        if number:
            plan.append((number, own))
            for n in own:
                left[n] -= number
            lengths[:] = [n for n in lengths if left[n]]
        return number > 0

    for longest in lengths[::-1]:
        space, fixed = capacity - longest, True
        while fixed and left[longest]:
            others = [n for n in lengths if n <= space and left[n] > (n == longest)]
            if not others:
                fixed = fix(longest)
            elif others[-1] == space:
                fixed = fix(longest, space)
            else:
                spare = left[others[0]] - (others[0] == longest) > 1
                two = others[0] + (others[0] if spare else others[1] if len(others) > 1 else capacity)
                fixed = two > space and fix(longest, others[-1])
    rest = {n: left[n] for n in lengths}
    # Sequences by free space; each entry is a pattern and how many sequences have it.
    open_: dict[int, list[list]] = {}
    spaces: list[int] = []
    for length in sorted(rest, reverse=True):
        number = rest[length]
        while number:
            at = next((i for i in range(len(spaces)) if spaces[i] >= length), None)
            if at is None:
                each = capacity // length
                full, over = divmod(number, each)
                new = [(full, each), (1, over)] if over else [(full, each)]
                made = [[n, (length,) * k, capacity - length * k] for n, k in new if n]
                number = 0
            else:
                space = spaces[at]
                entry = open_[space][-1]
                used = min(entry[0], number)
                each = min(space // length, number // used)
                made = [[used, entry[1] + (length,) * each, space - length * each]]
                number -= used * each
                entry[0] -= used
                if not entry[0]:
                    open_[space].pop()
                if not open_[space]:
                    del open_[space]
                    spaces.pop(at)
            for n, own, space in made:
                if not space:
                    plan.append((n, own))
                    continue
                if space not in open_:
                    insort(spaces, space)
                open_.setdefault(space, []).append([n, own])
    return plan + [(n, own) for entries in open_.values() for n, own in entries]


def _slots(plan: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, end, sequences' first id, copies in a sequence, first offset, length) by pattern."""
    rows, used, base = [], {}, 0
    for number, own in plan:
        offset = 0
        for length in dict.fromkeys(own):
            copies = own.count(length)
            low = used.get(length, 0)
            used[length] = low + number * copies
            rows.append((length, low, low + number * copies, base, copies, offset))
            offset += length * copies
        base += number
    return rows


def assign(pieces: DataFrame, capacity: int = CAPACITY, parts: int = PARTS) -> DataFrame:
    """Give each row of ``pieces`` (a stored frame with a column length) a sequence_id and an offset.

    Ranks within a length come from counts in ``parts`` hash parts and a numbering inside each part,
    so no length, however common, is numbered in one task. The driver sees one count per length.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark = pieces.sparkSession
    slots = spark.createDataFrame(
        _slots(pack_counts(counts, capacity)),
        "length long, low long, high long, base long, copies long, at long",
    )
    own = [c for c in pieces.columns]
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    # A length has at most ``parts`` rows here.
    before = sizes.withColumn(
        "_before",
        F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
    )
    numbered = dealt.withColumn(
        "_row", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1
    )
    ranked = numbered.join(before.drop("_n"), ["length", "_part"]).withColumn(
        "_rank", F.col("_row") + F.coalesce("_before", F.lit(0))
    )
    # The slots are bounded by the capacity, not by the pieces.
    joined = ranked.join(
        F.broadcast(slots.withColumnRenamed("length", "_length")),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")),
    )
    place = F.col("_rank") - F.col("low")
    return joined.select(
        *own,
        (F.col("base") + F.floor(place / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + (place % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """Pack ``docs`` (doc_id, text, other columns ignored) into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and
    empty texts give the end id alone; equal rows are packed as often as they occur; a null doc_id is
    kept. An empty table gives no rows.
    """
    return assign(stored(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
