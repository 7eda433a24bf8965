"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Words are counted over all documents; the frequent ones are compiled with their ids into a minimal acyclic
transducer, which is written to the shared folder and memory-mapped by every worker. Words outside it are
merged by the vocabulary's ranks, so the lexicon decides the speed and never the result.
"""

from __future__ import annotations

import base64
import functools
import heapq
import importlib.util
import mmap
import os
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.runtime import checkpoint_dir, stored

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words compiled into the lexicon; more are merged at run time.
LEXICON_WORDS = 60_000
#: Longest word, in UTF-8 bytes, of the lexicon.
LEXICON_BYTES = 48
#: Words outside the lexicon whose ids a worker remembers.
MEMORY = 1 << 16
#: Distinct words a counting task holds before it passes its counts on.
COUNTED = 1 << 17

#: How the vocabulary parts a text into words (fixed value): word_ends() is the same, for many texts at once.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_folder() -> str:
    """Where the installed package of public tokenizers keeps its files; SILTSTONE_TOKENIZERS names another place."""
    if named := os.environ.get("SILTSTONE_TOKENIZERS"):
        return named
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(found.origin) if found else "/opt/tokenizers"


def load_ranks(folder: str, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    with open(os.path.join(folder, vocabulary), "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.cache
def _kinds() -> np.ndarray:
    """What each character is to the pattern."""
    kinds = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            for a, b in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800) + 0x800, m.end() + 0x800)):
                kinds[a:b] = kind
    return kinds


def word_ends(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each word of some texts ends; points: the characters of all texts, lengths: how many each text has.

    Words are runs of letters, of numbers, of white space and of other characters. A blank that ends white space goes to
    the word after it; other white space leaves its last character as a word of its own, if a word follows. An
    apostrophe that begins a word takes the endings of contractions from the letters that follow.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[points]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    ends_at = np.cumsum(lengths)
    edge[ends_at] = True
    edge[0] = True
    text_edge = np.zeros(n + 1, bool)
    text_edge[ends_at] = True
    after = np.flatnonzero(edge[1:n] & (kind[: n - 1] == _SPACE) & ~text_edge[1:n]) + 1  # a word follows white space
    blank = points[after - 1] == 0x20
    edge[after - 1] = True
    edge[after[blank]] = False
    quote = np.flatnonzero((points[: n - 1] == 0x27) & edge[: n - 1] & edge[1:n] & (kind[1:] == _LETTER) & ~text_edge[1:n])
    if len(quote):
        first = points[quote + 1]
        second = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        inside = ~text_edge[np.minimum(quote + 2, n)]
        one = np.isin(first, [ord(c) for c in "sdmt"])
        two = ~one & inside & (((first == ord("l")) & (second == ord("l"))) | ((second == ord("e")) & ((first == ord("v")) | (first == ord("r")))))
        edge[quote[one | two] + 1] = False
        edge[quote[one] + 2] = True
        edge[quote[two] + 3] = True
    return np.flatnonzero(edge[1:]) + 1


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each word ends in them, how many words each text has)."""
    whole = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(whole.encode("utf-8", "replace"), np.uint8)
    points = data if len(data) == len(whole) else np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    ends = word_ends(points, lengths)
    many = np.diff(np.searchsorted(ends, np.cumsum(lengths), "right"), prepend=0)
    if len(data) != len(whole):  # from characters to bytes: a character begins at every byte but a continuation
        begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        ends = begins[ends]
    return data, ends, many


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: neighbours with the least rank are merged, leftmost first, until none are left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(queue, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(queue, (r, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Lexicon:
    """A minimal acyclic transducer from words to id lists in one flat array of int32, read in place.

    States with equal futures are one, which shares suffixes. A state is a place in a table of arcs: its arc for a byte
    lies that many rows further on, if that row names the state as its source. A row has source, target, how many words
    leave the source by earlier arcs, and whether the target ends a word; so a path adds up to the number of its word,
    and that number finds the ids.
    Layout: root, number of words, rows, number of ids, offsets of id lists (words + 1), ids, rows of four.
    """

    HEAD = 4

    def __init__(self, data: np.ndarray):
        self.root, self.words, rows, ids = (int(x) for x in data[: self.HEAD])
        ends = np.cumsum([self.HEAD, self.words + 1, ids, 4 * rows])
        self.offsets, self.ids, self.arcs = data[ends[0] : ends[1]], data[ends[1] : ends[2]], data[ends[2] : ends[3]].reshape(-1, 4)

    @staticmethod
    def compile(words: list[tuple[bytes, list[int]]]) -> np.ndarray:
        """words must be sorted and distinct (Daciuk's construction for sorted input)."""
        register: dict[tuple, tuple] = {}
        path: list[list] = [[False, []]]  # [final, [(byte, frozen state)]] along the last word
        last = b""

        def freeze(state):
            key = (state[0], tuple((b, id(t)) for b, t in state[1]))
            if key not in register:
                arcs, passed = [], int(state[0])
                for b, t in state[1]:
                    arcs.append((b, t, passed))
                    passed += t[2]
                register[key] = (state[0], tuple(arcs), passed)
            return register[key]

        def close(depth):
            while len(path) > depth + 1:
                done = freeze(path.pop())
                parent = path[-1]
                parent[1][-1] = (parent[1][-1][0], done)

        for word, _ in words:
            common = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            close(common)
            for byte in word[common:]:
                path[-1][1].append((byte, None))
                path.append([False, []])
            path[-1][0] = True
            last = word
        close(0)
        root = freeze(path[0])
        places, rows = Lexicon._placed(list(register.values()))
        arcs = np.zeros((rows, 4), np.int32)
        arcs[:, 0] = -1
        for state in register.values():
            at = places[id(state)]
            for b, t, passed in state[1]:
                arcs[at + b] = (at, places[id(t)], passed, t[0])
        offsets = np.concatenate([[0], np.cumsum([len(ids) for _, ids in words])]) if words else np.zeros(1)
        ids = [i for _, found in words for i in found]
        return np.concatenate([[places[id(root)], len(words), rows, len(ids)], offsets, ids, arcs.ravel()]).astype(np.int32)

    @staticmethod
    def _placed(states: list[tuple]) -> tuple[dict[int, int], int]:
        """(place of each state, rows): no two states have one place, and no two arcs one row. States with many arcs
        come first, and those with as many look on from where the last one was placed; so single arcs fill the gaps."""
        taken, used, places, latest = bytearray(1 << 12), bytearray(1 << 12), {}, {}
        for state in sorted(states, key=lambda s: -len(s[1])):
            out = [arc[0] for arc in state[1]]
            at = latest.get(len(out), 0)
            while used[at] or any([taken[at + b] for b in out]):
                at += 1
                if len(taken) < at + 512:
                    taken.extend(bytes(len(taken)))
                    used.extend(bytes(len(used)))
            used[at] = 1
            places[id(state)] = latest[len(out)] = at
            for b in out:
                taken[at + b] = 1
        return places, max(places.values(), default=0) + 512

    def numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each word, a stretch of bytes, its number, or -1 for a word that is not in the lexicon. All words are read at
        once, byte by byte, longer ones first, so that those still being read stay together."""
        found = np.full(len(starts), -1, np.int32)
        order = np.argsort(-sizes, kind="stable")
        order = order[: np.searchsorted(-sizes[order], 0)]
        at, ends = starts[order], sizes[order]
        state, number = np.full(len(order), self.root, np.int32), np.zeros(len(order), np.int32)
        left = np.searchsorted(-ends, -np.arange(1, int(ends[0]) + 1), "right") if len(ends) else []  # words of i bytes or more
        for i, n in enumerate(left):
            row = self.arcs[state[:n] + data[at[:n] + i]]
            met = row[:, 0] == state[:n]
            number[:n] += row[:, 2]
            state[:n] = np.where(met, row[:, 1], self.dead)
            done = left[i + 1] if i + 1 < len(left) else 0
            ended = met[done:] & (row[done:, 3] != 0)
            found[order[done:n][ended]] = number[done:n][ended]
        return found

    @property
    def dead(self) -> int:
        """A place that no arc names as its source: the last rows are no state's and no arc's."""
        return len(self.arcs) - 256

    def find(self, word: bytes) -> list[int] | None:
        """The ids of one word."""
        number = int(self.numbers(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])
        return None if number < 0 else self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()

    @staticmethod
    def open(path: str) -> Lexicon:
        with open(path, "rb") as file:
            return Lexicon(np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.int32))


class Encoder:
    """Ids of texts: words are looked up in the lexicon all at once; what it does not have is merged, and remembered."""

    def __init__(self, folder: str, lexicon: Lexicon | None = None):
        self.ranks, self.lexicon = load_ranks(folder), lexicon or Lexicon(Lexicon.compile([]))
        self.merged: dict[bytes, np.ndarray] = {}

    def _merge(self, word: bytes) -> np.ndarray:
        found = self.merged.get(word)
        if found is None:
            found = np.array(merge(word, self.ranks), np.int32)
            if len(word) <= LEXICON_BYTES:
                if len(self.merged) >= MEMORY:
                    self.merged.clear()
                self.merged[word] = found
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each text has, the ids of all texts)."""
        data, ends, many = words_of(texts)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        sizes = ends - starts
        number = self.lexicon.numbers(data, starts, np.where(sizes <= LEXICON_BYTES, sizes, 0))
        known, odd = number >= 0, np.flatnonzero(number < 0)
        first = np.zeros(len(number), np.int64)
        length = np.zeros(len(number), np.int64)
        first[known] = self.lexicon.offsets[number[known]]
        length[known] = self.lexicon.offsets[number[known] + 1] - first[known]
        raw = data.tobytes()
        others = [self._merge(raw[a:b]) for a, b in zip(starts[odd].tolist(), ends[odd].tolist())]
        length[odd] = [len(x) for x in others]
        pool = np.concatenate([self.lexicon.ids, *others]) if others else self.lexicon.ids
        first[odd] = len(self.lexicon.ids) + np.cumsum(length[odd]) - length[odd]
        out = np.cumsum(length)
        ids = pool[np.arange(out[-1] if len(out) else 0) + np.repeat(first - out + length, length)]
        last = np.concatenate([[0], out])[np.cumsum(many)]
        return np.diff(last, prepend=0), ids.astype(np.int32)

    def __call__(self, text: str) -> list[int]:
        return self.encode([text])[1].tolist() if text else []


_encoders: dict[tuple, Encoder] = {}


def _encoder(folder: str, lexicon) -> Encoder:
    """One encoder per worker process and lexicon (a path that the workers share, or a broadcast of the file's bytes)."""
    key = (folder, lexicon if isinstance(lexicon, str) else id(lexicon))
    if key not in _encoders:
        _encoders.clear()
        opened = Lexicon.open(lexicon) if isinstance(lexicon, str) else Lexicon(np.frombuffer(lexicon.value, np.int32))
        _encoders[key] = Encoder(folder, opened)
    return _encoders[key]


def encoded(batch: pa.RecordBatch, encoder: Encoder, size: int = 512) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice, ids per row, ids) of the texts of a batch; null and empty texts have none."""
    for i in range(0, batch.num_rows, size):
        part = batch.slice(i, size)
        yield part, *encoder.encode([t or "" for t in part.column("text").to_pylist()])


#: Multiplier of the hash of a word's bytes, and its inverse modulo 2^64.
_TIMES = 0x9E3779B97F4A7C15
_BACK = pow(_TIMES, -1, 1 << 64)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, out of running sums over all of them."""
    powers = lambda x: np.cumprod(np.full(len(data) + 1, x, np.uint64)) * np.uint64(pow(x, -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = powers(_TIMES), powers(_BACK)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        found = (sums[ends] - sums[starts]) * down[starts]
        return (found ^ (found >> np.uint64(32))) * np.uint64(_TIMES) + (ends - starts).astype(np.uint64)


def counted_words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """(distinct words of at most LEXICON_BYTES bytes, how often each occurs). Words are told apart by a hash, so one in
    some trillions may be counted as another; that decides only what a lexicon has, never an id."""
    data, ends, _ = words_of(texts)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    short = ends - starts <= LEXICON_BYTES
    starts, ends = starts[short], ends[short]
    hashes = _hashed(data, starts, ends)
    order = np.argsort(hashes)
    firsts = np.flatnonzero(np.r_[True, np.diff(hashes[order]) != 0]) if len(order) else np.zeros(0, int)
    raw, some = data.tobytes(), order[firsts]
    return [raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())], np.diff(np.append(firsts, len(order)))


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all texts, added up within each task first."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                words, n = counted_words(batch.column(0).slice(i, 512).to_pylist())
                for word, more in zip(words, n.tolist()):
                    seen[word] += more
                if len(seen) >= COUNTED:
                    yield out()
        if seen:
            yield out()

    texts = documents.select("text").filter(F.length("text") > 0)
    return texts.mapInArrow(stage, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, folder: str, words: int = LEXICON_WORDS):
    """Compile the most frequent words of the corpus; the file's path where the shared folder is a file system's, to be
    memory-mapped by every worker, else a broadcast of its few megabytes. It serves any corpus of the vocabulary.

    The counts cover all documents; only the `words` most frequent come to the driver.
    """
    spark = documents.sparkSession
    top = word_counts(documents).orderBy(F.desc("n"), "word").limit(words).select("word").collect()
    ranks = load_ranks(folder)
    entries = sorted({r[0].encode("utf-8", "replace") for r in top})
    data = Lexicon.compile([(w, merge(w, ranks)) for w in entries if len(w) <= LEXICON_BYTES]).tobytes()
    shared = urlsplit(checkpoint_dir(spark))
    if shared.scheme not in ("", "file"):
        return spark.sparkContext.broadcast(data)
    path = f"{checkpoint_dir(spark)}/lexicon-{uuid.uuid4().hex}.bin"
    _write(spark, path, data)
    return urlsplit(path).path


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    for i in range(0, len(data), 1 << 20):
        stream.write(data[i : i + (1 << 20)])
    stream.close()


def encode(documents: DataFrame, folder: str | None = None, lexicon=None, counts_only: bool = False) -> DataFrame:
    """(doc_id, ids) of every document, or (doc_id, n_tokens) if only counts are asked for.

    Null and empty texts have the empty list (no tokens). Special-token names in a text are ordinary text.
    Any length is encoded whole. Repeated rows and ids are encoded as they come; an empty table gives an
    empty one. lexicon: from build_lexicon(); built here if none is given.
    """
    folder = folder or tokenizer_folder()
    lexicon = lexicon or build_lexicon(documents, folder)
    out = T.LongType() if counts_only else T.ArrayType(T.IntegerType())
    column = "n_tokens" if counts_only else "ids"
    schema = T.StructType([documents.schema["doc_id"], T.StructField(column, out)])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(folder, lexicon)
        for batch in batches:
            for part, many, ids in encoded(batch, encoder):
                made = pa.array(many.astype(np.int64)) if counts_only else pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), made], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(stage, schema)


def token_counts(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens), written to the shared folder."""
    return stored(encode(documents, folder, counts_only=True), "document-tokens")
