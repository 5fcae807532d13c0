"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The vocabulary file (a public ``tokenizers`` JSON of the word-end BPE kind) is
a parameter.  Three steps:

1. :func:`frequent_words` counts words over all texts; each block of text
   nominates the most frequent of what it holds at least twice, and the sums
   rank them.
2. :class:`Transducer` compiles the chosen words into a minimal acyclic
   automaton: equal suffixes share states, arc outputs add up to the word's
   ordinal, and the ordinal points at its token ids.  The bytes are written to
   the shared folder, shipped as a Spark file and memory-mapped by every
   worker, so workers of one machine share the pages.
3. :func:`encode` looks each word up in the transducer; words outside it are
   merged exactly, lowest rank first and leftmost among equals.

The lexicon only decides how fast a word is found, never its ids.

Edge cases: null counts as empty and gives no ids; texts may be of any length
(work is cut into runs of about a megabyte, one text at least); control
strings of the vocabulary found in a text become their single ids, as the
library does; repeated rows are encoded each; other columns are carried.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common as C

#: Words compiled into the lexicon, and words a block of text may nominate.
LEXICON_WORDS = 1 << 17
NOMINATED = 1 << 15
#: Entries of a worker's memo of looked-up words.
MEMO_WORDS = 100_000
#: Bytes up to which words are merged in columns; longer ones go one by one.
LONG_WORD = 64
#: Text encoded at a time: the more, the more new words share a step.
RUN_BYTES = 1 << 20

# Contractions and white space of the vocabulary's word pattern.
_CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PATTERN = "|".join(_CONTRACTIONS) + rf"|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+"


def _latin_pattern() -> re.Pattern:
    """The same pattern for texts of Latin-1 characters, for the faster engine."""
    letters = "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == "L")
    numbers = "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == "N")
    return re.compile("|".join(_CONTRACTIONS) + f"|[{letters}]+|[{numbers}]|[^\\t-\\r \\x85\\xa0{letters}{numbers}]+")


_LATIN, _ANY, _ASCII_SPACE = _latin_pattern(), regex.compile(_PATTERN), re.compile("[ \t-\r]+")


def _by_pattern(text: str) -> list[str]:
    # The library lower-cases character by character: no final form of sigma.
    return _ANY.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())


def split_words(text: str, other=_by_pattern) -> list[str]:
    """Normalised words of a text without control strings.

    Pieces with characters beyond Latin-1 go to ``other``: which of them are
    letters depends on the Unicode version, so :class:`Vocabulary` passes the
    library's own splitter there.
    """
    if text.isascii():
        return _LATIN.findall(text.lower())
    try:
        composed = unicodedata.normalize("NFC", text).lower()
        composed.encode("latin-1")
        return _LATIN.findall(composed)
    except UnicodeEncodeError:
        out = []
        for piece in _ASCII_SPACE.split(text):
            try:
                composed = unicodedata.normalize("NFC", piece).lower()
                composed.encode("latin-1")
                out += _LATIN.findall(composed)
            except UnicodeEncodeError:
                out += other(piece)
        return out


def byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Merges and ids of one vocabulary file."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        #: Rank of a pair of ids, and the id that the merge of a rank makes.
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(model["merges"])}
        self.made = [vocab[a + b] for a, b in model["merges"]]
        self.control = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.control.items()}
        self.blob, self.library, self.table = blob, None, None
        self.control_split = re.compile("(" + "|".join(map(re.escape, self.control)) + ")") if self.control else None
        #: What every control string begins with; texts without it hold none.
        self.control_start = os.path.commonprefix(list(self.control))

    def split_other(self, piece: str) -> list[str]:
        """Words of a piece as the library's normaliser and splitter give them."""
        if self.library is None:
            self.library = tokenizers.Tokenizer.from_str(self.blob.decode())
        text = self.library.normalizer.normalize_str(piece)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def merge(self, word: str) -> list[int]:
        """Token ids of one word: the merge of lowest rank first, leftmost first.

        A heap of (rank, place) over linked neighbours, so that a word of any
        length takes n log n steps; entries that a merge made stale are skipped.
        """
        raw = word.encode()
        inner, get, made = self.inner, self.ranks.get, self.made
        ids = [inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i, pair in enumerate(pairwise(ids)) if (rank := get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = made[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (rank, i))
            if (h := before[i]) >= 0 and (rank := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (rank, h))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """What the library's decode gives where the file names no decoder: tokens joined by one space."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """:meth:`decode` of a column; null lists give ''."""
        if self.table is None:
            self.table = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.string())
        lists = pc.fill_null(lists, [])
        flat, offsets = lists.values, lists.offsets  # of a slice: offsets say where it begins
        flat = flat.slice(offsets[0].as_py(), offsets[-1].as_py() - offsets[0].as_py())
        offsets = pc.subtract(offsets, offsets[0])
        inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.table)))
        if flat.null_count or not pc.all(inside).as_py() or (tokens := self.table.take(flat)).null_count:  # ids that no token has are skipped
            return pa.array([self.decode(x) for x in lists.to_pylist()], pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")


class Transducer:
    """Minimal acyclic transducer over bytes, word -> token ids, on one mapped buffer.

    Arcs are sorted by (state, label), so a whole column of words takes a step
    by one binary search over the arc keys.
    """

    _MAGIC = b"MATL0002"

    def __init__(self, buf):
        states, arcs, words, pool = np.frombuffer(buf, "<i8", 4, 8).tolist()
        at = 40
        self.parts = []
        for n, kind in ((arcs, "<u4"), (arcs, "<u4"), (arcs, "<u4"), (words + 1, "<u4"), (pool, "<i4"), (states, "u1")):
            self.parts.append(np.frombuffer(buf, kind, n, at))
            at += self.parts[-1].nbytes
        self.keys, self.target, self.output, self.start, self.pool, self.accept = self.parts

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Ordinals of equally long words (rows of bytes), -1 for words outside."""
        n, length = words.shape
        state, number, here = np.zeros(n, np.uint32), np.zeros(n, np.int64), np.arange(n)
        for j in range(length):
            key = state << np.uint32(8) | words[here, j]
            arc = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            ok = self.keys[arc] == key if len(self.keys) else np.zeros(len(key), bool)
            here, arc = here[ok], arc[ok]
            number[here] += self.output[arc]
            state = self.target[arc]
        out = np.full(n, -1, np.int64)
        ends = self.accept[state] == 1 if len(here) else np.zeros(0, bool)
        out[here[ends]] = number[here[ends]]
        return out

    def ids(self, ordinal: int) -> np.ndarray:
        return self.pool[self.start[ordinal] : self.start[ordinal + 1]]

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> bytes:
        """Incremental minimisation over sorted words; equal suffixes become one state."""
        # A state on the path of the last word is [accept, {label: child}]; finished ones are numbers.
        register: dict[tuple, int] = {}
        made: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def freeze(state: list) -> int:
            key = (state[0], tuple(state[1].items()))
            if key not in register:
                register[key] = len(made)
                made.append(key)
            return register[key]

        path: list[list] = [[False, {}]]
        last = b""
        for word in sorted(words):
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            for depth in range(len(last), same, -1):
                path[depth - 1][1][last[depth - 1]] = freeze(path.pop())
            for label in word[same:]:
                path[-1][1][label] = None
                path.append([False, {}])
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            path[depth - 1][1][last[depth - 1]] = freeze(path.pop())
        root = freeze(path[0])
        # Children are numbered before their parents: reverse, so that the root is state 0.
        order = [root] + [i for i in range(len(made) - 1, -1, -1) if i != root]
        place = {old: new for new, old in enumerate(order)}
        below = [0] * len(made)
        for i, (accept, arcs) in enumerate(made):
            below[i] = accept + sum(below[t] for _, t in arcs)
        keys, target, output, accepts = [], [], [], bytearray()
        for state, old in enumerate(order):
            accept, arcs = made[old]
            accepts.append(accept)
            number = int(accept)
            for label, t in arcs:  # sorted, since words were added in order
                keys.append(state << 8 | label)
                target.append(place[t])
                output.append(number)
                number += below[t]
        start, pool = [0], []
        for word in sorted(words):
            pool += words[word]
            start.append(len(pool))
        head = np.array([len(order), len(target), len(words), len(pool)], "<i8").tobytes()
        return cls._MAGIC + head + b"".join(np.array(x, "<u4").tobytes() for x in (keys, target, output, start, pool)) + bytes(accepts)


class Merger:
    """Exact merges of many equally long words at once."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.inner, self.final, self.made = (np.array(x, np.int32) for x in (v.inner, v.final, v.made))
        pairs = np.array([(a << 32 | b, rank) for (a, b), rank in v.ranks.items()], np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0])
        self.keys, self.rank = pairs[order, 0], pairs[order, 1].astype(np.int32)
        self.never = np.int32(np.iinfo(np.int32).max)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.rank[at], self.never)

    def merge(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids padded by -1, number of ids) of each row of bytes."""
        n, length = words.shape
        ids = self.inner[words]
        ids[:, -1] = self.final[words[:, -1]]
        count = np.full(n, length)
        if length == 1:
            return ids, count
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        column, live = np.arange(length), np.arange(n)
        while len(live):
            rows = np.arange(len(live))
            at = rank[live].argmin(axis=1)  # the lowest rank, leftmost among equals
            best = rank[live, at]
            go = best < self.never
            live, at, best, rows = live[go], at[go], best[go], rows[: int(go.sum())]
            if not len(live):
                break
            x, r = ids[live], rank[live]
            behind = column > at[:, None]
            x[:, :-1] = np.where(behind[:, :-1], x[:, 1:], x[:, :-1])
            x[:, -1] = -1
            x[rows, at] = self.made[best]
            r[:, :-1] = np.where(behind[:, :-2], r[:, 1:], r[:, :-1])
            r[:, -1] = self.never
            left = at > 0
            r[rows[left], at[left] - 1] = self.ranks(x[rows[left], at[left] - 1], x[rows[left], at[left]])
            right = at < length - 1
            r[rows[right], at[right]] = self.ranks(x[rows[right], at[right]], x[rows[right], at[right] + 1])
            ids[live], rank[live] = x, r
            count[live] -= 1
        return ids, count


class Codec:
    """A worker's encoder: memo, then the mapped transducer, then exact merges.

    Words that a run of texts adds are looked up and merged together, grouped
    by their length in bytes; the memo is emptied when it is full.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None):
        self.vocabulary, self.lexicon, self.merger = vocabulary, lexicon, Merger(vocabulary)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {t: i for i, t in enumerate(self.vocabulary.control)}
        self.ids = [np.array([i], np.int32) for i in self.vocabulary.control.values()]
        self.flat = np.concatenate(self.ids) if self.ids else np.empty(0, np.int32)
        self.count = np.ones(len(self.memo), np.int64)
        self.start = np.arange(len(self.memo))

    def _learn(self, words: list[str]) -> None:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            groups.setdefault(len(raw), []).append((w, raw))
        flats, counts = [self.flat], [self.count]
        for length, group in groups.items():
            if length > LONG_WORD:
                for w, _ in group:
                    self.memo[w] = len(self.memo)
                    flats.append(np.array(self.vocabulary.merge(w), np.int32))
                    counts.append(np.array([len(flats[-1])]))
                continue
            rows = np.frombuffer(b"".join(raw for _, raw in group), np.uint8).reshape(-1, length)
            found = self.lexicon.lookup(rows) if self.lexicon else np.full(len(rows), -1)
            known, new = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
            for i in (*known.tolist(), *new.tolist()):
                self.memo[group[i][0]] = len(self.memo)
            if len(known):
                begin = self.lexicon.start[found[known]].astype(np.int64)
                n = self.lexicon.start[found[known] + 1] - begin
                flats.append(self.lexicon.pool[ragged(begin, n)])
                counts.append(n)
            if len(new):
                ids, n = self.merger.merge(rows[new])
                flats.append(ids[ids >= 0])
                counts.append(n)
        self.flat, self.count = np.concatenate(flats), np.concatenate(counts)
        self.start = np.cumsum(self.count) - self.count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        v = self.vocabulary
        words, ends = [], [0]
        for text in texts:
            for part in v.control_split.split(text) if v.control and v.control_start in text else (text,):
                if part in v.control:
                    words.append(part)
                else:
                    words += split_words(part, v.split_other)
            ends.append(len(words))
        at = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if len(self.memo) >= MEMO_WORDS:
                self.forget()
                missing = np.arange(len(words))
            self._learn([w for w in dict.fromkeys(map(words.__getitem__, missing.tolist())) if w not in self.memo])
            at[missing] = np.fromiter(map(self.memo.__getitem__, map(words.__getitem__, missing.tolist())), np.int64, len(missing))
        n = self.count[at]
        total = np.concatenate([[0], np.cumsum(n)])[np.array(ends)]
        return self.flat[ragged(self.start[at], n)], np.diff(total)


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+n[0]-1, start[1] .. and so on."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


_CODECS: dict[str, Codec] = {}


def frequent_words(docs: DataFrame, text: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words by summed nominations, at most ``limit`` of them."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Counter = Counter()
        seen = 0

        def nominated() -> pa.RecordBatch:
            words: Counter = Counter()
            for piece, n in pieces.items():
                if n > 1:
                    for w in split_words(piece.decode()):
                        words[w] += n
            top = words.most_common(NOMINATED)
            return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

        for _, texts in C.batches_of(it):
            for t in texts:
                pieces.update(t.split())
                seen += len(t)
                if seen >= 8 << 20:
                    yield nominated()
                    pieces.clear()
                    seen = 0
        yield nominated()

    found = docs.select(F.col(C.sql_name(text)).cast("string").alias("text")).mapInArrow(C.lean(count), "word string, n bigint")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(limit)
    return [r["word"] for r in top.collect()]


def publish(spark: SparkSession, blob: bytes) -> str:
    """Put a lexicon where every executor gets it; gives the file's name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{C.stage_path(spark, 'lexicon')}/{name}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(blob))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def load_vocabulary(spark: SparkSession, path: str | None = None):
    """Broadcast of the vocabulary file (bounded: a few megabytes), read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary, *, text: str = "text", carry: list[str] | None = None, lexicon_words: int = LEXICON_WORDS, decoded: bool = False) -> DataFrame:
    """``row`` (the carried columns) and ``ids array<int>`` of each text.

    With ``decoded`` the text that the ids decode to comes along, from the
    same worker: one Python process for each task instead of two.
    """
    spark = docs.sparkSession
    C.bound_batches(spark)
    local = Vocabulary(vocabulary.value)
    words = frequent_words(docs, text, lexicon_words)
    name = publish(spark, Transducer.compile({w.encode(): local.merge(w) for w in words}))
    cols = docs.columns if carry is None else carry
    df = docs.select(F.struct(*[F.col(C.sql_name(c)) for c in cols]).alias("row"), F.col(C.sql_name(text)).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _CODECS:
            _CODECS.clear()
            with open(SparkFiles.get(name), "rb") as f:
                mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            _CODECS[name] = Codec(Vocabulary(vocabulary.value), Transducer(mapped))
        codec = _CODECS[name]
        for batch, texts in C.batches_of(it, size=RUN_BYTES):
            flat, n = codec.encode([t.decode() for t in texts])
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            texts_ = [codec.vocabulary.decode_lists(ids)] if decoded else []
            yield pa.RecordBatch.from_arrays([batch.column("row"), ids, *texts_], ["row", "ids", "decoded"][: 2 + decoded])
        codec.forget()  # the worker lives on

    fields = [df.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return df.mapInArrow(C.lean(run), T.StructType(fields[: 2 + decoded]))


_TOKENS: dict[str, Vocabulary] = {}


def decode(df: DataFrame, vocabulary, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of an id column appended as ``out``; null ids give ''."""

    key = uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TOKENS:
            _TOKENS.clear()
            _TOKENS[key] = Vocabulary(vocabulary.value)
        v = _TOKENS[key]
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, v.decode_lists(part.column(ids))], [*part.schema.names, out])

    return df.mapInArrow(C.lean(run), T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def joined_ids(ids: str = "ids"):
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents.

    Pieces with characters beyond Latin-1 are normalised and split by the
    library; merges are the engine's own everywhere.
    """
    vocabulary = load_vocabulary(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, vocabulary, carry=["doc_id"], decoded=True)
    return out.select("row.doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined_ids(), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
