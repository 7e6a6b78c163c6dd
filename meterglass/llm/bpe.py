"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus are encoded once and compiled into an automaton that shares
prefixes and suffixes. Its transitions carry counts whose sum along a word is the word's number, and
numbers index one array of ids. The file is sent to every executor and memory-mapped there; only
the entries that a slice of text asks for are read from it, so the workers of a machine share its
pages. Words that the lexicon does not hold are merged exactly, so its size changes the speed and
never the ids.

What is a letter, a digit or white space, how letters are lower-cased and which marks are put in
order follows the vocabulary library's own tables, which are of other Unicode versions than
Python's. The driver asks the library about every code point once and sends the answers along.

Texts go through Arrow batch by batch. A slice is cut into words on arrays of code points; each
distinct word is looked up once, all of them together, one step of the automaton per byte.
"""

from __future__ import annotations

import hashlib
import io
import json
import os.path
import re
import tempfile
import unicodedata
from functools import cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.llm.common import cut_lineage, per_text, ship_package, whole_text

#: What stays one word behind an apostrophe, and the end-of-word mark.
CONTRACTED = ("s", "t", "m", "d", "re", "ve", "ll")
SUFFIX = "</w>"
#: The rank of a pair that is never merged.
NO_MERGE = 1 << 60
#: Letters of a word that is merged without a heap.
SHORT = 40
#: Bytes of text that a worker handles at once, of many texts or as a part of one.
SLICE = 1 << 19
OTHER, LETTER, NUMBER, SPACE = range(4)
CODES = 0x110000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def kinds_of(pieces) -> np.ndarray:
    """The kind of every code point, where ``pieces`` cuts a string into (start, end) of its words.

    A range whose characters all behave alike is told by two calls, any other is halved.
    """
    out = np.zeros(CODES, np.uint8)

    def kind(codes: range):
        n, between = len(codes), "".join(map(chr, codes))
        cut = pieces(f"a{between}b")
        if cut == [(0, n + 2)]:
            return LETTER
        if cut == [(0, 1), (n + 1, n + 2)]:
            return SPACE
        if cut == [(0, 1), (1, n + 1), (n + 1, n + 2)]:
            return OTHER if pieces(f"!{between}!") == [(0, n + 2)] else NUMBER
        return None

    todo = [range(i, i + 256) for i in range(0, 0x34000, 256) if not 0xD800 <= i < 0xE000]
    todo += [range(i, i + 0x4000) for i in range(0x34000, CODES, 0x4000)]
    while todo:
        codes = todo.pop()
        known = kind(codes)
        if known is None:
            half = len(codes) // 2
            todo += [codes[:half], codes[half:]]
        else:
            out[codes.start : codes.stop] = known
    return out


def library_tables(path: str) -> bytes:
    """A file of arrays: the kinds, lower-case letters (from, to) and NFC's barriers, by the library.

    A barrier is a code point that Python's NFC reorders or composes and the library's leaves alone.
    """
    from tokenizers import Tokenizer, normalizers

    cutter = Tokenizer.from_file(path).pre_tokenizer
    kinds = kinds_of(lambda text: [at for _, at in cutter.pre_tokenize_str(text)])
    codes = [c for c in range(CODES) if not 0xD800 <= c <= 0xDFFF and c != 10]
    lowered = normalizers.Lowercase().normalize_str("\n".join(map(chr, codes))).split("\n")
    own = [(c, ord(x)) for c, x in zip(codes, lowered) if len(x) == 1 and x != chr(c).lower()]
    barriers = set()
    tried = [c for c in codes if c < 0x20000 or c >> 16 == 14]
    # Marks of the lowest and the highest class on either side show where a mark goes.
    text = "\n".join(f"a{x}\u0334 a\u0345{x} {x}" for x in map(chr, tried))
    both = normalizers.NFC().normalize_str(text).split("\n"), unicodedata.normalize("NFC", text).split("\n")
    barriers |= {c for c, theirs, ours in zip(tried, *both) if theirs != ours}
    for c in tried:
        parts = unicodedata.decomposition(chr(c))
        if parts and parts[0] != "<":
            pair = "".join(chr(int(x, 16)) for x in parts.split())
            if normalizers.NFC().normalize_str(pair) != unicodedata.normalize("NFC", pair):
                barriers |= {c, ord(pair[-1])}
    out = io.BytesIO()
    arrays = {"kinds": kinds, "upper": np.array([c for c, _ in own], np.uint32), "lower": np.array([x for _, x in own], np.uint32)}
    np.savez_compressed(out, barriers=np.array(sorted(barriers), np.uint32), **arrays)
    return out.getvalue()


class Tables:
    def __init__(self, file):
        with np.load(file) as held:
            self.kinds, self.upper, self.lower = held["kinds"], held["upper"], held["lower"]
            barriers = "".join(map(chr, held["barriers"]))
        self.barriers = re.compile(f"([{re.escape(barriers)}])") if barriers else None
        self.special = np.zeros(CODES, bool)
        self.special[self.upper] = True

    def nfc(self, text: str) -> str:
        """The library's NFC: a barrier keeps its place, and what stands before and after apart."""
        if unicodedata.is_normalized("NFC", text):
            return text  # a barrier only keeps more apart
        if not self.barriers:
            return unicodedata.normalize("NFC", text)
        return "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(self.barriers.split(text)))


class Vocabulary:
    """Ids, merge ranks and special tokens of a vocabulary file, and the library's tables."""

    def __init__(self, path: str, tables):
        spec = json.loads(Path(path).read_text())
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.ranks = {tuple(m): r for r, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        by_id = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.tokens = pa.array([by_id.get(i, "") for i in range(max(by_id) + 1)], pa.string())
        self.tables = Tables(tables)

    def pieces(self, text: str) -> list[str]:
        """The text as the model sees it; every other piece is a special token, taken as it is."""
        parts = self.split.split(text) if self.split and "<|" in text else [text]
        # Lower case goes character by character, so a final sigma is like any other.
        return [x if i % 2 else self.tables.nfc(x).replace("Σ", "σ").lower() for i, x in enumerate(parts)]

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts in order (UTF-8), and how many each text has."""
        pieces = [self.pieces(t) for t in texts]
        flat = [p for ps in pieces for p in ps]
        codes = np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32)
        tables = self.tables
        if tables.special[codes].any():
            swap = np.arange(CODES, dtype=np.uint32)
            swap[tables.upper] = tables.lower
            codes = swap[codes]
        kind = tables.kinds[codes]
        starts = kind == NUMBER
        starts[:1] = True
        starts[1:] |= kind[1:] != kind[:-1]
        ends = np.cumsum([0, *map(len, flat)])
        starts[ends[:-1][np.diff(ends) > 0]] = True
        self._contract(codes, starts, ends)
        at = np.cumsum([0, *map(len, pieces)])
        for n in np.flatnonzero(np.diff(at) > 1):
            for i in range(at[n] + 1, at[n + 1], 2):  # a special token is one word
                starts[ends[i] + 1 : ends[i + 1]] = False
        places = np.flatnonzero(starts)
        width = 1 + (codes > 0x7F).astype(np.int32) + (codes > 0x7FF) + (codes > 0xFFFF)
        offset = np.r_[0, np.cumsum(width)].astype(np.int32)
        data = pa.py_buffer(codes.tobytes().decode("utf-32-le").encode())
        edges = pa.py_buffer(offset[np.append(places, len(codes))])
        words = pa.Array.from_buffers(pa.binary(), len(places), [None, edges, data])
        shown = kind[places] != SPACE
        return words.filter(pa.array(shown)), np.diff(np.searchsorted(places[shown], ends[at]))

    @staticmethod
    def _contract(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """An apostrophe that starts a word takes a contracted ending with it; what follows starts anew."""
        quotes = np.flatnonzero(starts & (codes == 39))
        if not len(quotes):
            return
        limit = ends[np.searchsorted(ends, quotes, "right")]
        padded = np.r_[codes, np.zeros(2, np.uint32)]
        for ending in CONTRACTED:
            ok = quotes + len(ending) < limit
            for k, c in enumerate(ending, 1):
                ok &= padded[quotes + k] == ord(c)
            starts[quotes[ok] + 1] = False
            after = quotes[ok] + 1 + len(ending)
            starts[after[after < len(codes)]] = True

    def merge(self, word: str) -> list[int]:
        """The ids of one word: the pair of lowest rank, of those the first, is joined until none is left."""
        if word in self.special:
            return [self.special[word]]
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += SUFFIX
        return [self.ids[p] for p in (self._merged_short if len(parts) <= SHORT else self._merged)(parts)]

    def _merged_short(self, parts: list[str]) -> list[str]:
        """By looking at all pairs for each merge, which is quickest for a word of a few letters."""
        rank_of = self.ranks.get
        ranks = [rank_of(p, NO_MERGE) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NO_MERGE:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), NO_MERGE)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), NO_MERGE)
        return parts

    def _merged(self, parts: list[str]) -> list[str]:
        """Pairs wait in a heap by rank and place; one that has changed since is passed over. n letters take n log n steps."""
        n, rank_of = len(parts), self.ranks.get
        ranks = [rank_of(p, NO_MERGE) for p in zip(parts, parts[1:])] + [NO_MERGE]
        waiting = [(r, i) for i, r in enumerate(ranks) if r != NO_MERGE]
        if waiting:
            heapify(waiting)
            after, before = list(range(1, n + 1)), list(range(-1, n))
        while waiting:
            rank, i = heappop(waiting)
            if ranks[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            parts[i], parts[j], ranks[j] = parts[i] + parts[j], None, NO_MERGE
            before[k] = i
            ranks[i] = rank_of((parts[i], parts[k]), NO_MERGE) if k < n else NO_MERGE
            if ranks[i] != NO_MERGE:
                heappush(waiting, (ranks[i], i))
            h = before[i]
            if h >= 0:
                ranks[h] = rank_of((parts[h], parts[i]), NO_MERGE)
                if ranks[h] != NO_MERGE:
                    heappush(waiting, (ranks[h], h))
        return [p for p in parts if p is not None]


@cache
def vocabulary(name: str, tables: str) -> Vocabulary:
    """The vocabulary from files that ``ship`` has sent."""
    return Vocabulary(SparkFiles.get(name), SparkFiles.get(tables))


def ship(spark: SparkSession, path: str) -> str:
    """Send a file to all executors, those that start later too; the name to open it by."""
    name = Path(path).name
    if not any(Path(f).name == name for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(str(Path(path).resolve()))
    return name


def ship_bytes(spark: SparkSession, data: bytes, kind: str) -> str:
    """Send bytes as a file named after their digest, so the same are sent once."""
    file = Path(tempfile.mkdtemp(prefix="meterglass-")) / f"{kind}-{hashlib.sha256(data).hexdigest()[:24]}"
    file.write_bytes(data)
    return ship(spark, str(file))


@cache
def tables_of(path: str) -> bytes:
    return library_tables(path)


def ship_vocabulary(spark: SparkSession, path: str) -> tuple[str, str]:
    """Send the vocabulary and the library's tables for it; the names to open them by."""
    return ship(spark, path), ship_bytes(spark, tables_of(path), "tables")


class Lexicon:
    """The compiled automaton: arrays in one file, mapped into memory.

    ``edge`` holds state * 256 + byte in order, ``to`` and ``skip`` where each leads and how many
    words come before; ``final`` marks states where a word ends; ``at`` and ``ids`` hold the output.
    """

    PARTS = (("edge", np.int64), ("to", np.int32), ("skip", np.int32), ("final", np.uint8), ("at", np.int32), ("ids", np.int32))

    def __init__(self, path: str):
        head = np.fromfile(path, np.int64, len(self.PARTS))
        offset = head.nbytes
        for (name, kind), n in zip(self.PARTS, head):
            empty = np.empty(0, kind)
            setattr(self, name, np.memmap(path, kind, "r", offset, (int(n),)) if n else empty)
            offset += int(n) * np.dtype(kind).itemsize

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> bytes:
        """The file for words and their ids: suffixes are shared as the sorted words come in."""
        states: list[dict[int, int]] = [{}]
        ends = [False]
        register: dict[tuple, int] = {}
        path, previous = [0], b""

        def close(depth: int) -> None:
            """Replace the states of the last word beyond ``depth`` by equal ones, if there are any."""
            while len(path) - 1 > depth:
                own = path.pop()
                key = (ends[own], *states[own].items())
                states[path[-1]][previous[len(path) - 1]] = register.setdefault(key, own)

        words = sorted(entries)
        for word in words:
            depth = len(os.path.commonprefix([previous, word]))
            close(depth)
            for byte in word[depth:]:
                states.append({})
                ends.append(False)
                states[path[-1]][byte] = len(states) - 1
                path.append(len(states) - 1)
            ends[path[-1]] = True
            previous = word
        close(0)
        number, order, below = {0: 0}, [0], {}
        for state in order:
            for to in states[state].values():
                if to not in number:
                    number[to] = len(order)
                    order.append(to)

        def count(root: int) -> int:
            """Words from a state on; an explicit stack, as words can be long."""
            stack = [root]
            while stack:
                s = stack[-1]
                missing = [t for t in states[s].values() if t not in below]
                if missing:
                    stack += missing
                else:
                    below[s] = ends[s] + sum(below[t] for t in states[s].values())
                    stack.pop()
            return below[root]

        count(0)
        edge, to, skip = [], [], []
        for state in order:
            passed = int(ends[state])
            for byte, target in sorted(states[state].items()):
                edge.append(number[state] * 256 + byte)
                to.append(number[target])
                skip.append(passed)
                passed += below[target]
        ids = [entries[w] for w in words]
        at = np.cumsum([0, *map(len, ids)])
        parts = [edge, to, skip, [ends[s] for s in order], at, [i for w in ids for i in w]]
        arrays = [np.asarray(x, kind) for x, (_, kind) in zip(parts, cls.PARTS)]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word (an array of binary), -1 for those it doesn't hold."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        out = np.full(len(words), -1, np.int64)
        live, length = np.arange(len(words)), np.diff(offsets)
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(live) and len(self.edge):
            over = length[live] == depth
            done = live[over]
            out[done] = np.where(self.final[state[done]] == 1, total[done], -1)
            live = live[~over]
            if not len(live):
                break
            key = state[live] * 256 + data[offsets[live] + depth]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            ok = self.edge[at] == key
            live, at = live[ok], at[ok]
            state[live], total[live] = self.to[at], total[live] + self.skip[at]
            depth += 1
        return out


@cache
def lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def slices(texts: pa.Array):
    """Lists of texts of about SLICE bytes together, or of one longer text."""
    own, size = [], 0
    for t in texts:
        own.append(t.as_py())
        size += len(own[-1])
        if size >= SLICE:
            yield own
            own, size = [], 0
    if own:
        yield own


class Memo(dict):
    """Words that a worker has merged, with their ids; emptied where both would be more than ``most`` bytes and ids."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.held = most, 0

    def keep(self, word: bytes, ids: list[int]) -> None:
        cost = len(word) + len(ids)
        if cost > self.most // 64:
            return
        if self.held + cost > self.most:
            self.clear()
            self.held = 0
        self[word] = ids
        self.held += cost


#: Kept from batch to batch.
MEMO = Memo()


def encode_texts(texts: list[str], vocab: Vocabulary, lex: Lexicon, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and where each text's end, from 0 on."""
    words, counts = vocab.words(texts)
    flat = words.dictionary_encode()
    distinct, at = flat.dictionary, flat.indices.to_numpy()
    number = lex.find(distinct)
    known = number >= 0
    size = np.zeros(len(number), np.int64)
    size[known] = lex.at[number[known] + 1] - lex.at[number[known]]
    extra: list[int] = []
    for i in np.flatnonzero(~known):
        word = distinct[i].as_py()
        own = memo.get(word)
        if own is None:
            own = vocab.merge(word.decode())
            memo.keep(word, own)
        size[i] = len(own)
        extra += own
    # The slice's own words and their ids only: the lexicon's pages stay where they are mapped.
    start = np.zeros(len(number), np.int64)
    held = np.cumsum(size[known])
    start[known] = held - size[known]
    start[~known] = np.cumsum(size[~known]) - size[~known] + (held[-1] if len(held) else 0)
    pool = np.r_[lex.ids[ragged(lex.at[number[known]], size[known])], np.asarray(extra, np.int32)].astype("<u4")
    ids = pool[ragged(start[at], size[at])]
    return ids, np.r_[0, np.cumsum(size[at])][np.cumsum(np.r_[0, counts])]


#: Bytes of a word of the lexicon at most, so that what comes to the driver is bounded; longer ones are merged.
LONGEST = 256


def frequent_words(docs: DataFrame, names: tuple[str, str], size: int) -> list[str]:
    """The most frequent words of all whole texts: whole classes of counts, ``size`` words at most."""

    def count(batches):
        vocab = vocabulary(*names)
        for batch in batches:
            for texts in slices(batch.column(0)):
                found = vocab.words(texts)[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

    ship_package(docs.sparkSession)
    words = docs.select(whole_text().alias("text")).mapInArrow(count, "word string, n long")
    words = words.filter(F.octet_length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words.filter("n > 1"))
    # Words fall into classes by the logarithm of their count, at most some hundreds; the rarest
    # class that still fits whole is the last one taken.
    grade = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    classes = words.groupBy(grade.alias("grade")).agg(F.count("*").alias("n")).collect()
    taken, last = 0, None
    for c in sorted(classes, key=lambda c: -c["grade"]):
        taken += c["n"]
        if taken > size:
            break
        last = c["grade"]
    return [] if last is None else [r["word"] for r in words.filter(grade >= last).select("word").collect()]


def build_lexicon(docs: DataFrame, path: str, size: int = 131_072) -> tuple[tuple[str, str], str]:
    """Compile the frequent words and send all files to all executors; the names to open them by.

    ``size`` bounds what comes to the driver. The lexicon's name holds the content's digest, so a
    lexicon is sent once.
    """
    spark = docs.sparkSession
    names = ship_vocabulary(spark, path)
    vocab = vocabulary(*names)
    words = frequent_words(docs, names, size)
    data = Lexicon.compile({w.encode(): vocab.merge(w) for w in words})
    return names, ship_bytes(spark, data, "lexicon")



def packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    edges = pa.py_buffer((ends * 4).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, edges, pa.py_buffer(ids)])


def spelled(ids: np.ndarray, ends: np.ndarray, vocab: Vocabulary) -> pa.Array:
    """The tokens of each text with a space between, special ones too.

    The vocabulary names no decoder, so its library joins tokens like that as well.
    """
    tokens = vocab.tokens.take(pa.array(ids))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), " ")


def by_slices(docs: DataFrame, returns: str, make) -> DataFrame:
    """doc_id and the columns that ``make`` has of a list of whole texts, a slice of rows at a time.

    A worker hands each slice's rows on before it takes the next, so it holds one slice's results.
    """

    def run(batches):
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                columns = [batch.column("doc_id").slice(at, len(texts)), *make(texts)]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)

    ship_package(docs.sparkSession)
    names = ["doc_id", *(c.split()[0] for c in returns.split(", "))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, {returns}")


def encode(docs: DataFrame, path: str, lexicon_size: int = 131_072) -> DataFrame:
    """doc_id and ids (packed little-endian unsigned 32-bit) of every whole text.

    ``path`` is the driver's; the file is sent to the executors. A null text is empty and an empty
    one has no ids. Rows are encoded one by one, so repeated rows repeat and a null doc_id stays
    null; an empty table gives no rows. A very long text is one slice: its worker holds its code
    points and ids, some 40 bytes a character.
    """
    names, lexicon_name = build_lexicon(docs, path, lexicon_size)

    def make(texts: list[str]) -> list[pa.Array]:
        return [packed(*encode_texts(texts, vocabulary(*names), lexicon(lexicon_name), MEMO))]

    return by_slices(docs, "ids binary", make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column decoded, the text that ``ids`` give; null ids give an empty one.

    Row by row, so repeated rows repeat and an empty table stays empty; a very long text is one row's work.
    """
    names = ship_vocabulary(encoded.sparkSession, path)

    @per_text("string")
    def run(ids: pa.Array) -> pa.Array:
        sizes = [len(x.as_py()) // 4 for x in ids]
        flat = np.frombuffer(b"".join(x.as_py() for x in ids), "<u4")
        return spelled(flat, np.cumsum([0, *sizes]), vocabulary(*names))

    return encoded.withColumn("decoded", run(F.coalesce("ids", F.lit(b""))))


def round_trip(docs: DataFrame, path: str, lexicon_size: int = 131_072) -> DataFrame:
    """doc_id, ids and decoded in one pass of one worker per task: ``decode`` of ``encode``.

    Nulls, empty and very long texts, repeated rows and an empty table are treated as by ``encode``.
    """
    names, lexicon_name = build_lexicon(docs, path, lexicon_size)

    def make(texts: list[str]) -> list[pa.Array]:
        vocab = vocabulary(*names)
        found = encode_texts(texts, vocab, lexicon(lexicon_name), MEMO)
        return [packed(*found), spelled(*found, vocab)]

    return by_slices(docs, "ids binary, decoded string", make)
