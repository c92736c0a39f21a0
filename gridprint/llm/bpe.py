"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

A first pass counts words over all rows; the most frequent ones are encoded once
and compiled into an automaton that shares prefixes and suffixes. Each state
knows how many words pass before an edge, so the walk of a word gives its number,
and the number gives its ids. The automaton is broadcast as bytes (bounded by
max_words), written to a file by each worker, memory-mapped and unlinked. Words
that it lacks are merged exactly, with a heap.

Defined cases: null text counts as empty and gives no ids and an empty decoding;
texts of any length are encoded whole; special tokens that stand in a text
become their ids, as the library does by default.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprint.llm.common import KEPT, by_size, drop_kept, most_frequent, ship, sparing

#: Fixed value: the word pattern of the tokenizer file that the shorter one below stands in for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of ASCII and Latin letters only are composed already, and for them this finds the same words faster.
COMMON = re.compile("[\0-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*+\\Z").match
COMMON_WORDS = re.compile("[a-z\xdf-\xf6\xf8-\u017f]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9\xdf-\xf6\xf8-\u017f]+").findall
MAX_WORDS = 60_000
MIN_COUNT = 3
MEMO = 150_000
#: Words that are merged together; the rank of what doesn't merge, which leaves room for a place beside it.
TOGETHER, NONE = 16_384, 1 << 50


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: printable ones for themselves, others from code point 256 up."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _lists(flat, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.uint32()))


class Merges:
    """Vocabulary and merge ranks of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names: pa.Array | None = None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        letters = byte_letters()
        self.inner = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.end) for c in letters]
        self.rank = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.vocab[a], self.vocab[b]] = (r, self.vocab[a + b])
        # the same as arrays: sorted pairs and their ranks, and what each rank makes
        order = sorted((a << 32 | b, r) for (a, b), (r, _) in self.rank.items())
        self.pairs, self.ranks = (np.array([x[k] for x in order] or [0], np.int64) for k in (0, 1))
        self.made = np.zeros(len(model["merges"]) + 1, np.int64)
        for r, new in self.rank.values():
            self.made[r] = new

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE for those that don't merge; ids under 0 are no ids."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0) & bool(self.rank), self.ranks[at], NONE)

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the lowest rank first, leftmost among equals."""
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        ids = [*[inner[b] for b in raw[:-1]], self.last[raw[-1]]]
        if len(ids) > 40:
            return self.merge_long(ids)
        get, none = self.rank.get, (1 << 60, -1)
        found = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def merge_all(self, words: list[str]) -> pa.ListArray:
        """merge() of each word. Words of up to 40 bytes take a step together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        parts, order, low = [_lists([], [])], [], 0
        for high in (8, 16, 40):
            own = np.flatnonzero((size > low) & (size <= high)) if None not in self.inner + self.last else size[:0]
            for at in range(0, len(own), TOGETHER):
                order.append(own[at : at + TOGETHER])
                parts.append(self.merge_together([raw[i] for i in order[-1]], size[order[-1]], high))
            low = high
        rest = np.setdiff1d(np.arange(len(raw)), np.concatenate([*order, size[:0]]))
        alone = [self.merge(words[i]) for i in rest]
        parts.append(_lists([i for x in alone for i in x], [len(x) for x in alone]))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate([*order, rest]))))

    def merge_together(self, raw: list[bytes], size: np.ndarray, high: int) -> pa.ListArray:
        """Words of up to `high` bytes, one a column: each round merges the lowest rank of every word, leftmost among equals."""
        n = len(raw)
        data = np.zeros((n, high), np.uint8)
        data[np.arange(high) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        # a row more, where what lies before the first and after the last letter is looked up
        ids = np.full((high + 1, n), -1, np.int64)
        ids[:high] = np.where(np.arange(high)[:, None] < size, np.array(self.inner)[data.T], -1)
        ids[size - 1, np.arange(n)] = np.array(self.last)[data[np.arange(n), size - 1]]
        following = np.repeat(np.arange(1, high + 2)[:, None], n, 1)
        following[size - 1, np.arange(n)] = high
        previous = np.repeat(np.arange(-1, high)[:, None], n, 1)
        previous[0] = high
        place = np.arange(high + 1)[:, None]
        found = np.full((high + 1, n), NONE)
        found[: high - 1] = self.ranked(ids[: high - 1], ids[1:high]) << 6 | place[: high - 1]
        done, word = np.zeros((n, high), np.int32), np.arange(n)

        while len(word):
            best = found[:high].min(0)
            go = best < NONE
            if 2 * go.sum() <= len(go):
                done[word[~go]] = ids[:high, ~go].T
                ids, following, previous, found, word, best = ids[:, go], following[:, go], previous[:, go], found[:, go], word[go], best[go]
                go = go[go]
            c = np.flatnonzero(go)
            i, new = best[c] & 63, self.made[best[c] >> 6]
            j = following[i, c]
            k, h = following[j, c], previous[i, c]
            ids[i, c], ids[j, c], found[j, c] = new, -1, NONE
            following[i, c], previous[k, c] = k, i
            found[i, c] = self.ranked(new, ids[k, c]) << 6 | i
            found[h, c] = self.ranked(ids[h, c], new) << 6 | h
        return _lists(done[done >= 0], (done >= 0).sum(1))

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap."""
        n, rank = len(ids), self.rank
        following, previous = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*rank[p], i) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in rank]
        heap = [(r, i, ids[i], ids[i + 1], new) for r, new, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = following[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, -1
            following[i] = k = following[j]
            if k >= 0:
                previous[k] = i
                if (p := (new, ids[k])) in rank:
                    heapq.heappush(heap, (rank[p][0], i, *p, rank[p][1]))
            if (h := previous[i]) >= 0 and (p := (ids[h], new)) in rank:
                heapq.heappush(heap, (rank[p][0], h, *p, rank[p][1]))
        return [x for x in ids if x >= 0]

    def tokens(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list, joined by spaces."""
        if self.names is None:
            self.names = pa.array([self.token.get(i, "") for i in range(max(self.token) + 1)], pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values)), " ")


#: Code points that `regex` may class as letters or numbers and the library, which knows Unicode 16, does not.
LATE = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb "
    "11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
    "1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff "
    "2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)


#: Capitals of Unicode 16 and 17 and their small letters, which the library has and `str.lower` may not.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
CAPITAL = re.compile(f"[{''.join(map(chr, CAPITALS))}]").search


def late_class() -> str:
    """LATE as the inside of a character class."""
    return "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATE.split())


class Splitter:
    """Text to words as the tokenizer file has it: special tokens apart, composed, lower case by character."""

    def __init__(self, pattern: str, special: dict[str, int]):
        self.words = regex.compile(pattern).findall
        late = late_class()
        self.late = re.compile(f"[{late}]").search
        without = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{late}]]").replace(r"[\p{L}]", rf"[\p{{L}}--[{late}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{late}]]")
        self.careful = regex.compile(without, regex.V1).findall
        self.fast = pattern == PATTERN
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        """Words; a special token comes as itself with a null character before it."""
        if self.cut and "<|" in text:
            out = []
            for k, part in enumerate(self.cut.split(text)):
                out += ["\0" + part] if k % 2 else self.plain(part)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if self.fast and COMMON(text):
            return COMMON_WORDS(text.lower())
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if CAPITAL(text):
                text = text.translate(CAPITALS)
            if self.late(text):
                return self.careful(text.lower())
        return self.words(text.lower())


class Lexicon:
    """Minimal acyclic automaton of words; a word's number indexes its ids."""

    def __init__(self, edges: np.ndarray, goto: np.ndarray, skip: np.ndarray, final: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.edges, self.goto, self.skip, self.final, self.offsets, self.ids = edges, goto, skip, final, offsets, ids

    @classmethod
    def build(cls, words: dict[str, list[int]]) -> Lexicon:
        """Add words in byte order; states that can't change any more are shared if equal."""
        known: dict[tuple, int] = {}
        states: list[tuple[bool, list[tuple[int, int]]]] = []
        path: list[list] = [[False, []]]  # open states of the last word: [final, edges]
        before = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, tuple(edges))
                if key not in known:
                    known[key] = len(states)
                    states.append((final, edges))
                path[-1][1][-1] = (path[-1][1][-1][0], known[key])

        order = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in words.items())
        for word, _ in order:
            same = next((i for i, (a, b) in enumerate(zip(before, word, strict=False)) if a != b), min(len(before), len(word)))
            close(same)
            for b in word[same:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            before = word
        close(0)
        states.append((path[0][0], path[0][1]))
        count = [0] * len(states)  # words from a state on; children come first
        edges, goto, skip = [], [], []
        for s, (final, out) in enumerate(states):
            passed = int(final)
            for b, to in out:
                edges.append(s << 8 | b)
                goto.append(to)
                skip.append(passed)
                passed += count[to]
            count[s] = passed
        at = np.argsort(np.array(edges, np.int64), kind="stable")
        offsets = np.concatenate([[0], np.cumsum([len(ids) for _, ids in order])]) if order else np.zeros(1)
        flat = [i for _, ids in order for i in ids]
        return cls(np.array(edges, np.int64)[at], np.array(goto, np.int64)[at], np.array(skip, np.int64)[at], np.array([f for f, _ in states], np.int64), offsets.astype(np.int64), np.array(flat, np.int64))

    def dump(self) -> bytes:
        parts = [self.edges, self.goto, self.skip, self.final, self.offsets, self.ids]
        return np.concatenate([np.array([len(p) for p in parts], np.int64), *parts]).tobytes()

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Write the bytes to a file of this worker, map it, and unlink it."""
        with tempfile.NamedTemporaryFile() as f:
            f.write(data)
            f.flush()
            whole = np.memmap(f.name, np.int64, "r")
        ends = np.cumsum(np.concatenate([[6], whole[:6]]))
        return cls(*(whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)))

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """Ids of each word, None if it isn't here."""
        return [self.ids[self.offsets[n] : self.offsets[n + 1]].tolist() if n >= 0 else None for n in self.numbers(words).tolist()]

    def lists(self, numbers: np.ndarray) -> pa.ListArray:
        """Ids of the words of these numbers."""
        return _lists(self.ids, np.diff(self.offsets)).take(pa.array(numbers))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 if it isn't here. All words take a step at a time."""
        out = np.full(len(words), -1)
        size, longest = np.array([len(w) for w in words], np.int64), 64
        live = np.flatnonzero(size <= longest)
        if not len(live) or not len(self.edges):
            return out
        flat = np.frombuffer(b"".join([words[i] for i in live]), np.uint8).astype(np.int64)
        size = size[live]
        begin = np.cumsum(size) - size
        state, number = np.full(len(live), len(self.final) - 1), np.zeros(len(live), np.int64)
        edges, goto, skip = self.edges, self.goto, self.skip
        for step in range(longest + 1):
            ended = size == step
            out[live[ended]] = np.where(self.final[state[ended]] > 0, number[ended], -1)
            keep = ~ended
            live, size, begin, state, number = (x[keep] for x in (live, size, begin, state, number))
            if not len(live):
                break
            key = state << 8 | flat[begin + step]
            at = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
            ok = edges[at] == key
            live, size, begin, at, number = (x[ok] for x in (live, size, begin, at, number))
            state, number = goto[at], number + skip[at]
        return out


class Encoder:
    """Words to ids: a dictionary of numbers in front of the automaton, merging behind it, and tables by number."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon, self.split = merges, lexicon, Splitter(merges.pattern, merges.special)
        self.number: dict[str, int] = {}
        self.stay = np.zeros(0, bool)
        self.packed, self.tokens = pa.array([], pa.binary()), pa.array([], pa.string())

    def learn(self, words: set[str]) -> None:
        """Put words that the tables lack into them."""
        special = {"\0" + t: i for t, i in self.merges.special.items()}
        marked = [w for w in words if w in special]
        plain = list(words.difference(marked))
        at = self.lexicon.numbers([w.encode("utf-8", "surrogatepass") for w in plain]) if self.lexicon is not None else np.full(len(plain), -1)
        known, rare = np.flatnonzero(at >= 0), [plain[i] for i in np.flatnonzero(at < 0)]
        parts = [_lists([special[w] for w in marked], [1] * len(marked)), self.merges.merge_all(rare)]
        if len(known):
            parts.insert(0, self.lexicon.lists(at[known]))
        ids = pa.concat_arrays(parts)
        ends = 4 * ids.offsets.to_numpy()
        packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.values.to_numpy().astype("<u4"))])
        for word in itertools.chain((plain[i] for i in known), marked, rare):
            self.number[word] = len(self.number)
        self.stay = np.append(self.stay, np.arange(len(ids)) < len(known))
        self.packed, self.tokens = pa.concat_arrays([self.packed, packed]), pa.concat_arrays([self.tokens, self.merges.tokens(ids)])

    def forget(self) -> None:
        """Words of the automaton stay, of which there are few and which come again; the others go."""
        self.number = {w: i for i, w in enumerate(itertools.compress(self.number, self.stay.tolist()))}
        kept = pa.array(self.stay)
        self.packed, self.tokens = self.packed.filter(kept), self.tokens.filter(kept)
        self.stay = self.stay[self.stay]

    def arrays(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        """(ids as little-endian bytes, tokens joined by spaces) of each text."""
        words = [self.split(t or "") for t in texts]
        every = set().union(*words)
        missing = every.difference(self.number)
        if len(self.number) + len(missing) > MEMO and not self.stay.all():
            self.forget()
            missing = every.difference(self.number)
        self.learn(missing)
        ends = np.cumsum([0, *map(len, words)])
        flat = pa.array(np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(words)), np.int32, ends[-1]))
        offsets = pa.array(ends, pa.int32())
        return tuple(pc.binary_join(pa.ListArray.from_arrays(offsets, table.take(flat)), pa.scalar(between, table.type)) for table, between in ((self.packed, b""), (self.tokens, " ")))

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """arrays() as lists."""
        ids, tokens = self.arrays(texts)
        return ids.to_pylist(), tokens.to_pylist()


def encoder(path: str, data: bytes) -> Encoder:
    """The encoder of this worker, kept from task to task."""
    key = "encoder", path, hash(data)
    if key not in KEPT:
        drop_kept()
        KEPT[key] = Encoder(Merges(path), Lexicon.mapped(data))
    return KEPT[key]


def count_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(path)
        split, held = Splitter(merges.pattern, merges.special), Counter()

        def out():
            got = [(w, n) for w, n in held.items() if len(w) < 64 and "\0" not in w]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(split(text or ""))
                if len(held) > MEMO:
                    yield out()
        yield out()

    return run


def frequent_words(docs: DataFrame, path: str, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> list[str]:
    """The most frequent words of all rows, at most max_words, all of a frequency class or none."""
    ship(docs.sparkSession)
    counts = docs.select("text").mapInArrow(sparing(count_words(path)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(r["word"] for r in most_frequent(counts.where(F.col("n") >= min_count), max_words).collect())


def encode(docs: DataFrame, path: str, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit), decoded, per row of docs."""
    spark = docs.sparkSession
    ship(spark)
    merges = Merges(path)
    words = frequent_words(docs, path, max_words)
    lexicon = Lexicon.build(dict(zip(words, merges.merge_all(words).to_pylist(), strict=True)))
    data = spark.sparkContext.broadcast(lexicon.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, data.value)
        for batch in batches:
            for part in by_size(batch, 1, 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), *own.arrays(part.column(1).to_pylist())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sparing(run, keep=True), f"doc_id {kind}, ids binary, decoded string")


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The digest columns of encode()'s rows."""
    return encoded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), *["ids"] * keep_ids, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
