"""Phrase collocations: exact counts by sharded double-array tries of Apriori-safe candidates.

Method, per language:
1. Words and their counts, one grouped sum. Texts become runs of 64-bit word hashes, 0 between
   pieces; that no two words share a hash is checked, with another salt if two do.
2. Bounds. Two-word windows of words that occur often enough are summed by a 64-bit hash, each
   shard of the hash space in a task of its own. A pair occurs at most as often as its hash, so
   one below the least count is out for good. Those left make a filter of bits.
3. Windows whose words, for three words both of whose pairs, pass the filters go to the shard of
   their hash, the repeats within a block of windows as one row with their number.
4. In a shard, windows whose hash reaches the least count are the candidates; none that occurs
   often enough can be missing (Apriori). They are cut into double-array tries of at most
   TRIE_PHRASES by their first word; the shard's windows are walked through them all at once, word
   by word, and the accepting states reached are counted by bincount.
5. Cuts are scored on exact decimals, contained phrases dropped, the best of a language kept.

Scale: texts are read twice, their hashes two times, however many candidates there are. What moves
is one hash for each distinct pair of a block and one row for each distinct window that passes; a
frequent window is one row of a block, so no shard grows with it. The number of shards follows the
number of words. Filters have 16 bits for each entry, MOST_COUNTERS bits of address at most; far
beyond that they keep out less, which moves more windows but changes no result. Long texts are
split into chunks of CHUNK words that share two words with the next, so no task holds more.

Cases: a null or empty text has no words; a null language is `und`; a language without words or
candidates has no row; repeated rows count as often as they occur; ids play no part; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.double_array import DoubleArray
from holdfast.llm.tables import lower_ascii, small_batches
from holdfast.session import stage

BREAKS = ".,;:!?\n\x0b\x0c\r"
WORD_BREAK = r"[ \t.,;:!?\n\x0B\f\r]"
LEAST, TOP, KEEP_SHARE = 10, 2000, 50
CHUNK = 1 << 18  # words
TRIE_PHRASES = 120_000
BLOCK = 1 << 20  # windows a task sorts at once
SHARD_WORDS = 1 << 20  # words of the corpus for each shard of the hash space
LEAST_COUNTERS, MOST_COUNTERS = 16, 26  # bits
LANE_BITS = 16  # of an address within one row of a filter
MAX_KNOWN = 100_000  # words a worker remembers
PHRASE = ["h1", "h2", "h3"]

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + BREAKS.encode() + b"\t",
                        b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(BREAKS) + b" ")


# ------------------------------------------------------------------------------------- words
class _Hashes(dict):
    """Hash of each word met; the break between pieces is 0."""

    def __init__(self, salt: str):
        super().__init__({b"\n": 0})
        self.salt = salt.encode()

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(self.salt + word, 42)
        self[word] = value = value - (1 << 64) if value >> 63 else value
        return value


def _hash(word: Column, salt: str) -> Column:
    return F.xxhash64(F.concat(F.lit(salt), word))


def word_counts(docs: DataFrame, salt: str) -> DataFrame:
    """(lang, word, hash, f) over rows (lang, text)."""
    words = docs.select("lang", F.explode(F.split("text", WORD_BREAK)).alias("word")).where(
        "word <> ''")
    # few words have a capital; translating every text would cost more than all the rest
    low = F.when(F.col("word").rlike("[A-Z]"), lower_ascii(F.col("word"))).otherwise(F.col("word"))
    return words.select("lang", low.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f")).withColumn(
        "hash", _hash(F.col("word"), salt))


def _unambiguous(docs: DataFrame) -> tuple[str, DataFrame]:
    """A salt under which all words of a language differ in hash, and the words."""
    for n in range(8):
        words = stage(word_counts(docs, str(n)), "words")
        clash = words.groupBy("lang", "hash").count().where("count > 1 OR hash = 0")
        if clash.isEmpty():
            return str(n), words
    raise RuntimeError("no salt tells all words apart")


def _pieces(raw: bytes, size: int = 1 << 18) -> Iterator[bytes]:
    """A text in parts cut at white space or breaks, about `size` bytes each."""
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            near = [k for k in (raw.find(b" ", end), raw.find(b"\n", end)) if k >= 0]
            end = min(near, default=len(raw))
        yield raw[at:end]
        at = end


def word_runs(docs: DataFrame, salt: str) -> DataFrame:
    """(lang, n, words): chunks of word hashes as bytes, 0 between pieces. Phrases start at the
    first n of a chunk's words; the two after them belong to the next chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = _Hashes(salt), {}

        def flush(lang: str) -> pa.RecordBatch:
            flat = np.concatenate(held.pop(lang))
            starts = range(0, len(flat), CHUNK)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(starts)),
                 pa.array([min(CHUNK, len(flat) - a) for a in starts], pa.int64()),
                 pa.array([flat[a:a + CHUNK + 2].tobytes() for a in starts], pa.binary())],
                names=["lang", "n", "words"])

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(
                    pa.large_string()).cast(pa.large_binary()).to_pylist()):
                if len(known) > MAX_KNOWN:
                    known = _Hashes(salt)
                own = held.setdefault(lang, [])
                for part in _pieces(raw.translate(_FOLD)):
                    words = [w for w in part.replace(b"\n", b" \n ").split(b" ") if w]
                    own.append(np.fromiter(map(known.__getitem__, words), "i8", len(words)))
                own.append(np.zeros(1, "i8"))
                if sum(map(len, own)) >= CHUNK or len(own) > 20_000:
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    return docs.where("text IS NOT NULL").select("lang", "text").mapInArrow(
        run, "lang string, n long, words binary")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
    """(lang, n, words) of each row, one at a time and without a copy."""
    for lang, n, words in zip(*(batch.column(k) for k in range(3))):
        yield lang.as_py(), n.as_py(), np.frombuffer(words.as_buffer(), "i8")


def _word_keys(lang: str, words: np.ndarray) -> np.ndarray:
    x = (words.view("u8") ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))) * np.uint64(
        0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _pair_keys(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first.view("u8") ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))) * np.uint64(
        0x9E3779B97F4A7C15) + second.view("u8")
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _triple_keys(pairs: np.ndarray, third: np.ndarray) -> np.ndarray:
    x = ((pairs ^ (pairs >> np.uint64(32))) + third.view("u8")) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def _padded(own: np.ndarray, n: int) -> np.ndarray:
    """The n + 2 words from the start of a chunk."""
    words = np.zeros(n + 2, "i8")
    words[:len(own)] = own
    return words


# ------------------------------------------------------------------------------------ filters
@dataclass(frozen=True)
class Filter:
    """A bit for each address, the leading bits of a key."""
    packed: np.ndarray
    bits: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.packed[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype("u1")
                & 1).astype(bool)


def key_filter(keys: DataFrame) -> Filter:
    """The filter of the rows (key long): 16 bits for each of them, if MOST_COUNTERS allows."""
    bits = min(max(keys.count().bit_length() + 4, LEAST_COUNTERS), MOST_COUNTERS)
    within = min(bits, LANE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view("u8") >> np.uint64(64 - bits)
            lane = at >> np.uint64(within)
            for one in np.unique(lane).tolist():
                held = lanes.setdefault(one, np.zeros(1 << within, "u1"))
                held[at[lane == one] & np.uint64((1 << within) - 1)] = 1
        for one, held in lanes.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([one], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())],
                names=["lane", "values"])

    lane = F.shiftrightunsigned("key", 64 - bits + within) if bits > within else F.lit(0)
    out, size = np.zeros(1 << bits >> 3, "u1"), 1 << within >> 3
    for one, raw in keys.repartition(lane).mapInArrow(run, "lane long, values binary").collect():
        out[one * size:(one + 1) * size] = np.frombuffer(raw, "u1")
    return Filter(out, bits)


def word_filter(words: DataFrame) -> Filter:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                langs = batch.column(0).dictionary_encode()
                code, hashes = langs.indices.to_numpy(), batch.column(1).to_numpy()
                keys = np.zeros(batch.num_rows, "u8")
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    keys[code == k] = _word_keys(lang, hashes[code == k])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view("i8"))], names=["key"])

    return key_filter(stage(words.select("lang", "hash").mapInArrow(run, "key long"), "keys"))


# ------------------------------------------------------------------------------------- shards
def _edges(n_shards: int) -> np.ndarray:
    """The least key of each shard but the first."""
    return np.array([-(-(k << 32) // n_shards) << 32 for k in range(1, n_shards)], "u8")


def _dealt(keys: np.ndarray, n_shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys."""
    cuts = [0, *np.searchsorted(keys, _edges(n_shards)).tolist(), len(keys)]
    for shard, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            yield shard, a, b


def _sums(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(times[order].astype("i8"), starts)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(v.as_buffer(), kind)
                                                for v in column)])


def often_pairs(runs: DataFrame, words: Filter, n_shards: int, least: int) -> DataFrame:
    """(key) of the pair hashes that occur at least `least` times."""
    shared = runs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for lang, n, own in _chunks(batch):
                own = _padded(own, n)
                there = (own != 0) & shared.value.holds(_word_keys(lang, own))
                first = np.flatnonzero(there[:n] & there[1:n + 1])
                held.append(_pair_keys(lang, own[first], own[first + 1]))
                if sum(map(len, held)) >= BLOCK:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
        times = np.minimum(np.diff(np.append(starts, len(keys))), least).astype("u1")
        keys = keys[starts]
        rows = [(shard, keys[a:b].tobytes(), times[a:b].tobytes())
                for shard, a, b in _dealt(keys, n_shards)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()),
             *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]],
            names=["shard", "keys", "times"])

    def kept(rows: pa.Table) -> pa.Table:
        keys, times = _sums(_joined(rows["keys"], "u8"), _joined(rows["times"], "u1"))
        return pa.table([pa.array(keys[times >= least].view("i8"))], names=["key"])

    return runs.mapInArrow(run, "shard int, keys binary, times binary").groupBy(
        "shard").applyInArrow(kept, "key long")


def windows(runs: DataFrame, pairs: Filter, n_shards: int) -> DataFrame:
    """(shard, lang, length, words, times): distinct windows of a block whose pairs pass, with the
    number of times each occurs there."""
    shared = runs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for lang, n, own in _chunks(batch):
                own = _padded(own, n)
                at = np.flatnonzero((own[:-1] != 0) & (own[1:] != 0))
                two = _pair_keys(lang, own[at], own[at + 1])
                ok = shared.value.holds(two)
                at, two = at[ok], two[ok]
                there = np.zeros(n + 2, bool)
                there[at] = True
                two, at = two[at < n], at[at < n]
                held.setdefault((lang, 2), []).append((two, _rows(own, at, 2)))
                more = there[at + 1]
                at, two = at[more], two[more]
                held.setdefault((lang, 3), []).append((_triple_keys(two, own[at + 2]),
                                                       _rows(own, at, 3)))
                size += n
                if size >= BLOCK:
                    for kind, parts in held.items():
                        yield packed(*kind, parts)
                    held, size = {}, 0
        for kind, parts in held.items():
            yield packed(*kind, parts)

    def packed(lang: str, length: int, parts: list[tuple[np.ndarray, np.ndarray]],
               ) -> pa.RecordBatch:
        keys, rows = map(np.concatenate, zip(*parts))
        order = np.argsort(keys)
        keys, rows = keys[order], rows[order]
        # rows that differ but share a key may repeat; each repeat has its own number of times
        starts = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))[:len(rows)])
        times = np.diff(np.append(starts, len(rows))).astype("u4")
        keys, rows = keys[starts], rows[starts]
        out = [(shard, rows[a:b].tobytes(), times[a:b].tobytes())
               for shard, a, b in _dealt(keys, n_shards)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([lang] * len(out), pa.string()),
             pa.array([length] * len(out), pa.int32()),
             *[pa.array([r[k] for r in out], pa.binary()) for k in (1, 2)]],
            names=["shard", "lang", "length", "words", "times"])

    return runs.mapInArrow(
        run, "shard int, lang string, length int, words binary, times binary")


def _rows(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return np.stack([words[at + k] for k in range(length)], axis=1)


# --------------------------------------------------------------------------------------- tries
def _lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(b"\x00" + lang.encode()) >> 1


def _candidates(words: np.ndarray, keys: np.ndarray, times: np.ndarray, least: int,
                ) -> np.ndarray:
    """The distinct windows whose key occurs often enough."""
    found, sums = _sums(keys, times)
    often = found[sums >= least]
    if not len(often):
        return words[:0]
    near = np.minimum(np.searchsorted(often, keys), len(often) - 1)
    return np.unique(words[often[near] == keys], axis=0)


def count_in_tries(found: DataFrame, least: int) -> DataFrame:
    """(lang, h1, h2, h3, f) of the windows that occur at least `least` times. A shard is one
    group; it holds all rows of its windows."""
    def run(rows: pa.Table) -> pa.Table:
        langs, lengths = rows["lang"].to_pylist(), rows["length"].to_pylist()
        names = {_lang_hash(x): x for x in langs}
        words, keys, times = [], [], []
        for lang, length, raw, n in zip(langs, lengths, rows["words"], rows["times"]):
            own = np.frombuffer(raw.as_buffer(), "i8").reshape(-1, length)
            two = _pair_keys(lang, own[:, 0].copy(), own[:, 1].copy())
            keys.append(two if length == 2 else _triple_keys(two, own[:, 2].copy()))
            new = np.zeros((len(own), 4), "i8")
            new[:, 0], new[:, 1:1 + length] = _lang_hash(lang), own
            words.append(new)
            times.append(np.frombuffer(n.as_buffer(), "u4"))
        words, keys, times = map(np.concatenate, (words, keys, times))
        wanted = _candidates(words, keys, times, least)
        n_tries = -(-len(wanted) // TRIE_PHRASES)
        out, counts = [np.zeros((0, 4), "i8")], [np.zeros(0, "i8")]
        for turn in range(n_tries):
            phrases = wanted[_turn(wanted, n_tries) == turn]
            if len(phrases):
                mine = _turn(words, n_tries) == turn
                spelt, f = _counted(phrases, words[mine], times[mine])
                out.append(spelt[f >= least])
                counts.append(f[f >= least])
        out, counts = np.concatenate(out), np.concatenate(counts)
        return pa.table([pa.array([names[x] for x in out[:, 0].tolist()], pa.string()),
                         *[pa.array(np.ascontiguousarray(out[:, k])) for k in (1, 2, 3)],
                         pa.array(counts)], names=["lang", *PHRASE, "f"])

    return found.groupBy("shard").applyInArrow(
        run, "lang string, h1 long, h2 long, h3 long, f long")


def _turn(words: np.ndarray, n_tries: int) -> np.ndarray:
    """The trie of each row, by its first word."""
    return (words[:, 1].view("u8") >> np.uint64(20)) % np.uint64(n_tries)


def _counted(phrases: np.ndarray, words: np.ndarray, times: np.ndarray,
             ) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, f): the rows of `words` (language, h1, h2, h3 or 0) walked through the trie of
    `phrases`, all at once; the states in which they end are counted."""
    symbols = np.unique(phrases[phrases != 0])

    def number(values: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(symbols, values), len(symbols) - 1)
        return np.where(symbols[at] == values, at, -1)

    trie = DoubleArray.of(np.where(phrases == 0, -1, number(phrases)), len(symbols))
    total = np.zeros(len(trie.check), "i8")
    places, states = np.arange(len(words)), np.zeros(len(words), "i8")
    for column in range(4):
        numbers = number(words[places, column])
        there = numbers >= 0
        states, kept = trie.step(states[there], numbers[there])
        places = places[there][kept]
        if column > 1:
            ends = (words[places, 3] == 0) == (column == 2)
            at, n = _sums(states[ends], times[places[ends]])
            total[at] += n
    depths = _depths(trie)
    out, counts = [], []
    for length in (3, 4):
        at = np.flatnonzero((total > 0) & (depths == length))
        spelt = np.zeros((len(at), 4), "i8")
        spelt[:, :length] = symbols[trie.spell(at, length)]
        out.append(spelt)
        counts.append(total[at])
    return np.concatenate(out), np.concatenate(counts)


def _depths(trie: DoubleArray) -> np.ndarray:
    """Symbols on the way to each state (0 for states not in use)."""
    out = np.zeros(len(trie.check), "i4")
    states = up = np.flatnonzero(trie.check >= 0)
    while len(states):
        out[states] += 1
        up = trie.check[up]
        going = up > 0
        states, up = states[going], up[going]
    return out // trie.digits


# --------------------------------------------------------------------------------------- scores
def phrase_counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """words (lang, word, hash, f) and phrases (lang, h1, h2, h3, f) found at least `least` times;
    h3 is 0 for two words. least: 1 to 255."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"),
                       docs[text_col].cast("string").alias("text"))
    salt, words = _unambiguous(rows)
    runs = stage(word_runs(rows, salt), "runs")
    n = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    n_shards = max(16, -(-int(n) // SHARD_WORDS))
    pairs = stage(often_pairs(runs, word_filter(words.where(F.col("f") >= least)), n_shards,
                              least), "pairs")
    found = windows(runs, key_filter(pairs), n_shards)
    return words, stage(count_in_tries(found, least), "counted")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP,
                 keep_share: int = KEEP_SHARE, lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to 3 words."""
    words, phrases = phrase_counts(docs, least, lang_col, text_col)
    often = stage(words.where(F.col("f") >= least), "often")
    pairs, triples = phrases.where("h3 = 0"), phrases.where("h3 <> 0")

    def with_word(df: DataFrame, k: int) -> DataFrame:
        return df.join(often.select("lang", F.col("hash").alias(f"h{k}"),
                                    F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}")),
                       ["lang", f"h{k}"])

    def with_pair(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.join(pairs.select("lang", F.col("h1").alias(f"h{a}"), F.col("h2").alias(f"h{b}"),
                                    F.col("f").alias(f"f{a}{b}")), ["lang", f"h{a}", f"h{b}"])

    def score(left: str, right: str) -> Column:
        a, x, y = (F.col(c).cast("decimal(15,0)") for c in ("f", left, right))
        million = F.lit(1_000_000).cast("decimal(7,0)")
        return F.call_function("div", million * (a * a), x * y)

    held = triples.select("lang", "h1", "h2", "f").unionByName(
        triples.select("lang", F.col("h2").alias("h1"), F.col("h3").alias("h2"), "f")).groupBy(
        "lang", "h1", "h2").agg(F.max("f").alias("longer"))
    free = pairs.join(held, ["lang", "h1", "h2"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < keep_share * F.col("f")))
    two = with_word(with_word(free, 1), 2).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"),
        F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score"))
    three = with_pair(with_pair(triples, 1, 2), 2, 3)
    for k in (1, 2, 3):
        three = with_word(three, k)
    cuts = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.array_min(
        F.array(*[F.struct(score(x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"),
                           F.col(y).alias("r")) for k, (x, y) in enumerate(
                               (("f1", "f23"), ("f12", "f3")))])).alias("cut"),
        F.col("f").alias("a"))
    scored = two.unionByName(cuts.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"),
                                            "phrase", "a", "l", "r", "n", "score")
