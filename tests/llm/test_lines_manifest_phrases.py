"""Line dedup, Merkle manifest and phrase mining against plain Python, and on odd input."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.llm import line_dedup, merkle, phrases, queries
from holdfast.llm.cuckoo import Cuckoo
from holdfast.llm.double_array import DoubleArray
from holdfast.llm.line_dedup import LineIndex
from holdfast.llm.tables import read_table
from tests.conftest import ROOT
from tests.llm.brute import ASCII_LOW
from tests.llm.test_corpus_operators import ODD, got, odd, want

H = lambda text: sha256(text.encode()).hexdigest()


# --------------------------------------------------------------------------- cuckoo filters
@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1) | st.sampled_from([0, 1, 1 << 48, 5]),
                max_size=300), st.data())
def test_cuckoo_filter_holds_what_was_put_in(keys, data):
    cut = data.draw(st.integers(0, len(keys)))
    keys = np.array(keys, "i8")
    held = Cuckoo()
    held.insert(keys)
    held.delete(keys[:cut])
    assert held.has(keys[cut:]).all()
    again = Cuckoo(held.to_bytes())
    assert sum(int((t > 0).sum()) for t in again.tables) == len(keys) - cut
    again.delete(keys[cut:])
    assert not any(t.any() for t in again.tables)


def test_cuckoo_filter_beyond_one_table():
    keys = np.random.default_rng(0).integers(-2**63, 2**63 - 1, 150_000, dtype="i8")
    held = Cuckoo()
    held.insert(keys)
    held.insert(np.full(40, 7, "i8"))  # more copies than two buckets hold
    assert held.has(keys).all() and len(held.tables) > 2
    held.delete(np.full(39, 7, "i8"))
    assert held.has(np.array([7])).all() and held.has(keys).all()
    strangers = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 100_000, dtype="i8")
    assert held.has(strangers).mean() < 1e-3


# ------------------------------------------------------------------------------- line dedup
def lines_kept(rows, held=None):
    """(doc_id, n_lines, n_dropped, text) by dictionaries; held: ids in the index."""
    key = lambda x: x.strip(" \t\n\v\f\r").translate(ASCII_LOW)
    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20 and (held is None or d in held):
                docs[key(x)].add(d)
    for d, t in rows:
        lines = (t or "").split("\n")
        mine = [x for x in lines if d is None or (held is not None and d not in held)
                or len(docs[key(x)]) < 3 or max(docs[key(x)]) == d]
        yield d, len(lines), len(lines) - len(mine), "\n".join(mine)


COMMON = "  A line of at least TWENTY characters\r"
LINES = [*ODD, (20, f"own\n{COMMON}\n{COMMON.lower()}\nend"), (21, COMMON.strip()),
         (21, COMMON.strip()), (22, "x\n" + COMMON + "\n"), (23, "é" * 19 + "\n" + "é" * 20),
         (24, "é" * 19 + "\n" + "É" * 20 + "\n" + "é" * 20), (25, "é" * 19 + "\n " + "é" * 20),
         (None, COMMON), (26, "short\n" * 50), (27, "short\n" * 50), (28, COMMON[1:])]
COLUMNS = ("doc_id", "n_lines", "n_dropped", "text")


@pytest.mark.parametrize("batches", [1, 3])
def test_lines_of_odd_rows(spark, tmp_path, batches):
    index = line_dedup.build(odd(spark, LINES), f"{tmp_path}/i", batches)
    assert got(index.deduplicate(odd(spark, LINES)), *COLUMNS) == want(lines_kept(LINES))
    none = line_dedup.build(odd(spark, []), f"{tmp_path}/e")
    assert none.deduplicate(odd(spark, [])).count() == 0
    none.delete(odd(spark, LINES))
    assert got(none.deduplicate(odd(spark, LINES)), "n_dropped") == [(0,)] * len(LINES)


def test_documents_can_be_taken_out_and_put_in_again(spark, tmp_path):
    every = {d for d, _ in LINES if d is not None}
    index = LineIndex(spark, f"{tmp_path}/i")
    index.insert(odd(spark, [r for r in LINES if r[0] in (20, 21, 23)]))
    index.insert(odd(spark, LINES))  # those that are held stay as they are
    index.delete(odd(spark, [(28, ""), (25, ""), (99, "")]))
    table = odd(spark, LINES)
    assert got(index.deduplicate(table), *COLUMNS) == want(lines_kept(LINES, every - {25, 28}))
    index = LineIndex.open(spark, f"{tmp_path}/i")
    held = {(r["hi"], r["lo"]) for r in index.keys().select("hi", "lo").collect()}
    assert len(held) == index.n_keys
    slots = sum(int((np.frombuffer(r["slots"], "u2") > 0).sum()) for r in index._filters().collect())
    assert slots == index.n_keys  # one fingerprint for each key that is held
    index.insert(odd(spark, [r for r in LINES if r[0] in (25, 28)]))
    assert got(index.deduplicate(table), *COLUMNS) == want(lines_kept(LINES))
    index.delete(table)
    assert index.n_keys == index.n_refs == 0 and index.keys().count() == 0


def test_filters_spare_unknown_keys_the_exact_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "CAPACITY", 20)  # shards have to double
    texts = ["\n".join(f"line number {k} of all the lines" for k in range(a, a + 400))
             for a in (0, 700, 350)]
    index = LineIndex(spark, f"{tmp_path}/i")
    index.insert(odd(spark, [(0, texts[0]), (1, texts[0])]))
    assert index.shards > line_dedup.LEAST_SHARDS
    touched = line_dedup.references(odd(spark, [(2, texts[2])])).select("hi", "lo")
    probed = {r["maybe"]: r["count"] for r in index._probe(touched).groupBy("maybe").count()
              .collect()}
    assert 50 <= probed[True] <= 52 and probed[False] == 400 - probed[True]
    rows = [(0, texts[0]), (1, texts[0]), (2, texts[2]), (3, texts[1])]
    index.insert(odd(spark, rows))
    assert got(index.deduplicate(odd(spark, rows)), *COLUMNS) == want(lines_kept(rows))


def test_lines_of_the_corpus(spark):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, ROOT, "documents").collect()]
    out = queries.op11_line_dedup(spark, ROOT)
    found = [(d, n, k, H(t)) for d, n, k, t in lines_kept(rows)]
    assert got(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want(found)


# --------------------------------------------------------------------------------- manifest
def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def level(nodes):
    return [H("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]


def proof(nodes, at):
    out = []
    while len(nodes) > 1:
        a = at - at % 16
        out.append((nodes[a:at], nodes[at + 1:a + 16]))
        nodes, at = level(nodes), at // 16
    return nodes[0], out


def manifest_rows(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> op12's columns, by plain lists."""
    trees = defaultdict(list)
    for r in rows:
        claim = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            claim = (*r[:4], r[4].translate(ASCII_LOW))
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(claim), r[0]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(trees[s]) for s in order}
    subroots = [proof([x[2] for x in trees[s]], 0)[0] for s in order]
    for k, s in enumerate(order):
        nodes = [x[2] for x in trees[s]]
        root, above = proof(subroots, k)
        for at, x in enumerate(trees[s]):
            path = proof(nodes, at)[1] + above
            folded = x[3]
            for left, right in path:
                folded = H("".join([*left, folded, *right]))
            beside = "".join("".join(a + b) for a, b in path)
            yield x[4], x[2], subroots[k], root, H(beside), folded, folded == root


PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_of_the_corpus(spark):
    rows = [tuple(r) for r in read_table(spark, ROOT, "documents").select(*merkle.FIELDS).collect()]
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    out = queries.op12_merkle_manifest(spark, ROOT)
    assert got(out, *PROOF) == want(manifest_rows(rows))
    assert out.where("NOT verified").count() > 0


@pytest.mark.parametrize("every", [1, 2, 3])
def test_manifest_of_odd_rows(spark, every):
    rows = [(d, [None, "", "é", "b"][k % 4], None if k % 3 else "de", k % 5 or None, t)
            for k, (d, t) in enumerate(ODD)]
    rows += [(k, "big", "en", 7, f"Text {k}") for k in range(600)] + [(3, "big", "en", 7, "A")] * 20
    rows += [(k, f"host{k}", None, 1, "X") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, "
                                     "text string").select("*", *[F.lit(0).alias(c) for c in (
                                         "node", "tree", "pos", "claim", "id", "row", "n")])

    def tampered(docs):
        hit = F.crc32(docs["doc_id"].cast("string")) % 5 == 0
        low = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.when(hit, merkle.leaf_hash([*[docs[c] for c in merkle.FIELDS[:4]], low]))

    assert got(merkle.verify(merkle.manifest(df, tampered, every=every)), *PROOF) == want(manifest_rows(rows))
    plain = merkle.verify(merkle.manifest(df, every=every))
    assert plain.where("verified").count() == len(rows)
    assert merkle.verify(merkle.manifest(df.limit(0))).count() == 0


# ---------------------------------------------------------------------------------- phrases
@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 299), st.integers(0, 299), st.integers(-1, 299)),
               min_size=1, max_size=120))
def test_double_array_holds_its_rows_only(rows):
    trie = DoubleArray.of(np.array(sorted(rows), "i8"), 300)
    prefixes = {r[:k] for r in rows for k in (1, 2, 3) if -1 not in r[:k]}
    for k in (1, 2, 3):
        asked = np.array(sorted({r[:k] for r in rows if -1 not in r[:k]} | {
            (5, 7, 9)[:k], (299, 0, 299)[:k]}), "i8")
        states, at = np.zeros(len(asked), "i8"), np.arange(len(asked))
        for c in range(k):
            states, kept = trie.step(states, asked[at, c])
            at = at[kept]
        assert {tuple(x) for x in asked[at].tolist()} == {
            tuple(x) for x in asked.tolist() if tuple(x) in prefixes}
        assert trie.spell(states, k).tolist() == asked[at].tolist()


def collocations(rows, least=10, top=2000, share=50):
    """Rows (lang, text) -> op13's columns, by dictionaries."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        out = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(
                    q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                    for q, b in found.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]],
                                  own[p[k:]]) for k in range(1, len(p)))
            out.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(out)[:top], 1):
            yield lang, rank, p.decode(), -a, l, r, n[lang], -s


MINED = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_phrases_of_the_corpus(spark):
    rows = [(r["lang"], r["text"]) for r in read_table(spark, ROOT, "documents").collect()]
    out = queries.op13_phrase_collocations(spark, ROOT)
    assert got(out, *MINED) == want(collocations(rows))


@pytest.mark.parametrize("chunk,per_trie,bits", [(1 << 20, 2_000_000, 26), (50, 300, 16)])
def test_phrases_of_odd_rows(spark, monkeypatch, chunk, per_trie, bits):
    monkeypatch.setattr(phrases, "MOST_COUNTERS", bits)
    monkeypatch.setattr(phrases, "TRIE_PHRASES", per_trie)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    words = [f"w{k}" for k in range(40)] + ["É", "\0", "漢字", "a-b"]
    draw = np.random.default_rng(2)
    rows = [(lang, "".join(str(words[min(int(k), 43)]) + str(s) for k, s in zip(
        draw.zipf(1.4, 600) - 1, draw.choice([" ", "\t ", ", ", "\n", "! "], 600,
                                             p=[.7, .1, .1, .05, .05]))))
            for lang in ("en", "de", None, "und", "") for _ in range(4)]
    rows += [("en", None), ("en", ""), ("de", " .. \n"), ("fr", "A a a a A a"), ("fr", "one two")]
    df = spark.createDataFrame([(r[0], r[1], 1, 2, 3) for r in rows],
                               "lang string, text string, word int, n int, f int")
    out = phrases.collocations(df, least=4, top=60)
    expected = want(collocations(rows, 4, 60))
    assert got(out, *MINED) == expected and ("fr", 1, "a a a", 4, 6, 5, 8, 533333) in expected
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.where("lang = 'fr'"), least=200).count() == 0


def test_phrases_take_as_many_passes_for_any_number_of_tries(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [("en", " ".join(f"w{k}" for k in draw.integers(0, 30, 400))) for _ in range(10)]
    df = spark.createDataFrame(rows, "lang string, text string")
    passes, plain = [], phrases.stage
    monkeypatch.setattr(phrases, "stage", lambda *a, **k: passes.append(a[1]) or plain(*a, **k))
    found = []
    for per_trie in (1_000_000, 20):  # over 300 candidates: 1 trie, 16 tries and more
        monkeypatch.setattr(phrases, "TRIE_PHRASES", per_trie)
        passes.append("|")
        found.append(got(phrases.collocations(df, least=3, top=500), *MINED))
    assert found[0] == found[1] == want(collocations(rows, 3, 500))
    assert " ".join(passes).split("|")[1].split() == " ".join(passes).split("|")[2].split()
