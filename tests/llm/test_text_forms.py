"""Fill-in-the-middle, the BPE transducer and periodic runs against plain Python and the libraries they stand for."""

import hashlib
import random
import re
import sys
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SF  # noqa: E402

from offerloom.llm import fill_middle, periodic_runs, registry, transducer  # noqa: E402

SCHEMA = "doc_id long, text string, form string, n long, ids string, runs string, h string, w string, output string"
LONG = "\n".join(" ".join(f"w{i % 977}x{i % 31}" for i in range(k, k + 50)) for k in range(0, 30_000, 50))
TEXTS = [
    None, "", "\n", "\n\n", "one", "one\n", "a\nb\nc", "a\nb\nc\n", "with <P> in it\nand more", "<S>", "x<M>", "<\nP>\n<", "été\n你好 😀\nfin", LONG, "a " * 5000, "x" * 5000,
    " \t\n", "a b a b a b a b", "a a a a a", "a a a a a a", "q a b c a b c a b c a b c z z z z z z z", "tab\tand\x0bvertical\x0cfeed\r\nend", "nul\x00 inside\n\x00",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(3, TEXTS[3]), (None, "no\nid\nat all"), (None, None)]
    return spark.createDataFrame([(*r, "f", 1, "i", "r", "h", "w", "o") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_rows(df, *keys):
    return sorted((r.asDict(True) for r in df.collect()), key=lambda r: [(r[k] is not None, r[k]) for k in keys])


# 11


def plain_fim(doc_id, text, percent=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, x = len(units), sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < 50 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_plain(docs, empty):
    for percent in (100, 40, 0):
        got = fill_middle.fill_in_middle(docs, percent=percent).withColumn("back", fill_middle.restored())
        want = sorted((plain_fim(r.doc_id, r.text, percent) + (r.text or "",) for r in docs.collect()), key=repr)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert fill_middle.fill_in_middle(empty).count() == 0


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_fill_middle_is_undone_in_any_unit(docs, unit):
    markers = ("[[pre]]", "[[suf]]", "[[mid]]")
    got = fill_middle.fill_in_middle(docs, unit, 100, 50, markers, 3).withColumn("back", fill_middle.restored(markers=markers))
    assert sorted(r.back for r in got.collect()) == sorted(r.text or "" for r in docs.collect())
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


@given(st.text("ab \n\té😀", max_size=40))
def test_boundaries(text):
    codes = fill_middle.codes_of(text)
    for unit, pattern in (("line", r"[^\n]*\n|[^\n]+"), ("word", r"\A[ \t\n]+|[^ \t\n]+[ \t\n]*"), ("char", r"(?s).")):
        at = fill_middle.boundaries(codes, unit)
        assert [text[i:j] for i, j in zip(at, at[1:])] == re.findall(pattern, text)


def test_markers_that_overlap_are_refused():
    for bad in (("a", "b"), ("aba", "x", "y"), ("ab", "bc", "z"), ("a", "xay", "z"), ("", "b", "c"), ("m", "m", "n")):
        with pytest.raises(ValueError):
            fill_middle.check_markers(bad)
    fill_middle.check_markers(fill_middle.MARKERS)


# 12


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    own = transducer.coder()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})


def test_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in registry.QUERIES["op12_bpe_transducer"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        assert tuple(got[d.doc_id]) == (d.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(d.text or "")), d.doc_id


def test_odd_texts(docs, empty, library):
    encoded = transducer.encode(docs)
    got = sorted(((r.doc_id is None, r.doc_id, r.decoded, r.ids) for r in transducer.decode(encoded).collect()), key=repr)
    assert got == sorted(((r.doc_id is None, r.doc_id, r.text or "", library.encode_ordinary(r.text or "")) for r in docs.collect()), key=repr)
    assert transducer.decode(transducer.encode(empty)).count() == 0


PIECES = st.one_of(st.text("ab", max_size=60), st.text("  \n\t x0", max_size=40), st.text("ntiohesr ", max_size=60), st.text("'stremvld ", max_size=30), st.text(max_size=30), st.text("ᲉꟋ՘\U00016d40\U0003fc3d a1", max_size=12))


@settings(max_examples=600, deadline=None)
@given(PIECES)
def test_ids_equal_library(library, text):
    own = transducer.coder()
    ids = own.ids(text).tolist()
    assert ids == library.encode_ordinary(text)
    assert "".join(transducer.decoder().stream(ids)) == text


def test_pairs_stay_as_merging_says():
    machine, rng = transducer.coder().transducer, random.Random(7)
    tokens = list(machine.tokens)
    short = [t for t in tokens if len(machine.tokens[t]) < 4]
    for _ in range(20_000):
        a, b = (rng.choice(short if rng.random() < 0.6 else tokens) for _ in "ab")
        parts = [machine.tokens[a], machine.tokens[b]]
        assert machine.joined(a, b) == (transducer.merged(b"".join(parts), machine.ranks) == parts)


def test_lookahead_is_bounded_and_tables_may_overflow(library, monkeypatch):
    monkeypatch.setattr(transducer, "STATES_KEPT", 50)
    monkeypatch.setattr(transducer, "JOINS_KEPT", 20)
    monkeypatch.setattr(transducer, "PIECES_KEPT", 5)
    own = transducer.Coder(transducer.ranks_path(), transducer.coder().pattern.pattern)
    for text in (LONG[:20_000], "a" * 20_000, " " * 5_000, "=" * 5_000, "abcdefghij" * 2_000):
        assert own.ids(text).tolist() == library.encode_ordinary(text)
    assert own.transducer.held < 20 and len(own.transducer.states) <= 51
    taken, stream = 0, own.transducer.stream(iter_counting := iter(b"internationalization" * 50))
    for _ in stream:
        taken += 1
        if taken == 20:
            break
    assert len(list(iter_counting)) > 700  # tokens came long before the piece had ended


def test_own_small_vocabulary():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"cd": 258, b"aa": 259, b"aab": 260}
    machine = transducer.Transducer(ranks)
    rng = random.Random(1)
    for _ in range(3000):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 14)))
        assert machine.run(piece) == [ranks[p] for p in transducer.merged(piece, ranks)] == list(machine.stream(piece))
    with pytest.raises(ValueError):
        transducer.Transducer({b"a": 0})


@given(st.binary(max_size=40), st.randoms())
def test_utf8_machine(data, rng):
    tokens, at = {}, 0
    while at < len(data):
        n = rng.randint(1, 5)
        tokens[len(tokens)] = data[at : at + n]
        at += n
    assert "".join(transducer.Decoder(tokens).stream(range(len(tokens)))) == data.decode("utf-8", "replace")


# 13


def brute_runs(words, least=6, times=4):
    """Every stretch by every period, kept if no smaller period holds in it."""
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            part = words[i : i + length]
            if length >= max(least, times * p) and all(part[q:] != part[:-q] for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 12000 OR text IS NULL")
    got = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(docs)))
    assert sorted(map(tuple, got.collect())) == sorted(brute_digest(r.doc_id, r.text) for r in docs.collect())
    whole = registry.QUERIES["op13_periodic_runs"](spark, SF)
    assert whole.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert whole.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and got.exceptAll(whole).count() == 0


def test_odd_runs(docs, empty):
    short = docs.filter("length(text) < 12000 OR text IS NULL")
    got = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(short)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(brute_digest(r.doc_id, r.text)) for r in short.collect())
    assert periodic_runs.periodic_runs(periodic_runs.planted(empty)).count() == 0
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert found[14].strongest.asDict() == {"start": 0, "length": 5000, "period": 1} and found[14].collapsed == "a"
    assert found[18].runs == [] and found[18].strongest is None and found[19].collapsed == "a"
    assert [tuple(r) for r in found[20].runs] == [(1, 12, 3), (13, 7, 1)] and found[20].collapsed == "q a b c z"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(0, 69), st.integers(1, 20), st.integers(0, 70), st.booleans())
def test_runs(words, start, period, length, small):
    for i in range(start + period, min(start + length, len(words))):
        words[i] = words[i - period]
    before = periodic_runs.PRIME
    try:
        periodic_runs.PRIME = 10_007 if small else before  # with a small prime hashes collide now and then
        periodic_runs._powers.cache_clear()
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(words, np.int64)).tolist()] == brute_runs(words)
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(words, np.int64), 3, 3).tolist()] == brute_runs(words, 3, 3)
    finally:
        periodic_runs.PRIME = before
        periodic_runs._powers.cache_clear()


def test_grid_in_several_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 16)
    rng = random.Random(4)
    for _ in range(60):
        n, p = rng.randint(20, 120), rng.randint(1, 12)
        words = [rng.randrange(4) for _ in range(n)]
        for i in range(rng.randrange(n) + p, n):
            words[i] = words[i - p]
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(words)).tolist()] == brute_runs(words)


def test_strongest_by_exact_quotient():
    runs = np.array([(5, 9, 2), (0, 4, 1), (9, 9, 2), (2, 45, 10)])
    assert periodic_runs.strongest(runs) == [2, 45, 10]
    assert periodic_runs.strongest(runs[:0]) is None
