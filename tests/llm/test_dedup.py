"""Line, passage and suffix dedup, and SimHash, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tidemark.llm import lines, recompression, simhash, suffixes
from tidemark.llm.graph import connected_components


def test_lines(documents, rows):
    got = lines.drop_repeated_lines(documents(rows)).collect()
    want = brute.lines([(r[0], r[1]) for r in rows])
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got) == sorted(want)
    assert [r.text for r in got if r.doc_id == 1000] == [None]


def test_lines_odd_rows(odd_documents):
    got = lines.drop_repeated_lines(odd_documents)
    assert got.columns.count("n_lines") == 1 and "a.b" in got.columns
    assert got.count() == 9 and got.agg({"n_dropped": "sum"}).first()[0] == 0


def test_lines_count_repeated_rows_once(spark):
    line = "a line that is long enough"
    df = spark.createDataFrame(
        [(1, line), (1, line), (2, line.upper()), (None, line)], "doc_id bigint, text string"
    )
    assert lines.drop_repeated_lines(df).agg({"n_dropped": "sum"}).first()[0] == 0
    got = lines.drop_repeated_lines(df.union(df.selectExpr("doc_id + 2", "text"))).collect()
    left = [(r.doc_id, r.text) for r in got if r.text]
    assert sorted(left, key=str) == [(4, line.upper()), (None, line), (None, line)]


def test_passages(documents, rows):
    got = recompression.drop_repeated_passages(documents(rows)).collect()
    want = brute.passages([r[1] for r in rows])
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(
        (r[0], *w) for r, w in zip(rows, want)
    )
    assert sum(w[1] for w in want) > 1000


def test_passages_odd_rows(odd_documents):
    texts = [r.text for r in odd_documents.collect()]
    got = recompression.drop_repeated_passages(odd_documents)
    assert got.columns.count("n_words") == 1
    want = brute.passages(texts)
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_anchors_depend_on_the_window_alone(seed):
    """Every window of equal words has the same anchor row name, wherever it is."""
    rng = random.Random(seed)
    words = np.array([rng.getrandbits(64) for _ in range(4 if seed < 2 else 40)], np.uint64)
    docs = [[rng.randrange(len(words)) for _ in range(rng.randint(0, 200))] for _ in range(20)]
    docs += [d[rng.randint(0, 30):] + docs[0][:50] for d in docs[:10]] + [[1] * 90, [1, 2] * 60]
    lengths = np.array([len(d) for d in docs])
    tokens = words[np.concatenate([np.array(d, int) for d in docs])]
    window, names = 12, {}
    for document, start, n, name, _ in zip(*recompression.anchors(tokens, lengths, window)):
        for at in range(start, start + n):
            key = tuple(docs[document][at : at + window])
            assert names.setdefault(key, name) == name
    assert len(names) > 100


def test_suffixes(documents, rows):
    got = suffixes.drop_earlier_passages(documents(rows)).collect()
    want = brute.suffixes([(r[0], r[1]) for r in rows])
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    assert found == want
    assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 for r in got)


def test_suffixes_in_parts(documents, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, text, "", "", 0), (2, text[700:2500] + "x" * 400, "", "", 0)]
    monkeypatch.setattr(suffixes, "PART", 256)
    found = [x for part in suffixes.entries([r[1].encode() for r in rows], 100) for x in zip(*part)]
    covered = sorted((d, s + i) for d, s, n, *_ in found for i in range(n))
    assert covered == [(d, i) for d in (0, 1) for i in range(len(rows[d][1]) - 99)]
    got = {r.doc_id: r.n_removed for r in suffixes.drop_earlier_passages(documents(rows)).collect()}
    want = {k: v[1] for k, v in brute.suffixes([r[:2] for r in rows]).items()}
    assert got == want


def overlapping_texts(seed):
    """Texts with chance, periodic and cut repeats, zero bytes and two-byte letters."""
    rng = random.Random(seed)
    shared = ["".join(rng.choice("ab\0é ") for _ in range(240)) for _ in range(4)]
    out = []
    for i in range(60):
        parts = ["".join(rng.choice("abc\0é") for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 200)
            parts.append(rng.choice(shared)[a : a + rng.randint(20, 160)])
            parts.append("ab" * rng.randint(0, 70) if i % 5 == 0 else rng.choice("xyz\0"))
        out.append((i * 7 % 61, "".join(parts)))
    return out


@pytest.mark.parametrize(("seed", "lot", "hot", "batches"), [(1, 16, 1 << 20, 5), (2, 64, 3, 3), (3, 1 << 14, 1024, 1)])
def test_suffix_scan_against_brute_force(spark, monkeypatch, seed, lot, hot, batches):
    """Small lots, frequent beginnings compared by windows, several batches."""
    monkeypatch.setattr(suffixes, "LOT", lot)
    monkeypatch.setattr(suffixes, "HOT", hot)
    texts = overlapping_texts(seed)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = suffixes.drop_earlier_passages(docs, batches=batches).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    assert found == brute.suffixes(texts)


def test_batch_added_to_a_stored_family(spark):
    """A second family takes over stored arrays; a batch that comes later meets what they hold."""
    texts = sorted(overlapping_texts(4))
    want = {k: v[1] for k, v in brute.suffixes(texts).items()}
    stored, found = [], {}
    for first in range(0, 60, 15):
        batch = texts[first : first + 15]
        docs = spark.createDataFrame(
            [(False, k, 0, x) for k, x in batch], "late boolean, k bigint, t int, text string"
        )
        family = suffixes.IndexFamily(100, stored)
        gone = {k: np.zeros(len(x.encode()), bool) for k, x in batch}
        for r in family.add(docs).collect():
            gone[r.k][r.start : r.start + r.n + 99] = True
        found |= {k: int(g.sum()) for k, g in gone.items()}
        stored = family.levels
    assert found == want
    assert [generation for generation, _ in stored] == [2]
    rows = [bytes(r.suffix) for r in stored[0][1].collect()]
    assert len(rows) > 100


def test_classes_of_a_suffix_array():
    """Every window against every other, without Spark."""
    texts = [x.encode() for _, x in overlapping_texts(5)]
    document, start, n, _, _, before = (
        np.concatenate(x) for x in zip(*suffixes.entries(texts, 100))
    )
    rows = []
    for d, a, m, b in zip(document, start, n, before):
        right, left = texts[d][a + b : a + m + 99], texts[d][a : a + b][::-1]
        rows.append((right, left, False, int(d), 0, int(a), int(m), int(b)))
    rows.sort()
    table = pa.table(dict(zip(["suffix", "left", *suffixes.PLACE], map(list, zip(*rows)))))
    seen = suffixes.seen_earlier(table, 100)
    got = {(r[3], r[5] + r[7] - int(s)) for r, flags in zip(rows, seen) for s in np.flatnonzero(flags)}
    known, want = set(), set()
    for d, text in enumerate(texts):
        for a in range(len(text) - 99):
            x = text[a : a + 100]
            want |= {(d, a)} if x in known else set()
            known.add(x)
    assert got == want and len(want) > 50


def test_suffixes_odd_rows(odd_documents):
    got = suffixes.drop_earlier_passages(odd_documents)
    assert got.count() == 9 and got.columns.count("kept") == 1
    five = [r.kept for r in got.collect() if r.doc_id == 5]
    # Repeated rows are one document; the other text of the id is another.
    assert sorted(len(x) for x in five)[1:] != [] and len({bytes(x) for x in five}) == 2


def test_simhash(documents, rows):
    rows = rows + [(2000 + i, rows[3][1] + " x" * (i % 2), None, None, None) for i in range(5)]
    got = simhash.near_duplicates(documents(rows)).collect()
    ordered = sorted(rows)
    fp = [brute.fingerprint(r[1]) for r in ordered]
    root = brute.components(fp)
    want = {r[0]: (f, ordered[c][0]) for r, f, c in zip(ordered, fp, root)}
    assert {r.id: (r.fp % 2**64, r.component_id) for r in got} == want
    kept = simhash.one_of_each(documents(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert kept.columns == documents(rows).columns


def test_simhash_odd_rows(odd_documents):
    kept = simhash.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    found = {(r.doc_id, r.text) for r in kept.collect()}
    assert kept.count() == len(found)
    assert (7, None) in found and (8, "") not in found
    assert (5, [r.text for r in odd_documents.collect()][0]) in found


@pytest.mark.parametrize("spread", [2, 40])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, spread):
    """Dense groups around few centres, with small cells, so that grids of cells are used."""
    monkeypatch.setattr(simhash, "CELL", 64)
    rng = random.Random(spread)
    values = set()
    for _ in range(spread):
        centre = rng.getrandbits(64)
        for _ in range(600 // spread):
            values.add(centre ^ sum({1 << rng.randrange(12) for _ in range(rng.randint(0, 4))}))
    values = sorted(values)
    table = spark.createDataFrame(
        [(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint"
    )
    links = simhash.link_fingerprints(table, 3)
    pairs = [(a % 2**64, b % 2**64) for a, b in links.collect()]
    root = brute.components(values)
    own = dict(zip(values, root))
    assert all(own[a] == own[b] for a, b in pairs)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    groups = {}
    for v, c in own.items():
        signed = v - (1 << 64) if v >> 63 else v
        groups.setdefault(c, set()).add(roots.get(signed, signed))
    assert all(len(g) == 1 for g in groups.values())


@pytest.mark.parametrize("m,distance", [(2, 3), (3, 3), (4, 3), (2, 2), (3, 2)])
def test_thresholds_sum_to_what_the_principle_needs(m, distance):
    rng = np.random.default_rng(m)
    fp = rng.integers(0, 2**63, 50, dtype=np.uint64)
    bits = [list(range(i, 64, m)) for i in range(m)]
    widths = [len(b) for b in bits]
    values = [simhash.values_of(fp, b) for b in bits]
    histograms = [rng.integers(0, 50, 1 << 16) for _ in range(m)]
    got = simhash.thresholds(values, histograms, widths, distance)
    assert (got.sum(0) == distance - m + 1).all() and got.min() >= -1


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    got = connected_components(links.selectExpr("a * 7919 % 301 AS a", "b * 7919 % 301 AS b"))
    assert {r.root for r in got.collect()} == {0} and got.count() == 301


@pytest.mark.parametrize(
    "operator",
    [
        lines.drop_repeated_lines, recompression.drop_repeated_passages,
        suffixes.drop_earlier_passages, simhash.near_duplicates, simhash.one_of_each,
    ],
)
def test_empty_table(documents, operator):
    assert operator(documents([])).count() == 0
