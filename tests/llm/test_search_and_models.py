"""Top-k search, fingerprints, language identification and mixing against brute force."""

import base64
import math
import random
import struct
import zlib
from decimal import Decimal

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import random_texts
from tidemark.llm import fingerprints, language, mixing, topk
from tidemark.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"


def brute_top_k(rows, k, every):
    """``rows``: (id, vector); ids may repeat with other vectors."""
    whole = {
        (key, tuple(math.floor(256 * float(x)) for x in v))
        for key, v in rows
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    best = {}
    for q, a in whole:
        if q % every == 0:
            own = best.setdefault(q, {})
            for key, b in whole:
                if key != q and len(a) == len(b):
                    own[key] = max(own.get(key, -math.inf), sum(x * y for x, y in zip(a, b)))
    out = set()
    for q, scores in best.items():
        ranked = sorted((-s, key) for key, s in scores.items())[:k]
        out |= {(q, i, key, -s) for i, (s, key) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(block)
    half = lambda: float(np.float32(rng.gauss(0, 1)))
    rows = [(i, [half() for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [1.0, 0.0, 0.0, -1.0, 0.0, 0.5]) for i in range(60)]  # ties
    rows += [(400 + i, [half() for _ in range(3)]) for i in range(4)]  # fewer than k
    rows += [(410, [0.0] * 6), (420, [float("nan")] * 6), (430, None), (440, [None] * 6)]
    rows += [(450, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (0, rows[0][1]), (1, [9.0] * 6)]
    # Ids with many vectors, better and worse than those they had, as candidates and as queries.
    rows += [(i % 30, [half() * 2 for _ in range(6)]) for i in range(200)]
    rows += [(77, [half() for _ in range(6)]) for _ in range(100)]
    df = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, score int, id string"
    )
    got = topk.top_k(df, 5, every=10).collect()
    assert {tuple(r) for r in got} == brute_top_k(rows, 5, 10) and len(set(got)) == len(got)
    assert topk.top_k(df.limit(0)).count() == 0


def test_threshold_stops_early():
    """Lists of a few large values end the walk long before all rows are met."""
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(0, 10, (4000, 2)))
    rows[:20] += 5000
    lists = topk.SortedLists(np.arange(4000), rows)
    met = []
    score = lists._scores
    lists._scores = lambda which, q: (met.append(len(which)), score(which, q))[1]
    ids, scores = lists.top(-1, np.array([1.0, 2.0]), 5)
    best = np.lexsort((np.arange(4000), -(rows @ [1, 2])))[:5]
    assert ids.tolist() == best.tolist() and sum(met) < 400


@pytest.mark.parametrize("kind", ["random", "few large", "huge", "ties", "empty"])
def test_lots_of_queries_walk_together(kind, monkeypatch):
    """Blocks met one after the other by a whole lot give each query's best, without a walk for
    each query where walks would meet most rows."""
    monkeypatch.setattr(topk, "CELLS", 1 << 13)
    rng = np.random.default_rng(2)
    dim = 0 if kind == "empty" else 8
    rows = np.floor(rng.normal(0, 100, (900, dim)))
    if kind == "few large":
        rows[:40] *= np.repeat([300.0, 1.0], 4)
    if kind == "huge":
        rows *= 2.0**20
    if kind == "ties":
        rows = np.sign(rows)
    ids = np.concatenate([np.arange(700), np.arange(200) % 7])  # some ids have many vectors
    queries, qs = ids[:60], rows[:60].copy()
    qs[0] = 0
    best = topk.Best(queries, 5)
    alone = []
    top = topk.SortedLists.top
    monkeypatch.setattr(topk.SortedLists, "top", lambda *a: (alone.append(a[1]), top(*a))[1])
    for part in np.array_split(np.arange(900), 3):
        topk.SortedLists(ids[part], rows[part]).improve(best, qs)
    got = sorted(zip(best.at.tolist(), (-best.scores).tolist(), best.ids.tolist(), strict=True))
    want = []
    for i, q in enumerate(qs.astype(np.int64)):
        own = {}
        for key, score in zip(ids.tolist(), (rows.astype(np.int64) @ q).tolist(), strict=True):
            if key != queries[i]:
                own[key] = max(own.get(key, score), score)
        want += [(i, *x) for x in sorted((-s, key) for key, s in own.items())[:5]]
    assert got == sorted(want)
    if kind == "random":
        assert len(alone) <= 3  # only the query of zeros


def test_blocks_below_the_floor_are_left_out():
    rows = np.array([[1.0, 2.0], [3.0, 1.0], [2.0, -4.0]])
    lists = topk.SortedLists(np.arange(3), rows)
    qs = np.array([[1.0, 1.0], [1.0, -1.0], [1.0, 0.0]])
    assert lists.depths(qs, np.array([6, 8, 3])).tolist() == [0, 0, 3]


@pytest.mark.parametrize("files", [1, 6])
def test_fingerprints(spark, documents, rows, files):
    spark.conf.set("spark.sql.shuffle.partitions", files)
    try:
        got = fingerprints.edit_fingerprints(documents(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    ordered = sorted(rows, reverse=True)
    by_text, want = {}, {}
    for i, (key, text, *_) in enumerate(ordered):
        text, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        sets = [set(fingerprints.paragraph_digests(x.encode())) for x in (text, changed, other)]
        near = [
            2 * len(sets[0] & s) / (len(sets[0]) + len(s)) if sets[0] or s else 1.0
            for s in sets[1:]
        ]
        want[key] = (len(text), brute.sha(changed.encode()), *near)
        by_text[key] = text
    found = {r.id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got}
    assert found == want
    same = {}
    for r in got:
        assert same.setdefault(by_text[r.id], r.fingerprint) == r.fingerprint
    assert len(set(same.values())) == len(same)


def test_fingerprints_odd_rows(odd_documents):
    got = fingerprints.edit_fingerprints(odd_documents).collect()
    assert sorted(str(r.id) for r in got) == sorted(
        str(r.doc_id) for r in odd_documents.collect()
    )
    one = fingerprints.edit_fingerprints(odd_documents.limit(1)).collect()
    assert one[0].near_next == 1 and one[0].near_edited > 0
    assert fingerprints.edit_fingerprints(odd_documents.limit(0)).count() == 0


def peeled_apart(print_):
    """Digests held by a fingerprint, one cell after the other, without the library."""
    size, data = print_.split(".")
    table = [[n % 256, k, c] for n, k, c in struct.iter_unpack("<bQQ", base64.b64decode(data))]
    found, third, mod = [], len(table) // 3, 1 << 64

    def scrambled(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % mod
        x = (x ^ x >> 27) * 0x94D049BB133111EB % mod
        return x ^ x >> 31

    while True:
        alone = [
            k for n, k, c in table if n == 1 and scrambled(k ^ 0x5851F42D4C957F2D) == c
        ]
        if not alone:
            break
        key = alone[0]
        found.append(key)
        for j in range(3):
            cell = scrambled((key + (j + 1) * 0xD1342543DE82EF95) % mod) % third + j * third
            n, k, c = table[cell]
            table[cell] = [
                (n - 1) % 256, (k - key) % mod, (c - scrambled(key ^ 0x5851F42D4C957F2D)) % mod
            ]
    assert not any(map(any, table)) and len(found) == int(size, 16)
    return set(found)


def test_likeness_follows_from_the_fingerprints_alone(spark, documents, rows):
    """Both columns from the strings, with a peeling and with cuts of the test's own."""
    got = fingerprints.edit_fingerprints(documents(rows)).collect()
    got.sort(key=lambda r: -r.id)
    texts = {key: text or "" for key, text, *_ in rows}
    held = [peeled_apart(r.fingerprint) for r in got]
    for i, r in enumerate(got):
        after = (i + 1) % len(got)
        for other, near in (
            (peeled_apart(r.edited_fingerprint), r.near_edited), (held[after], r.near_next)
        ):
            size = len(held[i]) + len(other)
            assert near == (2 * len(held[i] & other) / size if size else 1)
        assert fingerprints.likeness(r.fingerprint, got[after].fingerprint) == r.near_next
        text, pieces, start = texts[r.id].encode(), [], 0
        for end in range(1, len(text) + 1):
            last = int.from_bytes(text[end - 8 : end], "little") if end > 7 else None
            if last is not None:
                last = (last ^ last >> 32) * 0x9E3779B97F4A7C15 % (1 << 64) >> 58
            if last == 0 or text[end - 1] == 10 or end == len(text):
                pieces.append(text[start:end])
                start = end
        assert {xxhash.xxh3_64_intdigest(p) for p in pieces} <= held[i]
        assert len(pieces) == len(held[i])


def test_paragraphs_need_no_spaces():
    rng = random.Random(5)
    for letters in ("abcdefghij", "abcdefg\t", "abcdefg\r", "日本語文字列", "abcd\u3000ef"):
        text = "".join(rng.choices(letters, k=16000))
        other = "".join(rng.choices(letters, k=16000))
        texts = (text.encode(), fingerprints.edited(text, other).encode())
        digests = [fingerprints.paragraph_digests(x) for x in texts]
        near = fingerprints.likeness(*fingerprints.fingerprints(digests))
        assert len(digests[0]) > 100 and 0.4 < near < 0.7


@pytest.mark.parametrize("files", [1, 4])
def test_fingerprints_of_rows_without_id_come_last(spark, files):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("abcdef ", k=300))) for i in range(40)]
    rows += [(None, "".join(rng.choices("abcdef ", k=300))) for _ in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    hashed = df.where("doc_id IS NULL").selectExpr("xxhash64(text) AS h", "text").collect()
    ordered = [x for _, x in rows[39::-1]] + [r.text for r in sorted(hashed)]
    spark.conf.set("spark.sql.shuffle.partitions", files)
    try:
        got = fingerprints.edit_fingerprints(df)
        parts = got.where("id IS NULL").select(F.spark_partition_id().alias("p")).distinct().count()
        got = sorted((r.id is None, -(r.id or 0), r.edited_sha256) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = [
        (i >= 40, 0 if i >= 40 else i - 39,
         brute.sha(fingerprints.edited(x, ordered[(i + 1) % 70]).encode()))
        for i, x in enumerate(ordered)
    ]
    assert got == sorted(want) and (files == 1 or parts > 1)


def test_sketches_recover_differences():
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        both = [rng.getrandbits(64) for _ in range(rng.choice([0, 5, 400, 3000]))]
        a, b = ([rng.getrandbits(64) for _ in range(rng.choice([0, 1, 7, 300]))] for _ in "ab")
        pairs.append(tuple(np.array(sorted(both + x), np.uint64) for x in (a, b)))
    prints = fingerprints.fingerprints([x for pair in pairs for x in pair])
    at = np.arange(len(pairs)) * 2
    for (a, b), near in zip(pairs, fingerprints.likenesses(prints, at, at + 1)):
        shared = len(set(a.tolist()) & set(b.tolist()))
        assert near == (2 * shared / (len(a) + len(b)) if len(a) + len(b) else 1)


def test_few_differences_need_no_larger_sketch(monkeypatch):
    """Versions of a text are told apart by subtraction alone, whatever their length."""
    rng = random.Random(8)
    same = [rng.getrandbits(64) for _ in range(5000)]
    a, b = (np.array(sorted(same + [rng.getrandbits(64) for _ in range(n)]), np.uint64) for n in (3, 40))
    prints = fingerprints.fingerprints([a, b])
    monkeypatch.setattr(fingerprints, "_filled", None)
    assert fingerprints.likeness(*prints) == 10000 / 10043


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "bab", "é"]
    p = np.array([[0.2, 0.1], [0.1, 0.3], [0.3, 0.1], [0.1, 0.1], [0.1, 0.2], [0.1, 0.1], [0.1, 0.1]])
    table = language.Pieces(pieces)
    words = ["ab", "bab", "abbab", "é", "xab", "a"]
    got = np.exp(table.log_likelihood(words, p))
    counts = table.expected_counts(words, np.eye(len(words)))
    for i, word in enumerate(words):
        index = lambda x: pieces.index(x) if x in pieces else 6
        ways = [[index(x) for x in s] for s in segmentations(word, pieces)]
        assert np.allclose(got[i], sum(np.prod(p[w], 0) for w in ways))
        weights = [(1 / 7) ** len(w) for w in ways]
        want = sum(np.bincount(w, minlength=7) * x for w, x in zip(ways, weights)) / sum(weights)
        assert np.allclose(counts[:, i], want)


def summed(word, pieces, p):
    """Sums over all segmentations up to and from each position, in decimals."""
    at = {x: i for i, x in enumerate(pieces)}
    n, most = len(word), max(map(len, pieces))
    edges = [
        (i, i + m, at.get(word[i : i + m], len(pieces)))
        for i in range(n) for m in range(1, min(most, n - i) + 1)
        if m == 1 or word[i : i + m] in at
    ]
    up, down = ([Decimal(0)] * (n + 1) for _ in "ab")
    up[0] = down[n] = Decimal(1)
    for i, j, x in edges:
        up[j] += up[i] * p[x]
    for i, j, x in reversed(edges):
        down[i] += down[j] * p[x]
    counts = [Decimal(0)] * (len(pieces) + 1)
    for i, j, x in edges:
        counts[x] += up[i] * p[x] * down[j] / up[n]
    return up[n], [float(x) for x in counts]


def test_long_words_and_long_pieces_are_summed_whole():
    rng = random.Random(3)
    pieces = ["a", "ab", "b", "ba", "abab" * 3, "bab" * 5, "é"]
    words = ["".join(rng.choices("abababé", k=n)) for n in (24, 25, 60, 255, 256, 257, 1500)]
    words += ["ab" * n for n in (20, 128, 400)] + ["abx" * 90]
    table = language.Pieces(pieces)
    p = np.array([[rng.uniform(1e-9, 0.1) for _ in range(2)] for _ in range(8)])
    got = table.log_likelihood(words, p)
    counts = table.expected_counts(words, np.eye(len(words)))
    for i, word in enumerate(words):
        for c in range(2):
            want, _ = summed(word, pieces, [Decimal(x) for x in p[:, c].tolist()])
            assert math.isclose(got[i, c], float(want.ln()), rel_tol=1e-9)
        assert np.allclose(counts[:, i], summed(word, pieces, [Decimal(1) / 8] * 8)[1])


def test_letters_keep_marks_and_pieces_their_length():
    assert language.letters("Ǖx́-नि".encode()) == "ǖx́नि"
    assert language.letters("\u0301.1".encode()) == ""
    assert language.letters(("ab" * 40).encode()) == "ab" * 40
    pieces = language.vocabulary_pieces(vocabulary_path())
    assert max(map(len, pieces)) > 10 and sum(not x.isalpha() for x in pieces) > 100


def test_whole_rows_of_language_against_brute_force(spark):
    """Learning, sums, prediction and score of every row, in decimals."""
    rng = random.Random(12)
    spoken = {"en": "the cat sat on this mat", "fr": "le chat était là où été", "xx": "qozzy the wub"}
    rows = []
    for i in range(24):
        lang = rng.choice(list(spoken))
        words = rng.choices(spoken[lang].split() + ["on", "12", "a-b"], k=rng.randint(1, 6))
        mark = rng.choice(["", ".", "!"])
        rows.append((i, " ".join(words).title() + mark, lang if i % 5 else None))
    pieces = language.vocabulary_pieces(vocabulary_path())
    size = len(pieces) + 1
    even = [Decimal(1) / size] * size
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    text_words = {
        i: [x for w in text.lower().split() if (x := "".join(filter(str.isalpha, w)))]
        for i, text, _ in rows
    }
    uses = {w: summed(w, pieces, even)[1] for ws in text_words.values() for w in ws}
    langs = sorted({lang for i, _, lang in rows if lang and not held[i]})
    learned = {lang: np.full(size, 0.5) for lang in langs}
    for i, _, lang in rows:
        if lang and not held[i]:
            for w in text_words[i]:
                learned[lang] += uses[w]
    chance = {}
    for lang, n in learned.items():
        p = [Decimal(x) for x in (n / n.sum()).tolist()]
        chance[lang] = {w: summed(w, pieces, p)[0] for w in uses}
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in language.identify(df, vocabulary_path()).collect()}
    for i, _, _ in rows:
        ways = [math.prod((chance[lang][w] for w in text_words[i]), start=Decimal(1)) for lang in langs]
        best = max(range(len(langs)), key=lambda k: ways[k])
        assert got[i].held_out == held[i]
        if not text_words[i]:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        assert got[i].lang_pred == langs[best]
        assert math.isclose(got[i].score, float(ways[best] / sum(ways)), rel_tol=1e-3)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs, vocabulary_path()).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {
        r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    }
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, odd_documents):
    got = language.identify(odd_documents, vocabulary_path()).collect()
    assert {r.lang_pred for r in got if not r.text} == {"und"}
    assert {(r.lang_pred, r.score) for r in got if r.text} == {("en", 1.0)}
    df = spark.createDataFrame(
        [(1, "12 34 ..", "en"), (2, None, "en"), (3, "x" * 500, "en"), (4, "日本", None)],
        "doc_id bigint, text string, lang string",
    )
    got = {r.doc_id: r.lang_pred for r in language.identify(df, vocabulary_path()).collect()}
    assert got == {1: "und", 2: "und", 3: "en", 4: "en"}
    unknown = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unknown, vocabulary_path()).collect()} == {"und"}
    assert language.identify(df.limit(0), vocabulary_path()).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """``sizes`` in order of source."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, fixed = share * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        give = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        over = [i for i in free if give[i] > most * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else give[i] for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def test_mix(documents, rows):
    got = mixing.mix(documents(rows)).collect()
    again = mixing.mix(documents(rows[::-1])).collect()
    key = lambda r: r.doc_id
    assert [(r.doc_id, r.taken) for r in sorted(got, key=key)] == [
        (r.doc_id, r.taken) for r in sorted(again, key=key)
    ]
    sizes = {}
    for r in got:
        assert r.size == len(brute.words(r.text)) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(sources, brute_targets([sizes[s] for s in sources])))
    for s in sources:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] for r in own)
        assert all(math.isclose(r.target, targets[s]) for r in own)
        assert sum(r.taken for r in own) == math.floor(targets[s] + 0.5)
    out = mixing.mixed_documents(mixing.mix(documents(rows))).collect()
    taken = {}
    for r in out:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(brute.words(r.text))
    assert taken == {r.doc_id: r.taken for r in got if r.taken}


def test_mix_splits_rows_without_id(spark, capsys):
    rng = random.Random(8)
    rows = [
        (None if i % 3 else i, " ".join(rng.choices("abcdefg", k=rng.randint(0, 9))) + f" {i}", "ab"[i % 2])
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    mixed = mixing.mix(df)
    got = {r.text: r.taken for r in mixed.collect()}
    for source in "ab":
        own = spark.createDataFrame([r for r in rows if r[2] == source], df.schema).selectExpr(
            "doc_id", "text", "md5('42:' || coalesce(CAST(doc_id AS string), '')) AS key", "xxhash64(text) AS tie"
        )
        ordered = sorted(
            (r.key, len(brute.words(r.text)), r.tie, r.text) for r in own.collect()
        )
        left = math.floor(mixed.where(F.col("source") == source).first().target + 0.5)
        whole, left = divmod(left, sum(x[1] for x in ordered))
        for _, size, _, text in ordered:
            assert got[text] == whole * size + min(size, left)
            left -= min(size, left)
    capsys.readouterr()
    mixed.explain()
    assert "shiftright" in capsys.readouterr().out


def test_mix_odd_rows(odd_documents):
    got = mixing.mix(odd_documents)
    assert got.count() == 9 and got.columns.count("size") == 1
    assert mixing.mixed_documents(got).count() > 0
    assert mixing.mix(odd_documents.limit(0)).count() == 0
    empty = odd_documents.where("text IS NULL OR text = ''")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(empty).collect()} == {(0, 0.0, 0)}
    assert mixing.mixed_documents(mixing.mix(empty)).count() == 0


def test_first_words_keep_the_text_before_the_cut(spark):
    df = spark.createDataFrame([(" a\n b  c ", 2), ("a b", 2), ("é\tz", 1)], "t string, n int")
    got = df.select(mixing.first_words("t", F.col("n").cast("double")).alias("x")).collect()
    assert [r.x for r in got] == [" a\n b", "a b", "é"]


def test_random_texts_have_the_cases():
    assert len(set(random_texts())) < len(random_texts())
