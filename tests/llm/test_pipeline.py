"""The pipeline's stages in turn against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_search_and_models import brute_targets
from tidemark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
LANGUAGE, LINES, NEAR, MIX, PACK = (f for _, f in corpus_pipeline.STAGES)


def brute_near(rows):
    """``rows``: (id, text, ...), unique ids; the row of the smallest id of each component."""
    rows = sorted(rows)
    root = brute.components([brute.fingerprint(r[1]) for r in rows])
    return [rows[c] for c in sorted(set(root))]


def brute_mix(rows):
    """``rows``: (id, text, source), unique ids; the documents of the mix as (id, words)."""
    by_source = {}
    for key, text, source in rows:
        by_source.setdefault(source, []).append((key, brute.words(text)))
    sources = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len(w) for _, w in by_source[s]) for s in sources]
    out = []
    for s, size, target in zip(sources, sizes, brute_targets(sizes)):
        left = math.floor(target + 0.5)
        order = sorted(
            (x for x in by_source[s] if x[1]),
            key=lambda x: hashlib.md5(f"42:{x[0]}".encode()).hexdigest(),
        )
        while left and size:
            for key, words in order:
                if left:
                    out.append((key, b" ".join(words[:left])))
                    left -= min(left, len(words))
    return out


def stored(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_stages(spark, tmp_path, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(10**6, None, "en", "src1", 0), (10**6 + 1, "12 -- 34", "en", "src1", 8)], docs.schema
    )
    docs = docs.union(extra)
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]

    docs = stored(spark, LANGUAGE(spark, docs, SF), tmp_path, "1")
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(docs.collect()) == sorted(rows) and docs.columns == columns

    docs = stored(spark, LINES(spark, docs, SF), tmp_path, "2")
    left = {k: x for k, _, _, x in brute.lines([r[:2] for r in rows])}
    rows = [(r[0], left[r[0]], r[2], r[3], len(left[r[0]])) for r in rows]
    assert sorted(docs.collect()) == sorted(rows) and docs.columns == columns

    docs = stored(spark, NEAR(spark, docs, SF), tmp_path, "3")
    rows = brute_near(rows)
    assert sorted(docs.collect()) == rows and docs.columns == columns

    docs = stored(spark, MIX(spark, docs, SF), tmp_path, "4")
    mixed = brute_mix([(r[0], r[1], r[3]) for r in rows])
    got = docs.collect()
    assert Counter((r.doc_id, b" ".join(brute.words(r.text))) for r in got) == Counter(mixed)
    assert all(r.n_chars == len(r.text) for r in got) and docs.columns == columns

    pieces = PACK(spark, docs, SF).collect()
    ids = Counter()
    for r in got:
        for i in [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]:
            ids[r.doc_id, i] += 1
    found = Counter()
    sequences = Counter()
    for p in pieces:
        sequences[p.sequence_id] += p.length
        found.update((p.doc_id, int(i)) for i in np.frombuffer(p.ids, "<u4"))
    assert found == ids
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())


@pytest.mark.parametrize("labelled", ["false", "crc32(CAST(CAST(doc_id AS string) AS binary)) % 4 = 2"])
def test_language_stage_keeps_documents_without_labels(spark, documents, rows, labelled):
    rows = [*rows, (1001, "12 -- 34", "en", "a", 8)]
    docs = documents(rows).selectExpr("doc_id", "text", f"IF({labelled}, lang, NULL) AS lang", "source", "n_chars")
    want = [tuple(r) for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    got = LANGUAGE(spark, docs, SF)
    assert len(want) > 60 and got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_run(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    left = {k: x for k, _, _, x in brute.lines([r[:2] for r in rows])}
    rows = brute_near([(k, left[k], source) for k, _, source in rows])
    want = Counter()
    for key, text in brute_mix(rows):
        want[key] += len(tokenizer.encode(text.decode(), add_special_tokens=False).ids) + 1
    got = Counter()
    for r in corpus_pipeline.run(spark, SF).select("doc_id", "length").collect():
        got[r.doc_id] += r.length
    assert got == want


@pytest.mark.parametrize("stage", [LANGUAGE, LINES, NEAR, MIX, PACK])
def test_odd_and_empty_tables(spark, documents, odd_documents, stage):
    out = stage(spark, odd_documents, SF)
    assert stage is PACK or out.columns == odd_documents.columns
    out.count()
    assert stage(spark, documents([]), SF).count() == 0
