"""Packing and token files against the tokenizer on whole texts."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import random_texts
from tidemark.llm import encoding, packing, tokens
from tidemark.llm.encoding import WordEncoder
from tidemark.llm.queries import tokenizer_path
from tidemark.plans.staging import scratch_path

ODD = [
    "it's. don't, a.b., é. É, ΑΣ. ΑΣΑ, İ. x́. <|endoftext|>. <|ENDOFTEXT|> a<|startoftext|>b 12.",
    "日本。 x y z\x85q ... .,.! a.. 'S 'll. \x1c a\x1cb x². é. ́a .́ a.́ 가.", " ", "", "\n\t",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture
def ids(tokenizer):
    def of(text):
        found = tokenizer.encode(text or "", add_special_tokens=False).ids
        return np.array([*found, 1], "<u4")

    return of


def test_words_give_the_ids_of_whole_texts(ids):
    texts = ODD + random_texts(seed=1) + [t.upper() for t in random_texts(seed=2)]
    got = WordEncoder(tokenizer_path()).encode([t.encode() for t in texts])
    assert got == [ids(t)[:-1].tobytes() for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_string_and_any_tokenizer(name):
    """Punctuation, apostrophes, digits, marks, special tokens; white space that counts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole, own = Tokenizer.from_file(path), WordEncoder(path)
    assert own.apart == name.startswith("word")
    rng = random.Random(3)
    parts = [
        *"abcdeXYZ019 ,.;:!?'\"$%&*#()-_<|>\n\t", "  ", "'s", "'re", "don't", "é", "e\u0301", "日本",
        "\u00a0", "\u3000", "ß", "İ", "<|startoftext|>", "<|endoftext|>", "word ", "Word,", "end.\n",
        "''", "...", "!!! ", "x'. ", "</w>", "a\u0301, ", "中, ",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * 5000, "ab," * 2000, "</w> a</w> </w>."]
    want = [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert own.encode([t.encode() for t in texts]) == want


@pytest.mark.parametrize("limit", [2, 5, 9])
def test_a_small_cache_keeps_the_words_of_a_lot(ids, monkeypatch, limit):
    monkeypatch.setattr(encoding, "CACHED_WORDS", limit)
    own = WordEncoder(tokenizer_path())
    rng = random.Random(limit)
    words = [w + tail for w in ("ka", "lora", "misun", "terde", "önvi") for tail in ("", ".", ",")]
    for _ in range(200):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(3)]
        assert own.encode([t.encode() for t in texts]) == [ids(t)[:-1].tobytes() for t in texts]


def check_pieces(pieces, whole, limits):
    """Every id in one piece; sequences without gaps and within the limits; returns padding."""
    by_key, by_sequence = {}, {}
    for p in pieces:
        found = np.frombuffer(p.ids, "<u4")
        assert len(found) == p.length and p.tokens == len(whole[p.key][0])
        by_key.setdefault(p.key, []).append((p.start, found))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length, p.loss, p))
    assert set(by_key) == {k for k, (x, _) in whole.items() if len(x)}
    for key, parts in by_key.items():
        parts.sort(key=lambda x: x[0])
        assert [s for s, _ in parts] == np.cumsum([0, *[len(x) for _, x in parts]])[:-1].tolist()
        assert np.concatenate([x for _, x in parts]).tolist() == whole[key][0].tolist()
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda x: x[0])
        lengths = [n for _, n, _, _ in parts]
        assert [o for o, _, _, _ in parts] == np.cumsum([0, *lengths])[:-1].tolist()
        total = sum(lengths)
        assert total <= limits.tokens and len(parts) <= limits.segments
        assert sum(x for _, _, x, _ in parts) <= limits.loss
        for _, n, x, p in parts:
            mask = whole[p.key][1]
            assert x == (n if mask is None else mask[p.start : p.start + n].sum())
        padding += 0 if total & (total - 1) == 0 else limits.tokens - total
    return padding / sum(len(x) for x, _ in whole.values())


def test_documents(documents, rows, ids):
    pieces = packing.pack_documents(documents(rows), tokenizer_path()).collect()
    whole = {r[0]: (ids(r[1]), None) for r in rows}
    assert check_pieces(pieces, whole, packing.Limits()) == 0
    assert len(whole[1000][0]) == 1


@pytest.mark.parametrize(
    "limits",
    [
        packing.Limits(64, 5, 20, 16), packing.Limits(50, 1, 50, 4), packing.Limits(8, 8, 1, 2),
        packing.Limits(128, 100, 128, 1),
    ],
)
def test_all_limits_hold_for_examples_with_loss(spark, limits):
    rng = random.Random(limits.tokens)
    whole, rows = {}, []
    for key in range(150):
        n = rng.choice([0, 1, 3, 10, 40, 200])
        x = np.array([rng.randrange(50_000) for _ in range(n)], "<u4")
        mask = None if key % 5 == 0 else np.array([rng.random() < 0.4 for _ in range(n)], "u1")
        whole[key] = (x, mask)
        rows.append((key, x.tobytes(), None if mask is None else mask.tobytes(), "clash"))
    df = spark.createDataFrame(rows, "key bigint, ids binary, loss binary, sequence_id string")
    pieces = packing.pack(df.repartition(3), "key", "ids", "loss", limits).collect()
    check_pieces(pieces, whole, limits)


def test_many_short_examples_leave_no_padding():
    """The pool grows until it can fill a sequence; only the limits that were given close one."""
    packer = packing.Packer(packing.Limits())
    pieces = [p for i in range(3000) for p in packer.add(i, np.arange(3, dtype="<u4"), None)]
    pieces += packer.finish()
    length = {}
    for p in pieces:
        length[p.sequence] = length.get(p.sequence, 0) + len(p.ids)
    assert sum(length.values()) == 9000
    assert all(n == 2048 or n & (n - 1) == 0 for n in length.values())
    limits = packing.Limits(segments=100)
    packer = packing.Packer(limits)
    pieces = [p for i in range(3000) for p in packer.add(i, np.arange(3, dtype="<u4"), None)]
    pieces += packer.finish()
    counts = np.bincount([p.sequence for p in pieces])
    assert counts.max() == 100 and sum(len(p.ids) for p in pieces) == 9000


def test_examples_without_ids_or_key(spark):
    df = spark.createDataFrame(
        [(None, b"\1\0\0\0"), (1, None), (1, b""), (2, b"\2\0\0\0" * 3), (2, b"\2\0\0\0" * 3)],
        "key bigint, ids binary",
    )
    got = packing.pack(df, "key", "ids").collect()
    assert sorted((str(r.key), r.length) for r in got if r.start == 0)[-1] == ("None", 1)
    assert sum(r.length for r in got) == 7
    assert packing.pack(df.limit(0), "key", "ids").count() == 0


def written(spark, docs, **options):
    path = scratch_path(spark, "token-files")
    tokens.write_token_files(docs, path, tokenizer_path(), **options)
    return path


@pytest.mark.parametrize("files", [1, 5])
def test_token_files_round_trip(spark, documents, rows, ids, files):
    path = written(spark, documents(rows), files=files)
    got = sorted(tokens.read_token_files(spark, path).collect(), key=lambda r: r.start)
    start = 0
    for r, (key, text, *_) in zip(got, sorted(rows), strict=True):
        want = ids(text)
        assert (r.doc_id, r.start, r.n_tokens) == (key, start, len(want))
        assert zlib.crc32(r.ids) == zlib.crc32(want.tobytes())
        start += len(want)
    for key, text, *_ in rows[:5]:
        (one,) = tokens.read_document(spark, path, key)
        assert one.tolist() == ids(text).tolist()
    assert tokens.read_document(spark, path, 10**6) == []


def test_token_files_order_ties_and_missing_ids(spark, odd_documents, ids):
    path = written(spark, odd_documents, files=3)
    got = sorted(tokens.read_token_files(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(
        ((r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or "") for r in odd_documents.collect())
    )
    assert [r.doc_id for r in got] == [None if x[0] else x[1] for x in rows]
    assert [bytes(r.ids) for r in got] == [ids(x[3]).tobytes() for x in rows]
    assert len(tokens.read_document(spark, path, 5)) == 3


@pytest.mark.parametrize("named", [0, 300])
def test_token_files_split_rows_without_id(spark, documents, ids, named):
    """As many files as for rows with ids, and about as large; rows without id ordered by text."""
    texts = [f"{chr(97 + i % 26)}{i} é word" for i in range(600)] + ["", None, "a", "a"]
    rows = [(i if i < named else None, t, "en", "s", 1) for i, t in enumerate(texts)]
    path = written(spark, documents(rows), files=6)
    sizes = [r["docs"] for r in tokens._manifest(spark, path).collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * len(rows) / 6
    got = sorted(tokens.read_token_files(spark, path).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [(r.doc_id, bytes(r.ids)) for r in got] == [(r[0], ids(r[1]).tobytes()) for r in order]


def test_token_files_refuse_another_dictionary(spark, documents, rows):
    path = written(spark, documents(rows), files=1)
    name = tokens._manifest(spark, path).first()["name"]
    store, root = tokens.FileSystem.from_uri(path)
    with pytest.raises(ValueError, match="dictionary"):
        tokens.TokenFile(store, root, name, b"another")


def test_no_documents(spark, documents):
    path = written(spark, documents([]))
    assert tokens.read_token_files(spark, path).count() == 0
    assert packing.pack_documents(documents([]), tokenizer_path()).count() == 0
