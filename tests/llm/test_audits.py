"""Secret scans, filter interactions and hard negatives against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import interactions, negatives, secrets

RULES = secrets.RULES


def brute_secrets(text):
    out = []
    for i, r in enumerate(RULES):
        head = f"(?i:{r.head})" if r.any_case else r.head
        found = re.compile(f"(?:{head})({r.value})")
        for m in found.finditer(text or ""):
            if m.end() - m.start(found.groups) >= r.least:
                out.append((m.start(), i, r.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


FRAGMENTS = [
    "password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA",
    "ABCDEFGHIJKLM", "deadbeef" * 4, "abc", "0123456789" * 4, "é", "日本", "\n", "ghp_", "x" * 36,
    "xoxb-", "eyJ", ".", "-----BEGIN", " RSA PRIVATE KEY-----", "https://", "user:", "pw123@host", "_", "-",
]


def spans_of(text):
    data = text.encode()
    spans = secrets.scanner(RULES).spans(data)
    place = secrets.in_code_points(data, [x for s in spans for x in s[:2]])
    return [(RULES[i].kind, place[s], place[e]) for s, e, i in spans]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(FRAGMENTS), max_size=14).map("".join))
def test_automaton_finds_what_the_expressions_match(text):
    assert spans_of(text) == brute_secrets(text)


def test_leftmost_matches_pass_over_what_they_drop():
    assert spans_of('secret=token: "abcdefgh12"') == []
    assert spans_of("xé token : 'abcdefgh' AKIA0123456789AB") == [("assign", 3, 20), ("access", 22, 38)]
    assert spans_of("f" * 31) == [] and spans_of("f" * 90) == [("hex", 0, 90)]


def test_automaton_is_minimal():
    """No two states of the smallest automaton are equal: a second pass merges none."""
    for a in (secrets.scanner(RULES).starts, *secrets.scanner(RULES).walkers):
        steps = np.array(a.steps).reshape(a.states, a.width) // a.width
        assert len(set(secrets.minimise(steps, np.array(a.rules)))) == a.states
        assert all(bool(r) == (s * a.width >= a.accepting) for s, r in enumerate(a.rules))


@pytest.mark.parametrize("bad", ["(a", "a)", "*a", "a{1,2}", "é", "[a"])
def test_bad_patterns_are_refused(bad):
    with pytest.raises(ValueError):
        secrets.Pattern(bad)


def test_rules_that_match_nothing_are_refused():
    with pytest.raises(ValueError):
        secrets.pattern(secrets.Rule("empty", "a?", "b*"))


def test_find_secrets(spark, documents, rows):
    rng = random.Random(3)
    texts = ["".join(rng.choice(FRAGMENTS) for _ in range(30)) for _ in range(50)]
    texts += ["ab " * 600_000 + "token=abcdefgh " + "é" * 10 + "0" * 2_000_000]  # beyond one slice
    extra = [(2000 + i, t, "en", "a", None) for i, t in enumerate(texts)]
    found = secrets.find_secrets(documents(rows + extra).selectExpr("*", "1 AS secrets", "'x' AS spans"))
    got = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in found.collect()}
    assert got == {r[0]: brute_secrets(r[1]) for r in rows + extra}
    for r in secrets.secret_report(found).collect():
        own = got[r["doc_id"]]
        text = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        base = [s for s in own if s[0] in ("assign", "access", "hex")]
        assert r["spans"] == text(own)
        assert r["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
        kinds = Counter(s[0] for s in own)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [kinds[k] for k in ("assign", "access", "hex")]


def test_secrets_of_odd_rows(odd_documents):
    df = odd_documents.selectExpr("*", "'old' AS Secrets", "1 AS _found")
    report = secrets.secret_report(secrets.find_secrets(df))
    assert report.count() == df.count() and report.where("spans <> ''").count() == 0
    assert {"a.b", "taken", "_found"} <= {c.lower() for c in report.columns}
    assert secrets.find_secrets(df.limit(0)).count() == 0


# --------------------------------------------------------------------------- filter interactions


def brute_audit(rows, labels):
    """``rows``: (id, part, text); ``labels``: id -> (good, toxic)."""
    fails = []
    for key, _, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append({
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": key is not None
            and any(k is not None and k < key and (t or "") == text for k, _, t in rows),
        })
    out, total = {}, Counter()
    for part in {p or "" for _, p, _ in rows}:
        own = [i for i, r in enumerate(rows) if (r[1] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if fails[i][f]}
                bad = {i for i in own if fails[i][f]}
                left -= gone
                total[part, f] += len(gone)
                mark = lambda i, k: labels.get(rows[i][0], (False, False))[k]
                out[part, order, step] = (
                    len(left), len(gone), len(bad - gone),
                    sum(sum(fails[i].values()) == 1 for i in bad),
                    sum(mark(i, 0) for i in gone), sum(mark(i, 1) for i in gone),
                )
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(5)
    rows = []
    for i in range(70):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, rng.choice([9, 900]))) for _ in range(rng.choice([150, 199, 200, 320]))]
        text = " ".join(words) + rng.choice(["", "", " #", " " + "Q" * 60, "\tÉÉ"])
        rows.append((i, rng.choice([None, "", "a", "b"]), text))
    rows += [(100 + i, "a", rows[i][2]) for i in range(20)]
    rows += [(5, "b", rows[5][2]), (5, "b", rows[5][2]), (5, "a", "other"), (3, "a", rows[40][2])]
    rows += [(None, "a", rows[1][2]), (None, "b", "x"), (None, "b", "x"), (200, "b", "x"), (201, "b", "x")]
    return rows + [(300, "c", None), (301, "c", ""), (302, None, None), (303, "c", "\n \t")]


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    marks = [(i, i % 3 % 2, i % 2) for i in range(0, 310, 2)] + [(4, None, None), (4, 1, 0), (None, 1, 1), (6, 0, 0)]
    labels = {}
    for key, good, toxic in marks:
        if key is not None:
            g, t = labels.get(key, (False, False))
            labels[key] = (g or good == 1, t or toxic == 1)
    docs = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "doc_id bigint, source string, text string, mask int, n string"
    ).selectExpr("*", "'y' AS `a.b`").repartition(3)
    marks = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").selectExpr("*", "1 AS id")
    got = interactions.audit(interactions.document_masks(docs, marks)).collect()
    assert len(got) == 4 * 120 * 5
    assert {tuple(r) for r in got} == brute_audit(rows, labels)
    none = interactions.document_masks(docs.limit(0), marks)
    assert interactions.audit(none).count() == 0
    alone = interactions.audit(interactions.document_masks(docs, marks.limit(0))).collect()
    assert {tuple(r) for r in alone} == brute_audit(rows, {})


@pytest.mark.parametrize("n", [1, 3, 4])
def test_removal_steps_are_min_plus_products(n):
    """Each mask goes at the first filter of the order that it fails."""
    steps = interactions.removal_steps(n)
    for mask in range(1 << n):
        for i, order in enumerate(permutations(range(n))):
            first = next((s for s, f in enumerate(order, 1) if mask >> f & 1), math.inf)
            assert steps[mask, i] == first


def test_shapley_adds_up_and_long_lists_are_refused():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 50, 16)
    report = interactions.Audit(4).report(rows, rows * 0, rows * 0)
    each = {f: report["shapley"][0][i] for i, f in enumerate(interactions.orders(4)[0])}
    assert sum(each.values()) == math.factorial(4) * (rows.sum() - rows[0])
    with pytest.raises(ValueError):
        interactions.Audit(8)


# --------------------------------------------------------------------------- hard negatives


def brute_negatives(rows, every, k=5, n=3, low=50, high=95):
    good = set()
    for key, label, v in rows:
        if None not in (key, label, v) and all(x is not None and math.isfinite(x) for x in v):
            good.add((key, label, tuple(math.floor(256 * float(x)) for x in v)))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for key, label, v in good:
        if key % every:
            continue
        scored = sorted((-score(v, w), i, m) for i, m, w in good if i != key and len(w) == len(v))
        for s, positive, _ in [x for x in scored if x[2] == label][:k]:
            found = [
                (i, -t) for t, i, m in scored if m != label and low * -s <= 100 * -t <= high * -s
            ]
            out += [(key, positive, r, i, -s, t) for r, (i, t) in enumerate(found[:n], 1)]
    return sorted(out)


def vectors(seed, n, dims, groups):
    """Vectors around a few centres, with ties, near ties and odd rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (groups, dims))
    x = (centres[rng.integers(0, groups, n)] + rng.normal(0, 0.2, (n, dims))).astype(np.float32)
    rows = [(i, int(rng.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(n + i, i % 4, rows[i % 3][2]) for i in range(40)]  # ties
    return rows


@pytest.mark.parametrize("block, page, lot", [(16, 2, 4), (1024, 64, 512)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, page, lot):
    for name, value in (("BLOCK", block), ("PAGE", page), ("LOT", lot)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(block, 400, 6, 5)
    far = [0.0] * 6
    rows += [(500 + i, i, [0.5, 0.25, -1.0]) for i in range(4)] + [(510, 1, []), (520, 2, [])]
    rows += [(530, 1, far), (540, None, far), (None, 1, far), (550, 2, None), (560, 1, [float("nan")] * 6)]
    rows += [(570, 1, [None] * 6), (580, 1, [math.inf] * 6), (600, 1, [float(2**15)] * 6), (601, 2, [float(2**14)] * 6)]
    rows += [rows[0], rows[10], (10, 9, rows[11][2]), (20, rows[20][1], rows[21][2])]
    df = spark.createDataFrame(
        [(*r, 1, "x") for r in rows],
        "vec_id bigint, label int, embedding array<float>, score int, id string",
    ).selectExpr("*", "1 AS `a.b`").repartition(5)
    got = sorted(map(tuple, negatives.mine(df, every=10).collect()))
    assert got == brute_negatives(rows, 10) and got
    assert negatives.mine(df.limit(0)).count() == 0


def test_negatives_of_wide_vectors(spark):
    """Doubles stay doubles, and scores beyond 2**53 are exact."""
    rng = random.Random(4)
    rows = [(i, i % 3, [rng.uniform(0, 3e5), rng.uniform(-1, 3e5)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, label bigint, embedding array<double>")
    assert sorted(map(tuple, negatives.mine(df, every=10).collect())) == brute_negatives(rows, 10)


def test_zone_maps_skip_blocks(spark, monkeypatch):
    """With clusters far apart, most blocks are not asked for, and the result is the same."""
    monkeypatch.setattr(negatives, "BLOCK", 32)
    rows = [(i, lab, [x * 4 for x in v]) for i, lab, v in vectors(1, 1200, 3, 12)]
    wanted = []
    keep = negatives.stage_table

    def watch(df, name):
        out = keep(df, name)
        if name == "wanted-blocks":
            wanted.append(out.selectExpr("sum(size(ws))").first()[0] or 0)
        return out

    monkeypatch.setattr(negatives, "stage_table", watch)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    mined = negatives.mine(df, every=40)
    assert sorted(map(tuple, mined.collect())) == brute_negatives(rows, 40)
    blocks = -(-len(rows) // 32)
    asked = 31 * blocks, 31 * 5 * blocks
    assert wanted[0] + wanted[1] < 0.5 * asked[0] and wanted[2] + wanted[3] < 0.7 * asked[1]


def test_hilbert_neighbours_differ_in_one_step():
    """The curve visits every cell once, and consecutive cells touch."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(2**bits)] * dims)).reshape(dims, -1).T
        keys = negatives.hilbert_keys(cells, bits)
        order = sorted(range(len(cells)), key=lambda i: keys[i].tobytes())
        assert len({k.tobytes() for k in keys}) == len(cells)
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(9)
    rows = np.floor(rng.normal(0, 40, (200, 8)))
    queries = np.floor(rng.normal(0, 40, (30, 8)))
    low, high = negatives.score_bounds(queries, rows.min(0)[None], rows.max(0)[None])
    scores = queries @ rows.T
    assert (low[:, 0] <= scores.min(1)).all() and (scores.max(1) <= high[:, 0]).all()
