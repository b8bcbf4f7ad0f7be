import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from foliant.llm import exact_dedup, simhash, suffix_dedup
from foliant.llm.components import components

EDGE = [(1, None), (2, ""), (3, " \n"), (None, "a  b"), (4, "a b"), (4, "a b"), (5, "a\tb"), (6, "x" * 5000), (7, "x" * 5000), (8, "alone"), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, True, "k") for i, t in rows], "doc_id long, text string, kept boolean, fp string").repartition(3)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("hash_all", [True, False])
def test_exact_groups(spark, hash_all):
    got = exact_dedup.exact_groups(frame(spark, EDGE), hash_all=hash_all).collect()
    groups = collections.defaultdict(list)
    for i, t in EDGE:
        groups[norm(t)].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(EDGE)
    for r in got:
        if r.text_sha256 is None:
            assert not hash_all and r.group_size == 1 and r.kept
            continue
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_drop_exact_copies(spark):
    df = exact_dedup.drop_exact_copies(frame(spark, EDGE))
    assert df.columns == ["doc_id", "text", "kept", "fp"]
    assert sorted(norm(r.text) for r in df.collect()) == sorted({norm(t) for _, t in EDGE})
    assert {r.doc_id for r in df.collect()} == {1, 3, 4, 6, 8}
    assert exact_dedup.drop_exact_copies(frame(spark, [])).count() == 0


def test_fingerprint_by_hand():
    text = "A b C d\te\x0bf é".encode()
    words = text.lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(b" \n") == 0 and simhash.fingerprint(b"x Y") == xxhash.xxh64_intdigest(b"x y", 42)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [2048, 4])
def test_near_duplicates_against_all_pairs(spark, block):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choices(words, k=rng.choice([2, 5, 40, 300])) for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        for _ in range(4):
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, "\t"), (3, texts[3]), (None, texts[0])]
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted((str(i), f"{fps[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(rows))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows), block=block).collect())
    assert got == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def jaccard(a, b, n=5):
    s = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


@pytest.mark.parametrize("block", [1024, 8])
def test_drop_near_copies(spark, block):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([30, 120, 600]))) for _ in range(40)]
    copies = []
    for t in texts[:15]:
        w = t.split()
        for _ in range(max(1, len(w) // 200)):
            w[rng.randrange(5, len(w) - 5)] = "new"
        if jaccard(t, " ".join(w)) >= 0.8:
            copies.append(" ".join(w))
    assert len(copies) > 5
    rows = list(enumerate(texts)) + [(100 + k, c) for k, c in enumerate(copies)] + [(200, texts[20].upper()), (201, None), (202, ""), (21, texts[21])]
    df = simhash.drop_near_copies(frame(spark, rows), block=block)
    assert df.columns == ["doc_id", "text", "kept", "fp"]
    assert sorted(r.doc_id for r in df.collect()) == [*range(40), 201]
    assert simhash.drop_near_copies(frame(spark, [])).count() == 0



def test_near_copies_are_decided_by_similarity(spark):
    """Pairs of 0.8 or more all go, short ones too; pairs of less stay, whatever their fingerprints say."""
    rng = random.Random(12)
    fresh = (f"w{k}" for k in range(10**6))
    take = lambda n: [next(fresh) for _ in range(n)]
    rows, want = [], []

    def pair(one, two, copies):
        assert (jaccard(" ".join(one), " ".join(two)) >= 0.8) == copies
        rows.extend([(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))])
        want.extend([len(rows) - 2] + [len(rows) - 1] * (not copies))

    for _ in range(30):
        w = take(9)
        pair(w, w[:8], True)  # 4 shingles of 5
        w = take(19)
        pair(w, w[:16], True)  # 12 of 15
        w = take(804)
        pair(w + take(100), take(100) + w, True)  # 800 + 100 + 100
        pair(w[:404] + take(65), take(65) + w[:404], False)  # 0.75
        at = rng.randrange(100)
        w = take(404)
        pair(w[at : at + 300] + take(56), take(56) + w[at : at + 300], False)  # 0.73
    got = sorted(r.doc_id for r in simhash.drop_near_copies(frame(spark, rows)).collect())
    assert got == want



@pytest.mark.parametrize("cut", [None, 300])
def test_a_large_group_of_near_copies(cut):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 200, np.uint64)
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 63, 5, np.uint64))) for _ in range(700)]
    f = np.frombuffer(b"".join(map(simhash.wide_fingerprint, sets)), "<u8").reshape(-1, simhash.WORDS)
    x, y = simhash.wide_links(f[:cut], None if cut is None else f[cut:], sets, False)
    assert sorted(x.tolist()) == list(range(1, 700)) and set(y.tolist()) == {0}


def brute(rows, w):
    c = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[i : i + w] for i in range(len(b) - w + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if c[b[i : i + w]] > 1:
                m[i : i + w] = b"\1" * w
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out.append((d, len(b), sum(m), sum(1 for i in range(len(m)) if m[i] and not (i and m[i - 1])), hashlib.sha256(kept).hexdigest(), kept))
    return out


def planted(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choices("abcé", k=rng.randint(15, 60))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.3 else "".join(rng.choices("abcdefgh", k=rng.randint(0, 30))) for _ in range(rng.randint(0, 5)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (None, rows[3][1]), (3, rows[3][1]), (7, "z" * 90), (502, "z" * 91)]


@pytest.mark.parametrize("shard", [4000, 7])
def test_repeats_against_brute_force(spark, shard):
    """With 7 records a shard, frequent anchors are split and merged again."""
    rows = planted(shard)
    got = suffix_dedup.remove_repeats(frame(spark, rows), window=20, gram=5, shard=shard).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r[:5] for r in brute(rows, 20)), key=repr)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_cut_repeats(spark):
    rows = planted(1)
    df = frame(spark, rows).selectExpr("doc_id", "text", "length(text) AS n_chars", "fp")
    got = suffix_dedup.cut_repeats(df, window=20, gram=5)
    assert got.columns == df.columns
    want = sorted(((d, None if t is None else k[5].decode("utf-8", "ignore")) for (d, t), k in zip(rows, brute(rows, 20), strict=True)), key=repr)
    found = got.collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == want
    assert all(r.text is None or r.n_chars == len(r.text) for r in found)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(8)
    for _ in range(60):
        data = np.array(rng.choices(range(1, 4), k=rng.randint(1, 80)), np.uint8)
        depth, b = rng.choice([8, 9, 13, 30]), data.tobytes()
        order, _ = suffix_dedup.suffix_array(data, depth)
        cut = [b[i : i + depth] for i in order]
        assert sorted(order.tolist()) == list(range(len(b))) and cut == sorted(cut)
        lcp = suffix_dedup.kasai(data, order, np.array([0]), np.array([len(b)]), depth)
        for x in range(1, len(order)):
            p, q = cut[x - 1], cut[x]
            n = next((k for k in range(min(len(p), len(q))) if p[k] != q[k]), min(len(p), len(q)))
            assert min(lcp[x], len(p), len(q)) == n


def test_search_sorts_only_windows_whose_hash_recurs(monkeypatch):
    rng = random.Random(12)
    for _ in range(200):
        window = rng.randint(1, 40)
        base = bytes(rng.choices(range(rng.choice([1, 2, 256])), k=120))
        contexts = [base[k : k + window + rng.randint(0, 30)] for k in (rng.randint(0, 79) for _ in range(3))]
        contexts += [bytes(rng.choices(range(rng.choice([2, 256])), k=window + rng.randint(0, 50))) for _ in range(3)]
        contexts = [x for x in dict.fromkeys(contexts) if len(x) >= window]
        seen = collections.Counter(x[k : k + window] for x in contexts for k in range(len(x) - window + 1))
        flags, _ = suffix_dedup.repeated(contexts, window)
        assert [f.tolist() for f in flags] == [[seen[x[k : k + window]] > 1 for k in range(len(x) - window + 1)] for x in contexts]
    sorted_, real = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda data, *a: sorted_.append(len(data)) or real(data, *a))
    shared = bytes(rng.choices(range(256), k=60))
    contexts = [bytes(rng.choices(range(256), k=5000)) + shared + bytes(rng.choices(range(256), k=5000)) for _ in range(4)]
    flags, _ = suffix_dedup.repeated(contexts, 50)
    assert [np.flatnonzero(f).tolist() for f in flags] == [list(range(5000, 5011))] * 4
    assert sum(sorted_) <= 4 * 60  # of 40,240 bytes


def test_the_passage_stage_reads_common_prefixes_of_ties_alone(monkeypatch):
    rng = random.Random(13)
    half = bytes(rng.choices(range(256), k=200))
    whole = bytes(rng.choices(range(256), k=300))
    contexts = [bytes(rng.choices(range(256), k=400)) + half + whole[:k] + bytes(rng.choices(range(256), k=400)) for k in (0, 300, 300)]
    read, real = [], suffix_dedup.kasai
    monkeypatch.setattr(suffix_dedup, "kasai", lambda data, order, *a: read.append(len(order)) or real(data, order, *a))
    flags, _ = suffix_dedup.repeated(contexts, 250)
    # the shared stretch of 500 bytes has 251 windows, that of 200 none
    assert [np.flatnonzero(f).tolist() for f in flags] == [[], list(range(400, 651)), list(range(400, 651))]
    assert read == [2 * 251]


def test_runs_and_spans_are_found_for_many_contexts_at_a_time():
    rng = np.random.default_rng(5)
    for _ in range(50):
        flags = [rng.random(rng.integers(1, 9)) < 0.6 for _ in range(rng.integers(1, 30))]
        whole = rng.random(len(flags)) < 0.2
        want = [(k, *r) for k, f in enumerate(flags) for r in suffix_dedup._runs(f | whole[k]).tolist()]
        assert list(zip(*(x.tolist() for x in suffix_dedup._lane_runs(flags, whole)), strict=True)) == want
        row, lo = rng.integers(0, 6, 40), rng.integers(0, 90, 40)
        hi = lo + rng.integers(1, 9, 40)
        covered = [sorted({x for r, a, z in zip(row, lo, hi, strict=True) if r == k for x in range(a, z)}) for k in range(6)]
        got = list(zip(*(x.tolist() for x in suffix_dedup.union(row, lo, hi)), strict=True))
        assert [[x for r, a, z in got if r == k for x in range(a, z)] for k in range(6)] == covered
        assert all(r != s or z < b for (r, _, z), (s, b, _) in zip(got, got[1:], strict=False))
    none = np.zeros(0, np.int64)
    assert [len(x) for x in suffix_dedup.union(none, none, none)] == [0, 0, 0]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    shared = bytes(rng.choices(range(256), k=60))
    a, b = (np.frombuffer(bytes(rng.choices(range(256), k=rng.randint(5, 90))) + shared + bytes(rng.choices(range(256), k=30)), np.uint8) for _ in range(2))
    found = []
    for x in (a, b):
        h, anchor, first, last = suffix_dedup.anchor_runs(x, 40, 10)
        at = x.tobytes().index(shared)
        found.append([(int(h[k]), int(anchor[k]) - s) for s in range(at, at + 21) for k in [int(np.searchsorted(first, s, "right")) - 1] if last[k] >= s])
    assert found[0] == found[1] and len(found[0]) == 21
