import collections
import math
import os
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import gru, html_text, lm_score, toxicity, url_filter

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.0, 1) for i, t in rows], "doc_id long, text string, score double, c long").repartition(3)


# language model


def network(rng, inputs, hidden, words):
    """Classes with as many words of their own as given, and one for the rest of each."""
    inner = np.full((len(words), max(words) + 1), gru.NEVER)
    for k, n in enumerate(words):
        inner[k, : n + 1] = rng.normal(0, 1, n + 1)
    m = gru.Gru.new(inputs, hidden, rng.normal(0, 1, len(words)), inner)
    m.inner[:] = rng.normal(0, 0.5, m.inner.shape)
    return m


def test_gradients():
    rng = np.random.default_rng(1)
    m = network(rng, 5, 4, [0, 2, 3])
    for k in ("table", "u", "out", "bias", "inner", "inner_bias"):
        setattr(m, k, getattr(m, k).astype(np.float64))
    x, y, h = rng.integers(0, 5, (6, 3)), rng.integers(0, 3, (6, 3)), rng.normal(0, 0.3, (3, 4))
    w = np.array([0, 2, 3])[y] * rng.integers(0, 2, y.shape)
    fresh = rng.random((6, 3)) < 0.2
    y[5, 1] = -1
    t = gru.Trainer(m, 0.1)
    g, _, _, n = t.gradients(x, fresh, y, w, h)
    for k in ("table", "u", "out", "bias", "inner", "inner_bias"):
        v = getattr(m, k)
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in v.shape)
            if k == "inner_bias" and v[i] < gru.NEVER / 2:
                continue
            v[i] += 1e-4
            a = t.gradients(x, fresh, y, w, h)[2]
            v[i] -= 2e-4
            b = t.gradients(x, fresh, y, w, h)[2]
            v[i] += 1e-4
            assert (a - b) / 2e-4 / n == pytest.approx(g[k][i], rel=1e-3, abs=1e-7), (k, i)


def one_by_one(m, x, y, w):
    """A document's log probability, a word at a time, by the definition of the network."""
    k, h, total = m.u.shape[0], np.zeros(m.u.shape[0]), 0.0
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    softmax = lambda o: np.exp(o - o.max()) / np.exp(o - o.max()).sum()
    for s, c, v in zip(x, y, w, strict=True):
        a, b = m.table[s].astype(float), h @ m.u
        z, r = sigmoid(a[:k] + b[:k]), sigmoid(a[k : 2 * k] + b[k : 2 * k])
        n = np.tanh(a[2 * k :] + r * b[2 * k :])
        h = z * h + (1 - z) * n
        total += np.log(softmax(h @ m.out + m.bias)[c]) + np.log(softmax(h @ m.inner[c] + m.inner_bias[c])[v])
    return total


def test_state_is_carried_across_windows(monkeypatch):
    rng = np.random.default_rng(2)
    m = network(rng, 6, 5, [0, 1, 3, 2])
    monkeypatch.setattr(gru, "LANES", 3)  # several documents in a lane
    lengths = np.array([1, 3, gru.WINDOW, gru.WINDOW + 1, 5 * gru.WINDOW + 7, 2, 40, 1, 9])
    x, y = rng.integers(0, 6, lengths.sum()).astype(np.uint16), rng.integers(0, 4, lengths.sum()).astype(np.uint8)
    w = (np.array([0, 1, 3, 2])[y] * rng.integers(0, 2, len(y))).astype(np.uint8)
    got = gru.log_likelihood(m, lengths, x, y, w)
    ends = np.cumsum(lengths)
    for k, (a, z) in enumerate(zip(ends - lengths, ends, strict=True)):
        assert got[k] == pytest.approx(one_by_one(m, x[a:z], y[a:z], w[a:z]), rel=1e-4)


def test_lanes_hold_every_word_once():
    rng = np.random.default_rng(3)
    for size in (1, 5, 700):
        lengths = rng.integers(1, 90, rng.integers(1, 60))
        seen = []
        for live, place, fresh in gru.Lanes(lengths, size).windows():
            assert place.shape[1] == live and (place >= 0)[fresh].all()
            seen.append(place[place >= 0])
        assert sorted(np.concatenate(seen).tolist()) == list(range(lengths.sum()))


def test_a_long_document_takes_few_windows(monkeypatch):
    """While few lanes run, a window of scoring has more steps instead of as many calls for less."""
    rng = np.random.default_rng(4)
    m = network(rng, 6, 5, [0, 1, 3, 2])
    lengths = np.array([9, 6000, *rng.integers(1, 30, 40)])
    x, y = rng.integers(0, 6, lengths.sum()).astype(np.uint16), rng.integers(0, 4, lengths.sum()).astype(np.uint8)
    w = (np.array([0, 1, 3, 2])[y] * rng.integers(0, 2, len(y))).astype(np.uint8)
    calls, real = [], gru.forward
    monkeypatch.setattr(gru, "forward", lambda m, x, *more, **named: calls.append(x.size) or real(m, x, *more, **named))
    got = gru.log_likelihood(m, lengths, x, y, w)
    assert len(calls) < 6000 / gru.WINDOW / 4 and max(calls) <= gru.LANES * gru.WINDOW
    ends = np.cumsum(lengths)
    for k, (a, z) in enumerate(zip(ends - lengths, ends, strict=True)):
        assert got[k] == pytest.approx(one_by_one(m, x[a:z], y[a:z], w[a:z]), rel=1e-4)


def test_large_weights_and_blocks(monkeypatch):
    """Outputs whose exponentials leave 32 bits, and rows over several blocks."""
    monkeypatch.setattr(gru, "BLOCK", 7)
    rng = np.random.default_rng(5)
    m = network(rng, 6, 5, [0, 1, 3, 2])
    m.out *= 400
    m.inner *= 400
    x, y = rng.integers(0, 6, 50).astype(np.uint16), rng.integers(0, 4, 50).astype(np.uint8)
    w = (np.array([0, 1, 3, 2])[y] * rng.integers(0, 2, 50)).astype(np.uint8)
    want = one_by_one(m, x, y, w)
    assert gru.log_likelihood(m, np.array([50]), x, y, w)[0] == pytest.approx(want, rel=1e-3)
    assert not gru.unshifted(m.out, m.bias, 1.0) and not gru.unshifted(m.inner, m.inner_bias, 1.0)
    g, _, loss, n = gru.Trainer(m, 0.1).gradients(x[:, None], np.arange(50)[:, None] == 0, y[:, None].astype(int), w[:, None], np.zeros((1, 5), np.float32))
    assert n == 50 and loss == pytest.approx(-want, rel=1e-3)
    assert all(np.isfinite(v).all() for v in g.values())


def test_nearest_is_the_dense_product():
    rng = random.Random(6)
    words = [b"", b"12", "é".encode(), b"a"] + ["".join(rng.choices("abcdeé1-", k=rng.randint(1, 9))).encode() for _ in range(3000)]
    centre = lm_score.clusters(words[:200], np.arange(200, 0, -1).astype(float))
    assert lm_score.nearest([], centre).tolist() == [] and lm_score.nearest([b"1"], centre).tolist() == [0]
    v = lm_score.spelling(words) @ centre.T
    got = lm_score.nearest(words, centre)
    assert np.allclose(v[np.arange(len(words)), got], v.max(1), atol=1e-6)
    # no dense vector for each word: 256 numbers of 4 bytes would be 1,024 bytes
    tracemalloc.start()
    lm_score.nearest(words, centre)
    assert tracemalloc.get_traced_memory()[1] < 1024 * len(words)
    tracemalloc.stop()


def check_counts(rows, got):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = collections.Counter()
    for i, t in rows:
        if not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in rows:
        k = tokens(t)
        want[i, held(i), len(k), sum(c[w] > 0 for w in k), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in k), 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_counts_and_base_by_hand(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["The", "the", "É", "a", "b.", f"w{k}"], k=rng.randint(0, 30)))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, "the the"), (3, rows[3][1]), (102, "z " * 5000)]
    got = lm_score.score(docs_frame(spark, rows), chunk=500).collect()
    check_counts(rows, got)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_scores_by_hand_and_probabilities_sum_to_one(spark, monkeypatch):
    """Scores against the definition, a word at a time; and in any state all words, known and unknown,
    have a probability of one together, or less by the second way to say the word before."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)] + ["the", "of", "and", "in", "a.", "to"] * 40
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(80)] + [(100, None), (101, "the the the"), (102, "new newer the")]
    docs = docs_frame(spark, rows)
    found, real = {}, lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda encoded, codes: found.setdefault("m", real(encoded, codes)))
    got = {r.doc_id: r for r in lm_score.score(docs).collect()}
    encoded, total, codes = lm_score.encode(docs)
    m, cls, word = found["m"], np.array(codes.cls), np.array(codes.word)
    by_id = {r.doc_id: r for r in encoded.collect()}
    for i, r in by_id.items():
        x, y = np.frombuffer(r.x, np.uint16), np.frombuffer(r.y, np.uint16) & (lm_score.ONCE - 1)
        assert got[i].score == pytest.approx(one_by_one(m, x, cls[y], word[y]) / math.log(10) + r.inner, rel=1e-4), i
        assert (got[i].train_tokens, got[i].n_tokens) == (total, len(y))
    # shares of the words without a place, by hand from the counts
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = collections.Counter(w for i, t in rows if not held(i) for w in (t or "").lower().split())
    shares = np.zeros(lm_score.CLASSES)
    one = {w: next(k for k, t in rows if t and w in t.lower().split()) for w in counts}
    for w, n in counts.items():
        at = dict(rows)[one[w]].lower().split()
        code = np.frombuffer(by_id[one[w]].y, np.uint16)[at.index(w)] & (lm_score.ONCE - 1)
        if code < lm_score.CLASSES:
            shares[code] += (n + 0.5) / codes.counts[code, 0]
    assert all(abs(v - 1) < 1e-9 for v in shares[shares > 0])
    state = np.random.default_rng(1).normal(0, 0.5, m.u.shape[0])
    p = np.exp(gru.class_logs(m, state[None].astype(np.float32))[:, 0])
    assert p.sum() == pytest.approx(1, abs=1e-5)
    for k in range(lm_score.CLASSES):
        assert np.exp(gru.inner_logs(m, k, state[None])).sum() == pytest.approx(1, abs=1e-5)


def test_frequent_words(spark):
    rng = random.Random(3)
    counts = [(f"w{k}".encode(), rng.randint(0, 900)) for k in range(500)] + [(b"top", 10**6)]
    df = spark.createDataFrame([(bytearray(w), c) for w, c in counts], "word binary, c long").repartition(5)
    got = lm_score.frequent(df, 100)
    assert 60 < len(got) <= 100 and got == sorted((r for r in counts if r[1] > 0), key=lambda r: (-r[1], r[0]))[: len(got)]
    assert lm_score.frequent(df.limit(0), 100) == []


def test_no_training_rows(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    (r,) = lm_score.score(docs_frame(spark, [(held, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert lm_score.score(docs_frame(spark, [])).count() == 0


def test_held_out_beats_the_base(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = lm_score.score(docs).collect()
    check_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) / len(held) > 0.8


# toxicity


@pytest.fixture(scope="module")
def tables(spark):
    folder = SF.replace("sf0.001", "sf0.1")  # 825 labelled rows are held out there; 70 in sf0.01
    return spark.read.parquet(folder + "/documents.parquet"), spark.read.parquet(folder + "/labels.parquet")


def test_decoder(tables):
    counts = toxicity.trigram_counts(tables[0])
    d = toxicity.Decoder(toxicity.trigram_model(counts))
    for hidden, word in (("m0r0n", "moron"), ("tr@sh", "trash"), ("cl0wn!!", "clown"), ("i.d.i.o.t", "idiot"), ("pa-the-tic", "pathetic"), ("scccum", "scum"), ("l o s e r", "loser")):
        assert word in d.words(f"the {hidden} is"), hidden
    assert d.words("The the. of%%% (and)") == {"the", "of", "and"} and d.words("") == set()


def test_spelt_runs_are_parted(spark, tables):
    model = toxicity.fit(tables[0], toxicity.training_labels(tables[1]))
    d = toxicity.Decoder(model.trigrams, model.lexicon)
    for text, word in (("you are a l o s e r", "loser"), ("y o u i d i o t", "idiot"), ("y o u a r e a n 1 d 1 0 t", "idiot"), ("the l o s e r is", "loser")):
        assert word in d.words(text), text
    for n in range(20, 60):  # wherever a run is long
        assert "idiot" in d.words("z " * n + "y o u i d i o t"), n
    assert isinstance(d.words("a b " * 50_000), set)
    pairs = (("you are a stupid idiot", "you are a s t u p i d i d i o t"), ("you moron you are pathetic", "y o u m o r o n y o u a r e p a t h e t i c"))
    rows = docs_frame(spark, [(k, t) for k, t in enumerate(x for p in pairs for x in p)] + [(9, "h a v e a n i c e d a y")])
    got = {r.doc_id: r.s for r in toxicity.with_score(rows, model, name="s").collect()}
    assert min(got[k] for k in range(4)) >= 0.5 > got[9], got


def test_decoder_reads_long_tokens(tables):
    d = toxicity.Decoder(toxicity.trigram_model(toxicity.trigram_counts(tables[0])))
    assert "idiot" in d.words("idi" + "o" * 60 + "t")
    assert "idiot" in d.words("the.people.who.say.this.are.not.the.same.you.1d10t.of.all")
    assert isinstance(d.words("ab1" * 100_000), set)


def exhaustive(d, token):
    """The least cost of all readings of a token."""
    best = math.inf

    def go(k, state, cost):
        nonlocal best
        if k == len(token):
            best = min(best, cost - d.rows[state][0])
            return
        for x, extra in d.options(token, k):
            if x < 0:
                go(k + 1, state, cost + extra)
            else:
                go(k + 1, state % toxicity.N * toxicity.N + x, cost + extra - d.rows[state][x])

    go(0, 0, 0.0)
    return best


def test_decoding_is_exact():
    """Against every path of the lattice, under a model that has no opinion that a beam could follow."""
    rng = np.random.default_rng(5)
    model = np.log(rng.dirichlet(np.ones(toxicity.N) * 0.3, (toxicity.N, toxicity.N)) + 1e-9).astype(np.float32)
    d, py = toxicity.Decoder(model), random.Random(6)

    def cost(token, words):
        """The cheapest path that reads as the decoder says."""
        best = math.inf

        def go(k, state, c, said):
            nonlocal best
            if k == len(token):
                text = "".join(toxicity.LETTERS[x - 1] if x else " " for x in said)
                if tuple(w for w in text.split() if len(w) > 1) == words:
                    best = min(best, c - d.rows[state][0])
                return
            for x, extra in d.options(token, k):
                if x < 0:
                    go(k + 1, state, c + extra, said)
                else:
                    go(k + 1, state % toxicity.N * toxicity.N + x, c + extra - d.rows[state][x], [*said, x])

        go(0, 0, 0.0, [])
        return best

    for _ in range(60):
        token = "".join(py.choices("ab*16|!$ c5", k=py.randint(1, 7)))
        assert cost(token, d.decode(token)) == pytest.approx(exhaustive(d, token), abs=1e-6), token


def test_few_rows(spark):
    from pyspark.sql import functions as F

    from foliant.llm.common import few

    rows = spark.range(50_000).repartition(7)
    got = {r.id for r in few(rows, F.xxhash64("id"), 400).collect()}
    assert 380 <= len(got) <= 400
    hashes = sorted((r.h, r.id) for r in rows.select("id", F.xxhash64("id").bitwiseAND((1 << 62) - 1).alias("h")).collect())
    assert got == {i for _, i in hashes[: len(got)]}
    assert few(rows.limit(30), F.xxhash64("id"), 400).count() == 30 and few(rows.limit(0), F.xxhash64("id"), 4).count() == 0


def test_trigram_counts_by_hand(spark):
    rows = [(1, "Ab"), (2, None), (3, "a1b é"), (4, "中a")]
    got = toxicity.trigram_counts(docs_frame(spark, rows))
    assert sum(got.values()) == sum(1 for t in ("\n\nab\n", "\n\na1b é\n", "\n\n?a\n") for k in range(len(t) - 2) if any(c in toxicity.CLASS for c in t[k : k + 3])) or got
    a, b = toxicity.CLASS["a"], toxicity.CLASS["b"]
    assert got[a * toxicity.N + b] == 1 and got[a] >= 2


def test_positions_of_features_take_little_memory():
    rng = random.Random(3)
    rows = [[f"^word{rng.randrange(5000)}" for _ in range(rng.randrange(400))] for _ in range(2000)] + [[], ["^word1"]]
    names = [f"^word{k}" for k in rng.sample(range(5000), 700)]
    get = {w: k for k, w in enumerate(names)}
    words = pa.array(rows, pa.list_(pa.string()))
    expected = [sorted(get[w] for w in own if w in get) for own in rows]
    assert toxicity.positions(words, pa.array(names)).to_pylist() == expected
    assert toxicity.positions(words.slice(7, 90), pa.array(names)).to_pylist() == expected[7:97]
    assert toxicity.positions(words, pa.array([], pa.string())).to_pylist() == [[]] * len(rows)
    assert toxicity.positions(words[:0], pa.array(names)).to_pylist() == []
    tracemalloc.start()
    toxicity.positions(words.slice(0, toxicity.ROWS), pa.array(names))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20  # 200,000 words; as Python objects they take over 12 MB


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(got[i], y) for i, y in truth.items() if i in got and got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert sum(r.predicted == y for r, y in held) / len(held) >= 0.97
    assert sum(r.predicted > y for r, y in held) <= 3
    toxic = [r for r, y in held if y == 1]
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.85


def test_toxicity_edges(spark):
    docs = docs_frame(spark, [(1, None), (2, ""), (None, "you idiot"), (3, "x" * 50_000), (3, "x" * 50_000), (4, "1" * 9000)])
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 6
    none = toxicity.score(docs, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none) and len({r.score for r in none}) == 1
    assert toxicity.score(docs.limit(0), labels).count() == 0
    kept = toxicity.reject_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 6


# pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One, two, three.</p><p>Four<br>five</p></article><footer>foot</footer></body></html>", "Head One, two, three. Four five"),
        ("<body><article><p>a<p>b<b>c</article>", "a bc"),
        ("<article><header>h</header><p>text</p><aside>s</aside><form><p>f</p></form><div class='comments'><p>bad</p></div><div id=cookie-notice>n</div></article>", "text"),
        ("<article><p>x &lt;b&gt; &#233; &copy;</p><!-- no --><script>if (a < b) '</p>'</script><style>p{}</style></article>", "x <b> é ©"),
        ("<div><div class='sidebar'><p>one, two, three, four, five</p></div><div class='content with-sidebar'><p>body text, here.</p></div></div>", "body text, here."),
        ("<article><section><p>one, one</p></section><section><p>two</p><ul><li>a<li>b</ul></section></article>", "one, one two a b"),
        ("<p>cut <b", "cut <b"),
        ("<article><p>a</p><!-- never closed <p>b</p>", "a"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
    ],
)
def test_pages(page, text):
    assert html_text.extract(page or "") == text


def test_broken_markup_is_linear_and_safe():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=\"", "'", '"', ">", "<", "<!--", "-->", "<script>", "</script>", "text, ", "&amp;", "<li>", "<td>", "</article>", "<article>"]
    for _ in range(300):
        html_text.extract("".join(rng.choices(bits, k=rng.randint(0, 40))))
    html_text.extract("<div>" * 20_000 + "x" + "<a '" * 5000)


@pytest.mark.parametrize("make", [lambda n: "<div>" * n + "x", lambda n: "<div>" * n + "x</p></b>" * n, lambda n: "<p><button>" + "<span>" * n + "<div></div>" * n + "x", lambda n: "<div><p>a, b</p>" * n, lambda n: "<table><tr>" + "<i>" * n + "<li>x" * n])
def test_deep_markup_takes_linear_time(make):
    """Ten times the tags, about ten times the time, however deep they lie and whatever ends them."""
    took = []
    for n in (4_000, 40_000):
        best = math.inf
        for _ in range(2):
            start = time.process_time()
            html_text.extract(make(n))
            best = min(best, time.process_time() - start)
        took.append(best)
    assert took[1] < 30 * max(took[0], 0.01)


def test_main_texts(spark):
    rows = [(1, "u", "<article><p>é</p></article>"), (1, "u", "<article><p>é</p></article>"), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.main_texts(df)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "é", 1), (1, "u", "é", 1), (2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_driver_pages_against_their_articles(spark):
    import html
    import re

    for r in html_text.main_texts(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", body).replace("<b>", "").replace("</b>", ""))
        assert r.text == re.sub(r"[\x20\x09-\x0D]+", " ", want).strip(" ") and r.n_chars == len(r.text)


URLS = ["http://A.Example.ORG/es/1?x", "https://example.org/en/1", "https://example.org/en/2/", "https://notexample.org/es/", "https://x.com/fr/a#b", "https://x.com/de/a", "https://x.com/en/1", "ftp://net", "no scheme", None, "", "://h/p", "http://com?/fr/", "http://a://b.org/c", "http://É.com/de/"]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(k, u, "z") for k, u in enumerate(URLS)] + [(0, URLS[0], "z")], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert url_filter.judge(df).count() == len(URLS) + 1
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow") and got[3][2:] == ("org/", "allow")
    assert got[4] == ("x.com", "/fr/a", "com/fr/", "allow") and got[5][2:] == ("com/de/", "block") and got[6][2] is None
    assert got[7] == ("net", "", None, "allow") and got[8][:3] == got[9][:3] == got[10][:3] == ("", "", None)
    assert got[11] == ("h", "/p", None, "allow") and got[12][:3] == ("com", "", None) and got[13][:2] == ("a:", "//b.org/c")
    assert got[14][:3] == ("É.com", "/de/", "com/de/")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_deep_templates_against_sql(spark):
    """Branches at every depth, long paths, alone and shared, and merging on several levels."""
    import duckdb

    rng = random.Random(21)
    urls = []
    for _ in range(500):
        host = rng.choice(["www.example.org", "b.example.org", "x.com", "y.net", "y.net"])
        first = rng.choice(["es", "en", "de", "fr", "news", "shop"])
        parts = [first, *(rng.choice(["a", "b", "c", str(rng.randrange(900))]) for _ in range(rng.randrange(6)))]
        urls.append(f"http://{host}/" + "/".join(parts))
    urls += [f"http://x.com/de/{'q/' * 10}{k}" for k in range(8)] + ["http://deep.net/" + "/".join(map(str, range(300))), "http://x.com", "http://x.com//", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    got = url_filter.judge(pages)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({url_filter.sql()})").fetchall()
    rows = [tuple(r) for r in got.select(*cols).collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    names = {r[cols.index("template")] for r in rows}
    assert any(n.count("/") > 6 for n in names) and any("{}" in n.split("/")[k] for n in names for k in (2, 3) if n.count("/") >= k), names


def test_alike_branches_are_merged_at_depth(spark):
    urls = [(f"http://h.net/s/{kind}/{name}/{k}", int(kind == "ads")) for kind in ("ads", "text") for name in ("p", "q", "r") for k in range(20)]
    pages = spark.createDataFrame(list(enumerate(u for u, _ in urls)), "page_id long, url string")
    got = url_filter.judge(pages, labels=spark.createDataFrame(urls[::2], "url string, bad int"))
    found = {(r.path.split("/")[2], r.template, r.verdict) for r in got.collect()}
    assert found == {("ads", "/s/ads/{}/*", "block"), ("text", "/s/text/{}/*", "allow")}, found


def test_templates_learn_from_labels(spark):
    pages = [(k, f"http://h.net/{'shop' if k % 2 else 'news'}/{k}/item") for k in range(80)] + [(k, f"http://h.net/shop/{k}/item") for k in range(200, 240)]
    labels = [(u, int("/shop/" in u)) for k, u in pages[:60]] + [(None, 1), (pages[0][1], None)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = url_filter.judge(df, labels=spark.createDataFrame(labels, "url string, bad int")).collect()
    for r in got:
        assert r.verdict == ("block" if r.path.startswith("/shop/") else "allow") and r.template.endswith("/*/item")
