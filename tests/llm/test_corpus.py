"""Language ID, toxicity, mixing, LM scoring, WARC, packing and the pipeline, with awkward rows."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import zstandard

import corpus_pipeline
from mnemospark.llm import language_id, lm_scoring, mixing, packing, toxicity, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_language_id_held_out(spark, sf_dir):
    from mnemospark.llm.queries import op1_language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = op1_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_odd_rows(spark):
    schema = "text string, lang string, lang_pred int, score string"
    rows = [("the cat and the dog", "en", 1, "x"), ("der hund und die katze", "de", 1, "x"), (None, "en", 1, "x"), ("12 34", "de", 1, "x"), ("", None, 1, "x"), ("the end", None, 1, "x")]
    df = spark.createDataFrame(rows, schema)
    model = language_id.learn(df)
    got = [(r.text, r.lang_pred, r.score) for r in language_id.identify(df, model).collect()]
    assert [g[1] for g in got] == ["en", "de", "und", "und", "und", "en"] and got[2][2] == 0
    empty = language_id.learn(spark.createDataFrame([], schema))
    assert {r.lang_pred for r in language_id.identify(df, empty).collect()} == {"und"}
    assert language_id.identify(spark.createDataFrame([], schema), model).count() == 0


def test_language_id_counts_copies_once(spark):
    """Two texts of very many copies are two texts of the sample, and rare languages are learned beside them."""
    rows = [("the cat sat on the mat", "en")] * 4000 + [("a dog ran over the hill", "en")] * 4000 + [(f"der hund {w} lief ueber den berg", "de") for w in "abcdefghijkl"]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert model.labels == ["de", "en"]
    got = {r.text: r.lang_pred for r in language_id.identify(spark.createDataFrame([("the cat ran over the hill",), ("der hund lief",)], "text string"), model).collect()}
    assert got == {"the cat ran over the hill": "en", "der hund lief": "de"}


@pytest.mark.parametrize("languages", [2, 4, 12])
def test_language_evidence_does_not_depend_on_the_number_of_languages(languages):
    """Held-out texts of learned languages have evidence above the level; those of an unlearned script have none."""
    rng = random.Random(languages)
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(200)] for k in range(languages)}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    model = language_id.fit_kernel([(str(k), language_id.grams(text(k, rng.randint(20, 200)))) for k in words for _ in range(60)])
    held = [(str(k), language_id.grams(text(k, rng.randint(20, 300)))) for k in words for _ in range(40)]
    shares, evidence = model.scores([g for _, g in held])
    assert (evidence >= model.level).all() and np.mean([model.labels[i] == k for i, (k, _) in zip(shares.argmax(1), held, strict=True)]) > 0.97
    strange = [language_id.grams("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(5)) + " " + "".join(chr(rng.randrange(0x3041, 0x3090)) for _ in range(60))) for _ in range(20)]
    assert (model.scores(strange)[1] < model.level).all()


def test_ridge_against_its_normal_equations():
    """Weights of the fit solve the ridge problem on the Nyström features."""
    rng = random.Random(5)
    samples = [(lang, language_id.grams(" ".join(rng.choice(words) for _ in range(30)))) for lang, words in (("x", ["aba", "cada", "bra"]), ("y", ["kuku", "ruku", "zu"]), ("z", ["aba", "zu", "mim"])) for _ in range(20)]
    model = language_id.fit_kernel(samples, landmarks=5, ridge=0.1)
    chosen = [g for k in "xyz" for g in [g for lang, g in samples if lang == k][:5]]
    k = lambda a, b: len(np.intersect1d(a, b)) / math.sqrt(len(a) * len(b))
    gram = np.array([[k(a, b) for b in chosen] for a in chosen])
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-8 * values[-1]
    z = np.array([[k(g, c) for c in chosen] for _, g in samples]) @ (vectors[:, good] / np.sqrt(values[good]))
    y = np.array([[float(lang == x) for x in "xyz"] for lang, _ in samples])
    zc, yc = z - z.mean(0), y - y.mean(0)
    w = np.linalg.solve(zc.T @ zc + 0.1 * len(z) / 3 * np.eye(z.shape[1]), zc.T @ yc)
    want = zc @ w + y.mean(0)
    got = np.hstack((model.kernel([g for _, g in samples]), np.ones((len(samples), 1)))) @ model.weights
    assert np.allclose(got, want, atol=1e-3)


def test_kernel_is_that_of_presences():
    a, b = language_id.grams("Hello, World"), language_id.grams("hello there")
    model = language_id.fit_kernel([("x", a), ("y", b)], landmarks=1)
    k = model.kernel([a, b])
    assert np.allclose(k, [[1, len(np.intersect1d(a, b)) / math.sqrt(len(a) * len(b))], [k[0, 1], 1]], atol=1e-6)


def test_toxicity_counterfactuals():
    """A term that only stands beside insults in the sample weighs little once its swaps are penalised."""
    rng = random.Random(1)
    prose = [f"word{i}" for i in range(40)]
    texts, labels = [], []
    for i in range(400):
        bad = i % 2
        t = [rng.choice(prose) for _ in range(20)] + (["muslim", "idiot"] if bad else [])
        texts.append(t)
        labels.append(float(bad))
    sets = [toxicity.features(t) for t in texts]
    pairs = [(i, toxicity.features(s)) for i, t in enumerate(texts) for s in toxicity.swapped(t)]
    neutral = toxicity.features([*prose[:20], "muslim"])
    z = lambda w: w[neutral].sum() + w[-1]
    fair, plain = toxicity.fit(sets, np.array(labels), pairs, fairness=5.0), toxicity.fit(sets, np.array(labels), [])
    assert z(fair) < 0 and z(fair) < z(plain) - 1
    insult = toxicity.features([*prose[:20], "idiot"])
    assert fair[insult].sum() + fair[-1] > 0


def test_toxicity_held_out_on_the_given_labels(spark):
    """Trained on four folds of the given labels, the fifth is told apart."""
    sf = "/root/testdata/sf0.1"
    from mnemospark.llm.queries import op2_toxicity

    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    rows = op2_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit >= 0.8 * sum(r.toxic == 1 for r in rows) and hit >= 0.8 * sum(r.predicted == 1 for r in rows)


def test_toxicity_sample_ends_at_its_features(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + (i * j) % 26)}" for j in range(30)) + (" idiot" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
    some = toxicity.learn(docs, labels, places=300)
    assert np.count_nonzero(some) < np.count_nonzero(toxicity.learn(docs, labels))


def test_toxicity_threshold_and_odd_rows(spark):
    assert 0.3 < toxicity.threshold(np.array([0.1, 0.2, 0.3, 0.4, 0.9]), np.array([0, 0, 0, 1, 1.0])) < 0.4
    docs = spark.createDataFrame([(1, "nice day", 9), (2, "you idiot", 9), (3, None, 9), (4, "", 9), (None, "fine", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (None, 1), (2, None), (2, 0)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).orderBy("doc_id").collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    empty = toxicity.learn(docs, labels.where("false"))
    assert [r.score for r in toxicity.score(docs, empty).collect()] == [0.5] * 5


def _targets(totals, weights=(3, 1, 2)):
    """The contract, source by source."""
    order = sorted(totals, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    w = {i: weights[i % 3] for i in range(len(order))}
    budget, full = Fraction(3, 2) * sum(n for _, n in order), set()
    while True:
        left, open_ = budget - sum(2 * order[i][1] for i in full), sum(w[i] for i in w if i not in full)
        over = {i for i in w if i not in full and 2 * order[i][1] * open_ <= left * w[i]}
        if not over:
            return [(name, n, float(2 * n) if i in full else float(left * w[i] / open_)) for i, (name, n) in enumerate(order)]
        full |= over


def test_targets_share_the_excess(spark):
    rng = random.Random(3)
    cases = [[("a", 100), ("b", 100), (None, 100)], [("a", 10), ("b", 1000), ("é", 10), (None, 10)], [], [("a", 0), ("b", 0)], [(f"s{i}", rng.randrange(1000)) for i in range(40)]]
    for totals in cases:
        got = mixing.targets(spark.createDataFrame(totals, "source string, source_size long")).collect()
        want = {name: (n, t) for name, n, t in _targets(totals)}
        assert {r.source: (r.source_size, pytest.approx(r.target)) for r in got} == want and len(got) == len(totals)


def test_mixing_cuts_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    rows = [(i, " ".join(["w"] * (i % 7)), "abc"[i % 3] if i % 5 else None, "x") for i in range(60)] + [(None, "a b", None, "x"), (7, None, "a", "x"), (8, "q", "b", "x"), (8, "q", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)
    taken = Counter()
    for r in got:
        taken[r.source, r.target] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(n == math.floor(t) for (_, t), n in taken.items())
    assert mixing.mix(df.where("false")).count() == 0
    whole = mixing.mixed(df).collect()
    most = {}
    for r in got:
        most[r.doc_id, r.source, r.size] = max(most.get((r.doc_id, r.source, r.size), 0), r.copies)
    assert len(whole) == sum(most[r.doc_id, r.source, r.size] for r in got) and whole[0].size == "x"
    clash = df.withColumnsRenamed({"size": "key"}).withColumns({c: mixing.F.lit("y") for c in ("_id", "times", "again", "mix_size", "copies")})
    again = mixing.mixed(clash)
    assert again.columns == clash.columns and again.count() == len(whole) and {r["times"] for r in again.collect()} == {"y"}


def _tokens(path, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_round_trip(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (None, "a  b\n\n c\t<|endoftext|>"), (10**6 + 2, "naïve…! 'don't' 12%%% é x"), (10**6 + 3, "word " * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    pieces = packing.pack(df, TOKENIZER).collect()
    ids = {i: _tokens(TOKENIZER, t) for i, t in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and p.doc_tokens == len(ids[p.doc_id])
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert by_doc.keys() == ids.keys()
    for parts, whole in ((by_doc, {i: len(x) for i, x in ids.items()}), (by_sequence, {})):
        for k, spans in parts.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at and length > 0
                at += length
            assert at == whole.get(k, at) and (whole or at <= 1024)
    total = sum(map(len, ids.values()))
    assert len(by_sequence) * 1024 <= total + 5 * 1024
    assert packing.pack(df.where("false"), TOKENIZER).count() == 0


def test_encoder_gives_the_tokenizer_s_ids():
    """The ranked encoder against the library the file is for, over odd white space, scripts and added tokens."""
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    assert mine.ranked is not None
    rng = random.Random(6)
    pool = [*" \n\t\r\u0085\u00a0\u2028\u3000\ufeffabcXYZ019.,!-_'\"éßжα日本😀", "'s", "'LL", "  ", "\n\n", " \n", "<|endoftext|>", *(chr(rng.randrange(0xD800)) for _ in range(300))]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(4000)] + ["ab" * 50_000, "hello <|endoftext|> world"]
    for t, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.ids(t) == e.ids
    assert mine.ids(texts[-1]) == [31373, 220, 50256, 995]
    mine.ranked = None  # files of another kind
    assert all(mine.ids(t) == whole.encode(t, add_special_tokens=False).ids for t in texts[:50])


def test_hilbert_curve_is_one_path():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_key(points, 3)
    path = points[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def _pages():
    big = "<p>" + "é" * 600 + "</p>"
    return [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "u\r\nX: y", "<p>x</p>"), (5, "u", "<p>x</p>"), (6, "u", None), (7, "u", ""), (None, "u", "z" * 2000), (None, "v", "z" * 2000), (8, "r", "k" * 1500), (8, "r", "k" * 1500), (9, "u", "\r\n\r\n" * 400)]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in _pages()], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(df, limit=700).cache()
    assert archives.count() > 2
    rows = warc.read_archives(archives).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    last = {"<p>" + "é" * 600 + "</p>": 3, "k" * 1500: 8}
    want = []
    for i, _, h in _pages():
        b = (h or "").encode()
        ref = last.get(h) if last.get(h) != i else None
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if ref else "response", ref))
    assert got == sorted(want)
    names = {r.name for r in warc.export(archives, str(tmp_path / "out")).collect()}
    warc.export(archives, f"file://{tmp_path}/out").collect()  # a second run replaces the files
    assert {f.name for f in (tmp_path / "out").iterdir() if f.suffix == ".zst"} == names
    again = warc.read_files(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert warc.read_archives(warc.write_archives(df.where("false"))).count() == 0


def test_warc_reader_checks():
    made = warc._record(1, "u", b"hello", None, False, "2024-01-01T00:00:00Z")
    fields, block = warc.parse_record(made)
    assert warc._page(fields, block)[2:5] == (b"hello", 5, hashlib.sha1(b"hello").hexdigest())
    for bad in (made[:-1], made.replace(b"Content-Length: %d" % len(block), b"Content-Length: %d" % (len(block) + 1), 1), made.replace(b"Content-Length: 5\r", b"Content-Length: 6\r"), made.replace(b"WARC/1.1", b"HTTP/1.1"), made.replace(b"WARC-Date", b"WARC-Dat"), made.replace(b"hello", b"hellO")):
        with pytest.raises(ValueError):
            warc._page(*warc.parse_record(bad))
    samples = [f"<p>page {i} of the archive {i * 7}</p>".encode() * 9 for i in range(300)]
    raw = zstandard.train_dictionary(2000, samples).as_bytes()
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(b"record")
    for lead in (raw, zstandard.ZstdCompressor().compress(raw)):
        archive = struct.pack("<II", 0x184D2A5D, len(lead)) + lead + frame + frame
        assert list(warc.frames(archive)) == [b"record", b"record"]
        for cut in (archive[:-3], archive[:20], archive + b"junk", archive[:-len(frame)] + b"\0" + frame[1:]):
            with pytest.raises(ValueError):
                list(warc.frames(cut))


def test_lm_base_and_normalisation(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "On", "mat", f"x{i}"]) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(100, None), (101, ""), (None, "The end")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = {r.doc_id: r for r in lm_scoring.score_held_out(df, steps=50).collect()}
    held = lambda i: zlib.crc32(str(i if i is not None else "null").encode()) % 5 == 1
    tok = {i: [*(t or "").lower().split(), None] for i, t in rows}
    c = Counter(w for i, t in tok.items() if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for i, t in tok.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-6)
        assert r.score < 0
    assert lm_scoring.score_held_out(df.where("false")).count() == 0
    assert {r.n_known for r in lm_scoring.score_held_out(df.where("doc_id = 100"), held=zlib.crc32(b"100") % 5, steps=50).collect()} == {0}


def test_lm_with_a_small_head(spark):
    """Words beyond the broadcast head are found by the join."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 200}" for k in range(40)) + f" rare{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm_scoring.learn(df, steps=50)
    full = {r.doc_id: r for r in lm_scoring.score(df, model).collect()}
    known, tail = lm_scoring.lexicon(df, head=230)
    small = {r.doc_id: r for r in lm_scoring.score(df, lm_scoring.Model(known, tail, model.table)).collect()}
    assert len(known.head) < len(model.known.head)
    for i, r in full.items():
        assert (r.n_known, r.base_score, r.score) == pytest.approx((small[i].n_known, small[i].base_score, small[i].score))


def test_lm_learns():
    rng = np.random.default_rng(0)
    seq = np.array([0, 1, 2, 3] * 400)
    noise = rng.random(len(seq)) < 0.1
    seq[noise] = rng.integers(0, 4, noise.sum())
    n = 12
    table = lm_scoring.train(seq, n, steps=800)
    assert np.allclose(np.exp(table).sum(1), 1)
    assert table[seq[:-2] * n + seq[1:-1], seq[2:]].mean() > -0.8 > -math.log(4)


def test_lm_learns_contexts_of_content_words(spark):
    """Each of 400 words has one successor, which only a model that tells all of them apart can know."""
    rng = random.Random(4)
    after = rng.sample(range(400), 400)

    def chain(at):
        out = []
        for _ in range(40):
            out.append(f"w{at}")
            at = after[at]
        return " ".join(out)

    df = spark.createDataFrame([(i, chain(rng.randrange(400))) for i in range(500)], "doc_id long, text string")
    held = [r for r in lm_scoring.score_held_out(df, steps=400).collect() if r.held_out]
    per_token = sum(r.score for r in held) / sum(r.n_tokens for r in held)
    assert sum(r.base_score for r in held) / sum(r.n_tokens for r in held) < -2.5 and per_token > -1.5


def test_lm_symbols_follow_the_corpus_and_scores_sum_to_one(spark):
    """Words from the least count on are symbols, rarer and unknown ones share symbols; scores against sums over all symbols."""
    rng = random.Random(5)
    rows = [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(30)] + [f"rare{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(w for _, t in rows for w in t.split())
    model = lm_scoring.learn(df, head=10, steps=20)
    m, t = model.known, model.table
    least = max(lm_scoring.LEAST, math.ceil(math.sqrt(sum(counts.values()) + 200) / lm_scoring.FINE))
    own = {w for w, n in counts.items() if n >= least}
    assert {w.decode() for w, i in m.head.items() if i < m.own} == own and len(own) > 200
    shares = np.zeros(m.shared)
    for w in counts.keys() - own:
        shares[zlib.crc32(w.encode()) % m.shared] += counts[w] + 0.5
    assert m.mass == pytest.approx(shares + 0.5)

    def logs(u, v):  # of every symbol after u and v, in double precision
        h = np.float64(t.first[u]) + np.float64(t.second[v])
        group = t.g @ h + t.bg
        group -= np.log(np.exp(group).sum())
        word = t.q @ h + t.b
        at = np.arange(len(word)) // t.size
        return group[at] + word - np.log(np.bincount(at, np.exp(word)))[at]

    got = {r.doc_id: r for r in lm_scoring.score(df.union(spark.createDataFrame([(900, "w1 never seen W2 rare7")], df.schema)), model).collect()}
    for i, text in [*rows[:20], (900, "w1 never seen W2 rare7")]:
        u = v = m.start
        total = 0.0
        for w in [*text.lower().encode().split(), None]:
            s = m.start - 1 if w is None else m.head[w] if m.head.get(w, m.own) < m.own else m.own + zlib.crc32(w) % m.shared
            after = logs(u, v)
            assert np.exp(after).sum() == pytest.approx(1)
            total += after[s] / math.log(10)
            if m.own <= s < m.own + m.shared:
                total += math.log10((counts[w.decode()] + 0.5) / m.mass[s - m.own])
            u, v = v, s
        assert got[i].score == pytest.approx(total, abs=1e-3)
    # a rare word beyond the head scores alike, whether its count comes by broadcast or by the join
    wide, _ = lm_scoring.lexicon(df)
    assert len(wide.head) > len(m.head)
    many = {r.doc_id: r for r in lm_scoring.score(df, lm_scoring.Model(wide, model.tail.where("false"), t)).collect()}
    for i, _ in rows:
        assert (got[i].n_known, got[i].base_score, got[i].score) == pytest.approx((many[i].n_known, many[i].base_score, many[i].score))


def test_lm_gains_on_the_given_documents(spark):
    """On held-out documents, the model beats the smoothed counts by a fifth of a decimal digit a token."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    r = lm_scoring.score_held_out(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert (r.s - r.b) / r.n > 0.1


def test_pipeline_stages(spark, sf_dir):
    """Every stage against what its input says by brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [stage for _, stage in corpus_pipeline.STAGES]
    one = kept[0](spark, docs, sf_dir).cache()
    assert one.columns == columns and one.count() >= 0.99 * docs.where("text rlike '[A-Za-z]'").count()
    two = kept[1](spark, one, sf_dir).cache()
    last = {}
    for r in one.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert two.columns == columns and {r.doc_id for r in two.collect()} == set(last.values())
    three = kept[2](spark, two, sf_dir).cache()
    from tests.llm.test_dedup import _brute_near

    near = _brute_near([(r.doc_id, r.text) for r in two.collect()], 5)
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {i for i, (_, c) in near.items() if i == c}
    four = kept[3](spark, three, sf_dir).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(three).collect() if r.copies}
    assert four.columns == columns and Counter(r.doc_id for r in four.collect()) == copies
    five = kept[4](spark, four, sf_dir).collect()
    assert sum(p.length for p in five) == sum(len(_tokens(TOKENIZER, r.text)) for r in four.collect())
    empty = docs.where("false")
    for stage in kept[:-1]:
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_stages_with_odd_rows(spark, sf_dir):
    """Nulls in every column, empty, repeated and very long texts, and columns with the names that stages use inside."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = [(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6 + 1, "12 34 --", None, "web", 8), (10**6 + 2, "word " * 60_000, "en", "web", 300_000), (None, "the end of the long story", "en", "web", 3)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    docs = docs.union(docs.where("doc_id % 7 = 0 or doc_id is null"))
    clash = ("_key", "_text", "key", "rows", "row", "kept_row", "lang_pred", "score", "evidence", "found", "times", "again", "rid", "kept", "size")
    docs = docs.withColumns({c: F.lit("x") for c in clash}).withColumn("props", F.create_map(F.lit("a"), F.col("doc_id")))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        n = docs.count()
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns and {r[c] for r in docs.select(*clash).collect() for c in clash} == {"x"}, name
        assert name == "source_mixing" or docs.count() <= n
    texts = [r.text for r in docs.collect()]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sum(p.length for p in pieces) == sum(len(_tokens(TOKENIZER, t)) for t in texts)
