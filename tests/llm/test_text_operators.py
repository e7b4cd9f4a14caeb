"""Operators that read one text at a time: base rules, patterns, tokens, languages, scores."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import bpe, kernels as K, langid, llr, pii, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, kind string, id string, score double"


def rows_of(texts, lang="en"):
    return [(i, t, lang, "x", "y", 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and long texts, repeated rows, and extra columns with names that operators use."""
    texts = [None, "", "   \n\t ", "one", "Ünï çödé 世界 🙂 words", "a b c a b c\nline\nline\n", "w" * 50_000, "long text of words. " * 8000, "123 456", "\x0b\x0c"]
    rows = rows_of(texts) + [(5, texts[5], "en", "x", "y", 0.5), (None, "null id text here", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def random_text(rng, n):
    return "".join(rng.choice(["a", "b", "A", " ", "  ", "\n", "\t", "é", "世", "#", "|", "1", "."]) for _ in range(n))


def test_words_and_hashes_follow_the_pattern():
    rng = random.Random(1)
    texts = [random_text(rng, rng.randrange(0, 60)) for _ in range(300)] + [None, ""]
    t = K.texts(pa.array(texts, pa.string()))
    ws, we, first = K.words(t)
    h = K.Hasher(t.data).spans(ws, we)
    seen = {}
    for i, text in enumerate(texts):
        got = [bytes(t.data[a:b]).decode() for a, b in zip(ws[first[i] : first[i + 1]], we[first[i] : first[i + 1]])]
        assert got == WORD.findall(text or "")
        for w, x in zip(got, h[first[i] : first[i + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, g in enumerate(tri):
        if tri.count(g) > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rule_counts_match_brute_force(spark):
    rng = random.Random(2)
    texts = [random_text(rng, rng.randrange(0, 80)) for _ in range(200)] + [None, "", "x y z x y z\nx y z\n\n \nx y z\n"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: r for r in llr.score(docs, np.zeros(llr.BUCKETS, np.float32)).collect()}
    for i, text in enumerate(texts):
        n, chars, symbols, dup, repeat = brute_rules(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), text
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (not r.base_failed)


def test_llr_prefers_the_target(spark, odd, empty):
    rng = random.Random(3)
    good = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(30)) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(rng.choice("uno dos tres cuatro cinco seis siete ocho nueve diez".split()) + str(rng.randrange(30)) for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame(rows_of(good + bad), SCHEMA).withColumn("trusted", F.when(F.col("doc_id") < 30, True))
    got = {r.doc_id: r.llr for r in llr.score(docs, llr.train(docs, "trusted")).collect()}
    assert min(got[i] for i in range(60)) > max(got[i] for i in range(60, 120))
    # the same counts by hand
    counts = {r.bucket: (r.n_raw, r.n_target) for r in llr.count_buckets(docs, "trusted").collect()}
    assert sum(a for a, _ in counts.values()) == sum(80 + 79 for _ in range(120))
    assert sum(b for _, b in counts.values()) == sum(80 + 79 for _ in range(30))
    assert llr.score(odd, np.zeros(llr.BUCKETS, np.float32)).count() == odd.count()
    assert not llr.train(empty.withColumn("trusted", F.lit(True)), "trusted").any()


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_patterns_match_plain_expressions():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "x@y.z", "@@", ".", "-", "+", "1", "25", "255", "256.1.2.3", "1.2.3.4", " ", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "é", "(", "+49", "000.00.1.2", "5105-1051-0510-5100"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000 + "+" * 100_000) == []


def test_windows_agree_with_one_long_window(monkeypatch):
    """Windows decode as one window of the whole text, but for what they can't see; skipping the algorithm changes nothing."""
    texts = [f"word more {'text ' * k}mail{k}@host{k}.example.com then 10.20.30.{k} and +1 (555) 010-{1000 + k} end" for k in range(40)]
    model = pii.fit(texts, epochs=100)
    text = " ".join(texts)
    c, starts = pii.classes(text), np.array([0, len(text)])
    decoder = pii.Decoder(model)
    windows = decoder.tag(c, starts)
    decoder.margin = 1e9  # now every window is decoded in full
    assert (decoder.tag(c, starts) == windows).all()
    monkeypatch.setattr(pii, "WINDOW", len(text) + 10)
    monkeypatch.setattr(pii, "STRIDE", len(text) + 5)
    whole = pii.Decoder(model).tag(c, starts)
    assert (whole == windows).mean() > 0.995
    truth = np.zeros(len(text), int)
    for kind, s, e in pii.base_spans(text):
        truth[s:e] = pii.KINDS.index(kind) + 1
    assert (windows == truth).mean() > 0.97


def test_pii_counts_digests_and_redaction(spark, odd, empty):
    texts = ["mail a.b@c.de now", "ip 1.2.3.4, card 4111 1111 1111 1111", None, "", "nothing"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: r for r in pii.find(docs, None).collect()}
    for i, text in enumerate(texts):
        spans = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(text or ""))
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert got[i].spans == spans
    red = {r.doc_id: r.text for r in pii.redact(docs, None).collect()}
    assert red == {0: "mail [email] now", 1: "ip [ip], card [card]", 2: None, 3: "", 4: "nothing"}
    model = pii.train(docs)
    assert pii.find(odd, model).count() == odd.count()
    assert pii.find(empty, pii.train(empty)).count() == 0
    assert pii.redact(odd, model).columns == odd.columns


def test_bpe_is_the_library_on_whole_texts(spark, odd, empty):
    import public_tokenizers as P

    rank_file = P.path("byte_bpe_50k.tiktoken")
    with open(rank_file, "rb") as f:
        enc = bpe.codec(f.read(), P.PATTERN)
    rng = random.Random(5)
    pool = ["word", " ", "  ", "\n", "'s", "don't", "é", "世界", "123", "...", " a b", " ", "<|endoftext|>", "\x1c", "\x85", "🙂"]
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))
        assert "".join(bpe.pieces(text, 5)) == text
        assert bpe.encode(enc, text, 5).tolist() == enc.encode_ordinary(text)
    got = bpe.encode_documents(odd, rank_file, P.PATTERN).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        ids = enc.encode_ordinary(by_id[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest()
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode_documents(bpe.encode_documents(odd, rank_file, P.PATTERN), rank_file, P.PATTERN).collect()}
    assert back == by_id
    assert bpe.encode_documents(empty, rank_file, P.PATTERN).count() == 0


def test_languages_and_mixtures(spark, odd, empty):
    rng = random.Random(6)
    vocab = {"aa": "the of and to in is was for with that".split(), "bb": "der die das und ist nicht mit ein von zu".split(), "cc": "le la les de et un une dans pour que".split()}
    make = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n))
    rows = [(i, make(k, 40), k, "", "", 0.0) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    docs = spark.createDataFrame(rows + [(200, "text", None, "", "", 0.0)], SCHEMA)
    model = langid.train(docs)
    assert model[0] == ["aa", "bb", "cc"]
    tests = [(i, make(k, 30), k, "", "", 0.0) for i, k in enumerate(["aa", "bb", "cc"] * 10)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(tests, SCHEMA), model).collect()}
    assert all(got[t[0]].lang_pred == t[2] and got[t[0]].n_langs == 1 for t in tests)
    mixed = spark.createDataFrame([(0, make("aa", 60) + " " + make("bb", 30), None, "", "", 0.0)], SCHEMA)
    r = langid.predict(mixed, model).first()
    assert (r.lang_pred, r.langs, r.n_langs) == ("aa", "aa,bb", 2) and 0.5 < r.score < 0.8
    by = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (8, "und"), (9, "und")} <= by
    assert langid.predict(odd, langid.train(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, model).count() == 0


def test_quality_rules_learn_and_compile(spark, odd, empty):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(100)) + "." for _ in range(120)]
    bad = [" ".join([rng.choice(words)] * 50 + [rng.choice(words)] * 50) for _ in range(60)] + [" ".join(rng.choice(words).upper() + "!!" for _ in range(100)) for _ in range(60)]
    docs = spark.createDataFrame(rows_of(good + bad), SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 240, 2)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    assert model[1] and all(w for w, _ in model[1])
    got = {r.doc_id: r.score for r in quality.with_statistics(docs).select("doc_id", quality.compile_score(model).alias("score")).collect()}
    assert np.mean([(got[i] >= 0.7) == (i < 120) for i in range(1, 240, 2)]) > 0.97
    # the compiled expression is the ensemble
    x = quality.text_statistics(K.texts(pa.array(good + bad)))
    z = model[0] + sum(w * quality._holds(rule, x) for w, rule in model[1])
    assert np.allclose([got[i] for i in range(240)], 1 / (1 + np.exp(-z)), atol=1e-9)
    scored = quality.with_statistics(odd).select("doc_id", quality.compile_score(model).alias("score"))
    assert scored.where("score between 0 and 1").count() == odd.count()
    assert quality.compile_score(quality.train(empty, labels)) is not None
    assert quality.with_statistics(empty).count() == 0


def brute_marginals(e, move):
    n = len(e)
    total, toxic = 0.0, np.zeros(n)
    for code in range(1 << n):
        s = [(code >> i) & 1 for i in range(n)]
        w = np.exp(sum(e[i] for i in range(n) if s[i]) + sum(move[s[i - 1], s[i]] for i in range(1, n)))
        total += w
        toxic += w * np.array(s)
    return toxic / total


def test_marginals_match_enumeration():
    rng = np.random.default_rng(8)
    sizes = [3, 0, 1, 6, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, move = rng.normal(0, 2, first[-1]), rng.normal(0, 1, (2, 2))
    got = toxicity.marginals(e, first, move)
    for i, n in enumerate(sizes):
        if n:
            assert np.allclose(got[first[i] : first[i + 1]], brute_marginals(e[first[i] : first[i + 1]], move), atol=1e-9)


def test_toxic_spans_and_scores(spark, odd, empty):
    rng = random.Random(9)
    clean = [f"word{k}" for k in range(200)]
    toxic = ["vilename", "badslur"]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(clean) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(toxic)
        rows.append(" ".join(words))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows_of(rows), SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] < 160], "doc_id bigint, toxic int")
    model = toxicity.train(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == y for i, y in labels if i >= 160)
    for i, y in labels:
        found = [rows[i][int(s) : int(e)] for s, e in (x.split(":") for x in got[i].spans.split(",") if x)]
        assert {w for f in found for w in f.split()} == ({w for w in rows[i].split() if w in toxic} if y else set())
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == odd.count()
    none = toxicity.train(empty, known)
    assert toxicity.score(odd, none).where("predicted = 0").count() == odd.count()
    assert toxicity.score(empty, model).count() == 0


def test_added_spans_touch_no_pattern_and_are_not_refuted():
    mark = lambda text, kind: pii._added(np.full(len(text), pii.KINDS.index(kind) + 1), pii.base_spans(text), text)
    assert mark(" joe@localhost ", "email") == [("email", 1, 14)]
    assert mark("los.klan", "email") == mark("was there at", "email") == []  # no at sign
    assert mark("joe (AT) host.org", "email") == [("email", 0, 17)] and mark("joe at host dot org", "email") == [("email", 0, 19)]
    assert mark("1234567812345678", "card") == []  # a card's form without its check digit
    assert mark("300.1.1.1", "ip") == [] and mark("a@b.cd", "email") == []  # failed, and a pattern's own
    assert mark("call 555 0101", "phone") == [("phone", 0, 13)]


def test_only_what_failed_a_check_is_refuted():
    mark = lambda text, kind: pii._added(np.full(len(text), pii.KINDS.index(kind) + 1), pii.base_spans(text), text)
    for gap in (".", "  ", "\t", "\u00a0"):
        assert mark(gap.join(["4111", "1111", "1111", "1111"]), "card") == [("card", 0, 16 + 3 * len(gap))]
        assert mark(gap.join(["4111", "1111", "1111", "1112"]), "card") == []
    assert mark("+1 (555) 123/4567", "phone") == [("phone", 0, 17)]
    assert mark("+1 (555) 123", "phone") == mark("at +1 555 12", "phone") == []  # too few digits


def test_language_sets_are_the_best_of_all():
    rng = np.random.default_rng(9)
    logp = np.log(rng.dirichlet(np.full(300, 0.05), 5).T + 1e-6).astype(np.float32)
    logp = np.tile(logp, (langid.BUCKETS // 300 + 1, 1))[: langid.BUCKETS]
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)]
    gram, begin, _ = langid._trigrams(K.texts(pa.array([" ".join(words)])))
    like = np.add.reduceat(logp[gram], begin[:-1], axis=0)
    of = like.argmax(1)
    texts = [" ".join(rng.choice([w for w, k in zip(words, of) if k < m], 150)) for m in (1, 2, 3, 4, 5)] + ["", " ".join(rng.choice(words, 30))]
    pi, n, found = langid.infer(K.texts(pa.array(texts)), logp, 3.0)
    assert n.max() == 5 and 4 in n and not found[5]
    for text, shares, k in zip(texts, pi, n):
        if not text:
            continue
        g, b, _ = langid._trigrams(K.texts(pa.array([text])))
        w = np.add.reduceat(logp[g], b[:-1], axis=0).astype(float)
        x = np.exp(np.maximum(w - w.max(1, keepdims=True), -30))
        value = {}
        for size in range(1, 6):
            for some in itertools.combinations(range(5), size):
                p = np.full(size, 1 / size)
                for _ in range(500):
                    p = (x[:, some] * p / (x[:, some] @ p)[:, None]).mean(0)
                value[some] = np.log(x[:, some] @ p).sum() - 3 * (size - 1) * np.log(len(x))
        mine = tuple(np.flatnonzero(shares).tolist())
        assert len(mine) == k and value[mine] >= max(value.values()) - 0.1


def test_network_gradients_match_differences():
    rng = np.random.default_rng(3)
    m = pii.new_tagger(rng, 3)
    for p in (*m.x, *m.u, *m.v, m.b, m.move):
        p *= 0.3  # away from where activations bend
    c, y = rng.integers(0, 130, (9, 4)), rng.integers(0, 5, (9, 4))
    m = pii.Tagger(*([a.astype(np.float64) for a in group] for group in (m.x, m.u, m.v)), m.b.astype(np.float64), m.move.astype(np.float64))
    _, grads = pii._gradients(m, c, y)
    for p, g in zip((*m.x, *m.u, *m.v, m.b, m.move), grads):
        for _ in range(6):
            at = tuple(int(rng.integers(k)) for k in p.shape) if rng.random() < 0.5 else np.unravel_index(np.abs(g).argmax(), g.shape)
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = pii._gradients(m, c, y)[0]
            p[at] = old - eps
            down = pii._gradients(m, c, y)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-2 * max(1.0, abs(g[at]))


def test_the_lattice_is_decoded_as_a_whole():
    rng = np.random.default_rng(4)
    settled = 0
    for trial in range(40):
        m = pii.new_tagger(rng)
        m.move[:] = rng.normal(0, 2, (5, 5))
        m.move[0, 0] += rng.choice([0, 3])
        decoder = pii.Decoder(m)
        sizes = [0, 1, 2, 7, 120, 30, 0]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        em = rng.normal(0, 2, (starts[-1], 5)).astype(np.float32)
        em[:, 0] += 12 * (rng.random(starts[-1]) < 0.8)
        got = decoder.best(em, starts)
        settled += (~decoder.doubtful(em, starts)).sum()
        for a, b in zip(starts[:-1], starts[1:]):
            if a == b:
                continue
            total = em[a].astype(float)
            for t in range(a + 1, b):
                total = (total[:, None] + m.move).max(0) + em[t]
            path = got[a:b].tolist()
            score = sum(float(em[a + i, x]) for i, x in enumerate(path)) + sum(float(m.move[x, z]) for x, z in zip(path, path[1:]))
            assert abs(total.max() - score) < 1e-3
    assert settled > 1000


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("the", "on", "ver", "mit", "el") for b in ("", "ing", "ton", "da")]
    texts = [" ".join(rng.choice(words) for _ in range(120)) + f" a{i}.b@host{i}.example.org, 10.0.{i % 250}.7 or +1 555 010 {1000 + i} and {i * 7919}" for i in range(300)]
    return pii.train(spark.createDataFrame(rows_of(texts), SCHEMA)), words


def test_the_network_finds_planted_forms_that_patterns_miss(spark, trained):
    model, words = trained
    rng = np.random.default_rng(99)
    texts, truth = [], {}
    for i in range(300):
        text, spans = "", []
        for k in range(60):
            text += " " * bool(k) + words[int(rng.integers(len(words)))]
            if k % 20 == 10:
                what, label = pii.planted(rng)
                if label:
                    spans.append((pii.KINDS[label - 1], len(text) + 1, len(text) + 1 + len(what)))
                text += " " + what
        base = pii.base_spans(text)
        truth[i] = [s for s in spans if not any(s[1] < e and b < s[2] for _, b, e in base)]
        texts.append(text)
    rows = pii.find(spark.createDataFrame(rows_of(texts), SCHEMA), model).collect()
    found = hit = total = 0
    for r in rows:
        base = pii.base_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in pii.KINDS)
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(spans) and r.n_added == len(spans) - len(base)
        close = lambda a, b: a[0] == b[0] and min(a[2], b[2]) - max(a[1], b[1]) >= 0.8 * (b[2] - b[1])
        found += r.n_added
        total += len(truth[r.doc_id])
        hit += sum(any(close(s, t) for s in spans if s not in base) for t in truth[r.doc_id])
    assert total > 300 and hit / total > 0.7 and hit / found > 0.85


def test_long_texts_are_labelled_in_parts_as_in_one(trained, monkeypatch):
    model, words = trained
    rng = np.random.default_rng(98)
    text = " ".join(words[int(rng.integers(len(words)))] + (" " + pii.planted(rng)[0] if rng.random() < 0.05 else "") for _ in range(6000))
    decoder, starts = pii.Decoder(model), np.array([0, len(text)])
    whole = decoder.tag(pii.classes(text), starts)
    monkeypatch.setattr(pii, "TOGETHER", 4000)
    assert whole.any() and (decoder.tag(pii.classes(text), starts) == whole).all()


def test_the_threshold_follows_the_trusted_scores(spark, empty):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame(rows_of([" ".join(rng.choice(words) for _ in range(rng.randrange(20, 200))) for _ in range(200)]), SCHEMA).withColumn("trusted", F.col("doc_id") < 120)
    ratio = llr.train(docs, "trusted")
    scores = np.sort([r.llr for r in llr.score(docs.where("trusted"), ratio).collect()])
    got = llr.threshold_of(docs.where("trusted"), ratio)
    assert abs(got - (2 * scores[1] - scores[59])) < 4 / llr.CELLS
    assert llr.threshold_of(empty, ratio) == float("-inf")
