"""Operators that compare documents or write archives, against brute force on small tables."""

import base64
import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import components, decontam, kernels as K, minhash, suffix, warc

SCHEMA = "doc_id bigint, text string, id string, kind int, blob string, component string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, None, "c") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))], SCHEMA)


# --- components


def test_components_are_the_smallest_reachable(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in list(parent)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- near-duplicates


def brute_near(texts, n, percent):
    sets = {}
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_match_brute_force(spark, words):
    rng = random.Random(words)
    vocab = [f"v{k}" for k in range(300)]
    texts, i = {}, 0
    for _ in range(12):  # a base and copies with a few changes each, so that copies differ among themselves
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 160))]
        for _ in range(rng.randrange(2, 10)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts[i := i + 1] = " ".join(w)
    base = [rng.choice(vocab) for _ in range(100)]
    for k in range(60):  # a large group whose links need a hub or lie near the threshold
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(100)] = f"own{k}"
        texts[i := i + 1] = "  ".join(w).upper() if k % 3 == 0 else " ".join(w)
    for t in [None, "", "  \n", "one", "ONE", "one two", "one  two", "one two three", " ".join(vocab) * 300]:
        texts[i := i + 1] = t
    want = brute_near(texts, words, 80)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), words=words).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.component_id == k) for k, r in got.items())


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d e f", "x", 1, None, "c"), (1, "a b c d e f", "x", 1, None, "c"), (None, "a b c d e f", "x", 1, None, "c"), (2, "a b c d e f", None, None, None, None), (3, None, None, None, None, None)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (3, 0, 3, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates_are_close_to_similarities():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(1, 2**63, 2000).astype(np.uint64)
        cut = int(2000 * share)
        own = rng.integers(1, 2**63, 2000 - cut).astype(np.uint64)
        a, b = both, np.concatenate([both[:cut], own])
        m = minhash._minima(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        bits = K.mix(m) & K.U64((1 << minhash.B) - 1)
        equal = (bits[0] == bits[1]).mean()
        chance = 2.0**-minhash.B
        assert abs((equal - chance) / (1 - chance) - cut / (4000 - cut)) < 0.17


# --- repeated bytes


def brute_suffix(texts, length):
    seen, gone = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        out = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                out[p : p + length] = True
            seen.add(s)
        gone[i] = (b, out)
    return gone


@pytest.mark.parametrize("seed, length", [(0, 100), (1, 100), (2, 100), (3, 400), (4, 30)])
def test_removed_bytes_match_brute_force(spark, seed, length):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    shared = [piece(n) for n in (60, 99, 100, 101, 140, 300, 700)]
    texts = {}
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else piece(rng.randrange(0, 200)))
        texts[i * 3 + rng.randrange(3)] = "".join(parts)
    texts |= {1000: None, 1001: "", 1002: "a" * 5000, 1003: "ab" * 2000, 1004: texts[min(texts)], 1005: shared[5] * 4, 1006: piece(100_000)}
    want = brute_suffix(texts, length)
    got = {r.doc_id: r for r in suffix.remove_repeats(frame(spark, texts), length=length).collect()}
    assert set(got) == set(texts)
    for i, (b, gone) in want.items():
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.diff(gone.astype(int), prepend=0).clip(0).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
        assert bytes(r.kept) == kept


def test_removal_of_odd_rows(spark):
    rng = random.Random(11)
    long = "".join(rng.choice("abcdefgh") for _ in range(154))
    rows = [(5, long, "x", 1, None, "c"), (5, long, "x", 1, None, "c"), (None, long, "x", 1, None, "c"), (9, long, None, None, None, None)]
    got = sorted(((r.doc_id, r.n_removed) for r in suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(5, 0), (5, 0), (None, 0), (9, len(long))], key=str)
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_batches_are_added_to_stored_levels(spark, tmp_path):
    rng = random.Random(31)
    piece = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    shared = [piece(n) for n in (60, 101, 140, 300, 700)]
    texts = {i: "".join(rng.choice(shared) if rng.random() < 0.3 else piece(rng.randrange(0, 300)) for _ in range(rng.randrange(1, 7))) for i in range(120)}
    texts[119] = texts[3]
    want = brute_suffix(texts, 100)
    index, cuts, sizes = str(tmp_path / "index"), [0, 40, 50, 60, 63, 66, 110, 120], []
    for a, b in zip(cuts, cuts[1:]):
        batch, before = ({i: texts[i] for i in range(*r)} for r in ((a, b), (0, a)))
        for r in suffix.remove_repeats(frame(spark, batch), index=index, earlier=frame(spark, before)).collect():
            data, gone = want[r.doc_id]
            assert (r.n_removed, bytes(r.kept)) == (int(gone.sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()), r.doc_id
        sizes.append([n for _, n in suffix.StoredLevels(spark, index, 100, 24).state["levels"]])
    assert all(x > 2 * y for level in sizes for x, y in zip(level, level[1:])) and max(map(len, sizes)) > 1
    with pytest.raises(ValueError):
        suffix.remove_repeats(frame(spark, {5: "x"}), index=index, earlier=frame(spark, texts))
    with pytest.raises(ValueError):
        suffix.remove_repeats(frame(spark, {500: "x"}), length=50, index=index)


def test_windows_are_in_the_order_of_their_letters():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 3000).astype(np.uint8)  # with zeros, which end strings elsewhere
    data[1000:1200] = data[:200]
    at = np.arange(2900)
    order, new = suffix.suffix_order(data, at, 100)
    windows = [bytes(data[k : k + 100]) for k in range(2900)]
    assert [windows[k] for k in order] == sorted(windows) and new.sum() == len(set(windows)) < 2900
    f = suffix.prints(data, at, 100)
    assert len(set(f.tolist())) == len(set(windows)) and all(f[k] == f[k + 1000] for k in range(100))


def test_text_ids_have_the_order_of_their_values(spark):
    rng = random.Random(41)
    long = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [("b", long), ("a", long[:200]), ("c", long[150:]), (None, long)]
    got = {r.name: r.n_removed for r in suffix.remove_repeats(spark.createDataFrame(rows, "name string, text string"), id_column="name").collect()}
    assert got == {"a": 0, "b": 200, "c": 150, None: 0}
    near = minhash.near_duplicates(spark.createDataFrame([(k, t) for k, t in [("y", "a b c d e f g"), ("x", "a b c d e f g"), (None, "a b c"), ("z", "other words")]], "name string, text string"), id_column="name")
    assert {r.name: (r.component_id, r.kept) for r in near.collect()} == {"x": ("x", True), "y": ("x", False), "z": ("z", True), None: (None, True)}


def test_levels_grow_geometrically_and_find_all_repeats():
    rng = np.random.default_rng(4)
    family, late, rows = suffix.LevelFamily(), set(), []
    for batch in range(40):
        n = int(rng.integers(1, 50))
        f, d, s = rng.integers(0, 300, n).astype(np.uint64), rng.integers(0, 1000, n), rng.integers(0, 1000, n).astype(np.int32)
        rows += zip(f.tolist(), d.tolist(), s.tolist())
        late |= set(zip(*(x.tolist() for x in family.insert(f, d, s))))
    first = {}
    for f, d, s in rows:
        first[f] = min(first.get(f, (d, s)), (d, s))
    assert late >= {(d, s) for f, d, s in rows if (d, s) != first[f]} and not late & ({first[f] for f in first} - {(d, s) for f, d, s in rows if (d, s) != first[f]})
    sizes = [len(level[0]) for level in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(first)


# --- decontamination


def bm25(index_texts, passage, threshold):
    """All (entry, score) by definition."""
    index = decontam.Index(list(range(len(index_texts))), index_texts, threshold)
    words = set(decontam.term_hashes(K.texts(pa.array([passage])))[0].tolist())
    scores = defaultdict(float)
    for t, h in enumerate(index.terms.tolist()):
        if h in words:
            for e, w in zip(*index.posting(t)[:2]):
                scores[e] += w
    found = index.wand([t for t, h in enumerate(index.terms.tolist()) if h in words])
    return {e: s for e, s in scores.items() if s >= threshold - 1e-9}, dict(found)


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(5)
    vocab = [f"t{k}" for k in range(60)]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(6, 40))) for _ in range(80)]
    for _ in range(60):
        passage = " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60)))
        for threshold in (0.3, 0.6):
            want, got = bm25(items, passage, threshold)
            assert want.keys() == got.keys() and all(abs(want[e] - got[e]) < 1e-9 for e in want)


def test_search_reads_all_passages():
    rng = random.Random(8)
    opening = [f"open{k}" for k in range(6)]
    items = [opening + [f"i{i}w{k}" for k in range(14)] for i in range(30)]
    index = decontam.Index(list(range(30)), [" ".join(x) for x in items], 0.6)
    texts = []
    for i, item in enumerate(items * 4):
        kept = item[:6] + [w if rng.random() < 0.7 else f"edit{rng.random()}" for w in item[6:]]
        lead = 58 if i % 2 else rng.randrange(0, 130)
        texts.append(" ".join([f"x{k}" for k in range(lead)] + kept + [f"y{k}" for k in range(rng.randrange(0, 90))]))
    t = K.texts(pa.array(texts))
    h, first = decontam.term_hashes(t)
    want = {}
    for d in range(len(texts)):
        for s in range(first[d], first[d + 1], decontam.SEGMENT):
            words = set(h[s : min(s + 2 * decontam.SEGMENT, first[d + 1])].tolist())
            for e, score in index.wand([k for k, x in enumerate(index.terms.tolist()) if x in words]):
                want[d, int(index.item[e])] = max(want.get((d, int(index.item[e])), 0.0), score)
    w = {d: h[first[d] : first[d + 1]] for d, _ in want}
    grams = {d: np.concatenate([decontam.triples(x), np.unique(x)]) for d, x in w.items()}
    share = lambda x, d: np.isin(x, grams[d]).mean() if len(x) else 1.0
    sure = {(d, i): s for (d, i), s in want.items() if share(index.question[i], d) >= decontam.QUESTION and share(index.answer[i], d) >= decontam.ANSWER}
    got = {(d, i): s for d, i, s, *_ in index.search(t)}
    assert got.keys() == sure.keys() and all(abs(got[k] - sure[k]) < 1e-9 for k in sure) and len(sure) > 3


def test_blocks_are_skipped():
    rng = random.Random(7)
    items = [" ".join(["common", "word"] + [f"r{i}x{k}" for k in range(10)]) for i in range(400)]
    index = decontam.Index(list(range(400)), items, 0.6)
    words = set(decontam.term_hashes(K.texts(pa.array(["common word " + " ".join(f"r399x{k}" for k in range(10))])))[0].tolist())
    assert [e for e, _ in index.wand([t for t, h in enumerate(index.terms.tolist()) if h in words])] == [399]
    many = [" ".join(rng.choice([f"c{k}" for k in range(12)]) for _ in range(12)) for _ in range(600)]
    index = decontam.Index(list(range(600)), many, 0.6)
    skipped = 0
    for passage in many[:40]:
        want, got = bm25(many, passage, 0.6)
        assert want.keys() == got.keys()
        index.wand([t for t, h in enumerate(index.terms.tolist()) if h in set(decontam.term_hashes(K.texts(pa.array([passage])))[0].tolist())])
        skipped += index.skipped
    assert skipped > 0


def test_results_do_not_depend_on_shards(spark):
    rng = random.Random(16)
    vocab = [f"word{k}" for k in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randrange(5, 150)) + ". " + say(4)) for i in range(120)] + [(200 + k, f"short line {k}") for k in range(9)] + [(300, "word1"), (301, "!!")]
    items += [(400 + i, t) for i, t in items[:10]]  # equal items
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = {}
    for d in range(120):  # whole items, and edited ones across the edges of blocks
        w = dict(items)[rng.randrange(120)].split()
        w = [x if rng.random() < 0.85 else "edit" for x in w] if d % 2 else w
        texts[d] = say(rng.randrange(0, 120)) + " " + " ".join(w) + " " + say(rng.randrange(0, 120))
    texts |= {300: "say. Short line 3! more", 301: "a short line 4 in it", 302: "word1 word1", 303: "x\nWORD1\ny"}
    rows = lambda **more: sorted(map(tuple, decontam.find(frame(spark, texts), bench, **more).collect()))
    one = rows()
    assert {(d, i) for d, i, *_ in one if d >= 300} == {(300, 203), (303, 300)}
    assert {(d, i + 400) for d, i, *_ in one if i < 10} == {(d, i) for d, i, *_ in one if i >= 400} and any(i < 10 for _, i, *_ in one)
    several = rows(shard_bytes=4000)
    assert [r[:2] for r in one] == [r[:2] for r in several] and np.allclose([r[2:] for r in one], [r[2:] for r in several])


def test_leaks_are_found_and_clean_texts_are_left(spark):
    rng = random.Random(6)
    vocab = [f"word{k}" for k in range(800)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = {i: say(rng.randrange(12, 40)) + ".\nAnswer " + say(4) + "." for i in range(50)} | {50: say(150) + ". " + say(6), 51: "two words", 52: None, 53: ""}
    texts, want = {}, set()
    for d in range(150):
        text = say(rng.randrange(0, 400))
        if d % 3 == 0:
            i = rng.randrange(51)
            text = text + " " + (items[i].upper() if d % 2 else items[i]) + " " + say(rng.randrange(0, 300))
            want.add((d, i))
        texts[d] = text
    texts |= {200: None, 201: "", 202: say(30_000), 203: "word1 " * 20_000}
    docs = frame(spark, texts)
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect()}
    assert got == want
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == set(texts) - {d for d, _ in want}
    none = spark.createDataFrame([], bench.schema)
    assert decontam.find(docs, none).count() == 0 and decontam.clean(docs, none).count() == len(texts)
    assert decontam.find(frame(spark, {}), bench).count() == 0


# --- archives


def test_archives_round_trip(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"
    pages = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, fake + "after"), (4, "u", None), (5, "u", ""), (6, "u", "ünï\r\n\r\nWARC/1.0\r\n"), (7, "u", "x" * 300_000), (3, None, fake + "after"), (None, "u", "same"), (None, "u", "lonely"), (8, "u", "WARC/1.0\r\n" * 50)]
    df = spark.createDataFrame([(*p, "extra", 1) for p in pages], "page_id bigint, url string, html string, payload string, size int")
    path = str(tmp_path / "warc")
    warc.write(df, path)
    got = warc.read(spark, path).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        head = first.get(h or "")
        again = head is not None and i != head
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", head if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {r.payload for r in got if r.page_id == 3} == {fake + "after"}
    assert {r.url for r in got if r.page_id == 2} == {"http://b/%0D%0AX: y"}
    warc.write(df.limit(0), path + "0")
    assert warc.read(spark, path + "0").count() == 0


def record(body, kind=b"response", more=b""):
    digest = base64.b32encode(hashlib.sha1(body).digest())
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:" % len(body) + digest + b"\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_archives_are_read_in_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(12)
    want, names = [], []
    for n in range(2):  # payloads that hold magic, whole records and their ends, across the edges of ranges
        bodies = [b"x" * rng.randrange(0, 300) + rng.choice([b"", b"", b"", record(b"inner"), b"WARC/1.0\r\n" * rng.randrange(1, 200), record(b"y" * 900), b"\r\n\r\n", b"Content-Length: 3\r\n\r\n"]) for _ in range(60)]
        data = b"".join(map(record, bodies))
        name = tmp_path / f"a{n}.warc"
        name.write_bytes(data)
        names.append(str(name))
        at = 0
        for b in bodies:
            want.append((f"a{n}.warc", at, b.decode()))
            at += len(record(b))
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.offset, r.payload) for r in got) == sorted(want)
    links = warc.chain(spark, names[0])
    assert links.count() > 20 and links.where("rest").count() > 0


def test_cut_and_foreign_files(spark, tmp_path, small_ranges):
    bodies = [b"z" * k for k in range(100)]
    data = b"".join(map(record, bodies))
    hole = sum(len(record(b)) for b in bodies[:51]) - 10
    for name, content in {"cut": data[:-3], "junk": b"x" + data, "empty": b"", "hole": data[:hole] + b"?" + data[hole:]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(content)
    sizes = lambda name: sorted(r.payload_bytes for r in warc.read(spark, str(tmp_path / name)).collect())
    assert sizes("cut") == list(range(99)) and sizes("junk") == sizes("empty") == []
    assert sizes("hole") == list(range(50))


def test_a_large_payload_of_magic_takes_linear_time(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(b"WARC/1.0\r\n" * 500_000) + record(b"end"))
    began = time.monotonic()
    got = warc.read(spark, str(tmp_path)).select("payload_bytes").collect()
    assert sorted(r[0] for r in got) == [3, 5_000_000] and time.monotonic() - began < 60


def test_chains_leave_by_pointer_jumping():
    at, to = np.array([0, 10, 25, 40, 60]), np.array([25, 40, 60, 77, 95])
    assert warc.exits(at, to).tolist() == [95, 77, 95, 77, 95]
    assert warc.exits(at, np.array([25, 41, 60, -5, 95])).tolist() == [95, 41, 95, -5, 95]
