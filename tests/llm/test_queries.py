"""The registered queries on the small driver tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


@pytest.mark.parametrize("name", ["op4_suffix_index_dedup", "op7_minhash", "op8_warc"])
def test_queries_match_sql(spark, entry, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(entry.oracle_sql()[name])
    assert sorted(map(tuple, entry.queries()[name](spark, SF).select(*want.columns).collect())) == sorted(want.fetchall())


def test_every_operator_has_a_query(entry):
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_keeps_what_its_stages_keep(spark, entry):
    import corpus_pipeline
    from tidelog.llm import decontam, minhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = {}
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        df = df.cache()
        after[name] = (df, {r.doc_id for r in df.select("doc_id").collect()})
        if name != "tokens":
            assert df.schema.names == docs.schema.names
    kept = minhash.near_duplicates(after["quality"][0], words=5).where("kept")
    assert after["near-duplicates"][1] == {r.doc_id for r in kept.collect()}
    leaks = {r.doc_id for r in decontam.find(after["near-duplicates"][0], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert after["decontamination"][1] == after["near-duplicates"][1] - leaks
    assert after["personal data"][1] == after["decontamination"][1] == after["tokens"][1]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in after["quality"][1] for i, q in quality.items() if q == 1)
    assert sum(i in after["quality"][1] for i, q in quality.items() if q == 0) <= 0.1 * max(1, sum(q == 0 for q in quality.values()))
    got = sorted(map(tuple, entry.queries()["pipeline"](spark, SF).select("doc_id", "n_tokens", "ids_sha256").collect()))
    assert got == sorted(map(tuple, after["tokens"][0].select("doc_id", "n_tokens", "ids_sha256").collect()))


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def crc_fold(i, m):
    import zlib

    return zlib.crc32(str(i).encode()) % m


COLUMNS = {
    "op1_toxicity_crf": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_pii_bilstm_crf": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4_suffix_index_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_quality_rules_ensemble": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_ngram_llr": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.fixture(scope="module")
def results(spark, entry):
    return {name: entry.queries()[name](spark, SF) for name in COLUMNS}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_return_their_contract(results, tables, name):
    df = results[name]
    kinds = dict(df.dtypes)
    assert {c: k for c, k in (x.split(" ") for x in COLUMNS[name].split(", "))}.items() <= kinds.items()
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in tables["documents"].select("doc_id").collect())
    for r in rows:
        if "held_out" in kinds:
            m, k = {"op1": (3, 1), "op5": (4, 2), "op10": (5, 0)}[name.split("_")[0]]
            assert r.held_out == (crc_fold(r.doc_id, m) == k) and 0 <= r.score <= 1
        if "predicted" in kinds:
            assert r.predicted == int(r.score >= 0.7)


def test_held_out_documents_are_told_apart(spark, entry):
    large = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "lang").collect()}
    results = {name: entry.queries()[name](spark, large) for name in ("op1_toxicity_crf", "op5_quality_rules_ensemble", "op10_language_id")}
    for name, of in (("op1_toxicity_crf", "toxic"), ("op5_quality_rules_ensemble", "quality")):
        rows = [r for r in results[name].collect() if r.held_out and r.doc_id in labels]
        right = sum(r.predicted == labels[r.doc_id][of] for r in rows)
        assert right >= 0.9 * len(rows) > 0
    rows = [r for r in results["op10_language_id"].collect() if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.95 * len(rows) > 0


def test_leak_query_matches_all_passages(spark, entry, tables):
    """Against BM25 by definition over every passage of every document."""
    import numpy as np
    import pyarrow as pa

    from tidelog.llm import decontam, kernels as K

    items = sorted(map(tuple, tables["benchmark"].where("text <> ''").select("item_id", "text").collect()))
    index = decontam.Index([i for i, _ in items], [t for _, t in items], decontam.THRESHOLD)
    weight = {}
    for t, h in enumerate(index.terms.tolist()):
        weight[h] = list(zip(*index.posting(t)[:2]))
    want = set()
    for doc, text in tables["documents"].where("text IS NOT NULL").select("doc_id", "text").collect():
        h = decontam.term_hashes(K.texts(pa.array([text])))[0]
        best = {}
        for s in range(0, len(h), decontam.SEGMENT):
            scores = {}
            for w in set(h[s : s + 2 * decontam.SEGMENT].tolist()):
                for e, x in weight.get(w, ()):
                    scores[e] = scores.get(e, 0) + x
            for e, x in scores.items():
                if x >= decontam.THRESHOLD - 1e-9:
                    best[int(index.item[e])] = True
        grams = np.concatenate([decontam.triples(h), np.unique(h)])
        share = lambda x: np.isin(x, grams).mean() if len(x) else 1.0  # noqa: B023, E731
        want |= {(doc, items[i][0]) for i in best if share(index.question[i]) >= decontam.QUESTION and share(index.answer[i]) >= decontam.ANSWER}
    assert {(r.doc_id, r.item_id) for r in entry.queries()["op2_decontamination"](spark, SF).collect()} == want and want


def test_stages_take_odd_rows(spark):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, text__ string, stat__words double, id string, kind int, key bigint, route bigint"
    long = " ".join(f"word{k % 700}" for k in range(30_000))
    texts = [None, "", " \n", "one", "same text of some words here", "same text of some words here", long]
    rows = [(i, t, "en", "s", len(t or ""), "x", 0.5, "y", 1, 2, 3) for i, t in enumerate(texts)] + [(4, texts[4], None, None, None, None, None, None, None, None, None), (None, "no id at all", "en", "s", 12, "x", 0.5, "y", 1, 2, 3)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "tokens":
            assert out.schema.names == docs.schema.names
        if name == "near-duplicates":
            assert sorted((r.doc_id for r in got), key=str) == sorted([0, 1, 2, 3, 4, 4, 6, None], key=str)
        if name in ("decontamination", "personal data", "tokens"):
            assert len(got) == len(rows)
