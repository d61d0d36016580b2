import itertools
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from laborlens.llm import toxicity
from laborlens.llm.common import crc_mod, table
from laborlens.llm.secrets import scan_secrets


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    want = docs.columns
    last = docs.count()
    kept = docs.cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == want and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
        assert kept.count() <= last and (name != "near_dedup" or kept.count() < last)
        last = kept.count()
        if name == "near_dedup":
            assert kept.select("text").distinct().count() == last
    assert scan_secrets(kept).selectExpr("sum(size(spans))").first()[0] == 0
    pieces = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_an_empty_table_passes(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_the_whole_chain(spark, sf):
    """Null ids, repeated ids, null, empty and repeated texts, and columns whose names the stages use."""
    long = " ".join(f"w{k % 977}" for k in range(20_000))
    secret = 'set password = "hunter2hunter2" now'
    rows = [(None, "plain words with no id at all"), (None, "plain words with no id at all"), (None, None), (1, None), (2, ""), (3, secret), (3, "another text under the same id"), (4, long), (5, long), (6, " ")]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, component long, id long, h long, label string, toxic int"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0.5, 1, 2, 3, "x", 1) for i, t in rows], names)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns and {(r.score, r.component, r.id, r.h, r.label, r.toxic) for r in kept.collect()} == {(0.5, 1, 2, 3, "x", 1)}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((i for i, _ in got if i is not None)) == [1, 2, 3, 3, 4, 6] and sum(i is None for i, _ in got) == 3
    assert secret not in {t for _, t in got} and "another text under the same id" in {t for _, t in got}
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    # a row without text is its end alone
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in pieces if r.start == 0 and r.doc_tokens == 1) == [(0, 1), (1, 1), (2, 1)]
    assert sum(r.length for r in pieces if r.doc_id == 4) == max(r.doc_tokens for r in pieces if r.doc_id == 4)


def test_stages_take_small_arrow_batches(spark, sf):
    """The size of a batch is held outside the heap for each core: with 10,000 rows executors passed their limit."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def most() -> int:
        rows = spark.range(5000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
        return rows.agg({"n": "max"}).first()[0]

    before, docs = spark.conf.get(name), table(spark, sf, "documents").limit(20)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "10000")
            stage(spark, docs, sf)
            assert most() == corpus_pipeline.BATCH_ROWS
        spark.conf.set(name, "300")
        corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert most() == 300
    finally:
        spark.conf.set(name, before)


def _scores_by_hand(model, texts):
    """All cosines with all examples, instead of an index."""
    dense = np.zeros((len(model.ids), len(model.weight)))
    dense[model.example, np.repeat(np.arange(len(model.weight)), model.cuts[:, -1] - model.cuts[:, 0])] = model.posted
    terms, out = toxicity.TermIds(model.vocabulary), {}
    for i, text in texts.items():
        at, n = terms.counts(text or "")
        if not len(at):
            out[i] = model.without
            continue
        cosines = dense[:, at] @ model.vector(at, n)
        near = [k for k in np.lexsort((model.ids, -np.round(cosines, 12)))[: toxicity.NEIGHBOURS] if cosines[k] > 0]
        w = 1 / (1.05 - np.minimum(cosines[near], 1.0))
        vote = (w * model.labels[near]).sum() / w.sum() if near else model.base
        out[i] = float(np.interp(vote, *model.knots))
    return out


def _first_of_groups(texts):
    """Ids that stay if all pairs of texts are compared."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i for i in sets if find(i) == i}


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = next(texts[i] for i in sorted(texts) if labels.get(i) == 1 and not held(i) and any(w in texts[i] for w in ("idiot", "scum", "moron")))
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    clean = next(t for i, t in sorted(texts.items()) if labels.get(i) == 0 and len(t.split()) > 200)
    planted = {10**6: toxic, 10**6 + 1: f"before it {items[0]} and after", 10**6 + 2: " ".join(clean.split()[:-3]), 10**6 + 3: None, 10**6 + 4: "", 10**6 + 5: "word " * 30_000}
    schema = docs.schema
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in planted.items()], schema))
    texts |= planted
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    kept = stages["toxicity"](spark, docs, sf).cache()
    model = toxicity.fit(docs, table(spark, sf, "labels"), usable=crc_mod("doc_id", 3) != 1)
    want = {i for i, score in _scores_by_hand(model, texts).items() if score < toxicity.REJECT}
    assert ids(kept) == want and 10**6 not in want and len(want) > 0.8 * len(texts)

    kept = stages["near_dedup"](spark, kept, sf).cache()
    want = _first_of_groups({i: texts[i] for i in want})
    assert ids(kept) == want and 10**6 + 2 not in want

    kept = stages["decontamination"](spark, kept, sf).cache()
    plain = lambda t: " ".join((t or "").lower().split())
    grams = {tuple(w[k : k + 5]) for w in (plain(t).split() for t in items) for k in range(len(w) - 4)}
    whole = {i for i in want if any(plain(t) in plain(texts[i]) for t in items if len(t.split()) >= 8)}
    apart = {i for i in want if not grams & {tuple(w[k : k + 5]) for w in [plain(texts[i]).split()] for k in range(len(w) - 4)}}
    assert whole and 10**6 + 1 in whole and not ids(kept) & whole and apart - {10**6 + 5} <= ids(kept) and {10**6 + 3, 10**6 + 4, 10**6 + 5} <= ids(kept)

    want = ids(kept)
    kept = stages["secret_scans"](spark, kept, sf).cache()
    assert ids(kept) == want and scan_secrets(kept).selectExpr("sum(size(spans))").first()[0] == 0
    pieces = stages["packing"](spark, kept, sf).collect()
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends.get(r.doc_id, 0)
        ends[r.doc_id] = r.start + r.length
    assert set(ends) == want and all(r.doc_tokens == ends[r.doc_id] for r in pieces)
