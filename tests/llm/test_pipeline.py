"""The stages: columns, decisions that take effect, clean documents that stay; each against a plain version."""

import re

import corpus_pipeline
import numpy as np
import pytest
from stratalog.llm import language, pieces, pii
from stratalog.llm.store import written
from test_operators import LOWER, WORD, brute_classes, brute_hits, brute_pii, odd_rows

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_in_order(spark, sf, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "benchmark_passages", "personal_data", "piece_ids"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), name)
        if name != names[-1]:
            assert out.schema == docs.schema
        sizes.append(out.count())
        docs = out
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 0.8 * sizes[0]
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_language_stage(spark, docs):
    """Stays: a letter, and a lead of a tenth by the model's own prediction, text by text."""
    more = spark.createDataFrame([(10_001, "12 34", "en", "a", 5), (10_002, None, "en", "a", 0), (10_003, "D", "en", "a", 1)], docs.schema)
    rows = docs.unionByName(more)
    model = language.train(rows.where(~language.held_out(4, 2)).select("text", "lang"))
    want = set()
    for r in rows.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        lead = model.predict(data, np.array([0, len(data)]))[2][0]
        if any(c.isalpha() for c in r.text or "") and lead >= 0.1:
            want.add(r.doc_id)
    got = STAGES["language_id"](spark, rows, None)
    assert {r.doc_id for r in got.select("doc_id").collect()} == want and 10_001 not in want and len(want) >= 0.98 * docs.count()


def test_language_stage_without_labels_keeps_all(spark, docs):
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    assert STAGES["language_id"](spark, bare, None).count() == docs.count()


def test_near_duplicate_stage(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(120).collect()]
    rows += [(20_000 + i, " ".join(t.split()[: -1 - i % 3])) for i, (_, t) in enumerate(rows[:30]) if len(t.split()) > 60]
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], docs.schema)
    _, classes, _ = brute_classes(rows)
    want = {rows[c][0] for c in classes}
    assert {r.doc_id for r in STAGES["near_duplicates"](spark, table, None).collect()} == want and len(want) < len(rows)


def test_benchmark_stage(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = set()
    for _, t in items:
        x = WORD.findall(t.translate(LOWER))
        k = min(10, len(x))
        windows |= {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if x else set()
    sizes = {len(w) for w in windows}
    want = {}
    for r in docs.collect():
        at = [(m.start(), m.end()) for m in re.finditer(WORD.pattern, r.text.translate(LOWER))]
        w = [r.text.translate(LOWER)[a:b] for a, b in at]
        hit = set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
        if hit and len(hit) > 0.8 * len(w):
            continue
        out, last = "", 0
        for i in sorted(hit):
            if i - 1 not in hit:
                out += r.text[last : at[i][0]]
            last = at[i][1]
        want[r.doc_id] = out + r.text[last:]
    got = {r.doc_id: (r.text, r.n_chars) for r in STAGES["benchmark_passages"](spark, docs, sf).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()} and any(brute_hits(r.text, items)[1] for r in docs.collect())


def test_personal_data_stage(spark, docs):
    added = {r.doc_id for r in pii.find(docs).where("exists(pii, s -> s.rank >= 4)").collect()}
    got = {r.doc_id: r.text for r in STAGES["personal_data"](spark, docs, None).collect()}
    changed = 0
    for r in docs.collect():
        if r.doc_id in added:
            continue
        out, at = "", 0
        for lo, _, kind, hi in brute_pii(r.text):
            if lo >= at:
                out += r.text[at:lo] + f"[{kind.upper()}]"
            at = max(at, hi)
        out += r.text[at:]
        changed += out != r.text
        assert got[r.doc_id] == out
    assert changed > 5


def test_piece_stage(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    few = docs.limit(40)
    texts = {r.doc_id: r.text for r in few.collect()}
    for r in STAGES["piece_ids"](spark, few, None).collect():
        ids = [*lib.encode(texts[r.doc_id]), lib.eos_id()]
        assert (r.piece_ids, r.n_tokens, r.decoded) == (ids, len(ids), lib.decode(ids))


def test_odd_and_empty_tables(spark, sf, docs, tmp_path):
    for name, rows in (("odd", odd_rows()), ("empty", [])):
        table = spark.createDataFrame(rows, docs.schema)
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()]
        kept = {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
        assert set(got) <= kept and (not rows or {1, 13} <= set(got)) and got.count(1) <= 1 and 2 not in got
