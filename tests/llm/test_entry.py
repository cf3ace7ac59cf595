"""The pipeline and the registry."""

from __future__ import annotations

import corpus_pipeline

import __spark_entry__ as entry


def test_registry_has_each_operator_once():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


def test_pipeline_runs_and_keeps_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = corpus_pipeline.materialise(out, "stage")
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.4 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def put(spark, docs, bench, path):
    """A folder of tables with these documents."""
    docs.write.parquet(f"file://{path}/documents.parquet")
    bench.write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_pipeline_on_odd_documents(spark, odd_docs, tmp_path):
    """Nulls, repeated rows, copies, a benchmark passage, very long texts: what stays is packed, each row once."""
    text = lambda k: "\n".join(" ".join(f"w{(k * 7919 + 31 * i * j) % 9973}" for i in range(1, 12)) for j in range(1, 12))
    item = "which of the nine old rivers in the far north freezes first when the winter comes early"
    more = [(100, text(1)), (101, text(1)), (102, text(1) + " tail"), (103, text(2) + "\n" + item), (104, text(3)), (104, text(3)), (None, text(4)), (None, text(4)), (105, None)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    sf = put(spark, docs, spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"), tmp_path / "a")
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows if r["piece"] == 0)
    # what quality rules and the benchmark rule out is gone; copies are emptied line by line, so they are only an end id
    assert {i for _, i in ids if i} == {1, 2, 100, 101, 102, 104} and all(ids.count((False, i)) == 1 for i in (100, 101, 104))
    size = {r["doc_id"]: r["length"] for r in rows}
    assert size[2] == size[101] == 1 and size[100] > 100 and 1 < size[102] < size[100]


def test_pipeline_on_empty_tables(spark, odd_docs, tmp_path):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert corpus_pipeline.run(spark, put(spark, odd_docs.limit(0), bench, tmp_path / "a")).count() == 0
    assert corpus_pipeline.run(spark, put(spark, odd_docs, bench, tmp_path / "b")).count() > 0


def test_stages_are_what_brute_force_says(spark, tmp_path):
    """The pipeline's stages on random texts, each against a plain program on its own input."""
    import random

    from test_docs import brute_components, brute_hits, brute_measure

    rng = random.Random(15)
    vocab = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in "nrst"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [say(n) for n in (6, 12, 40)]
    base = [say(rng.randint(60, 160)) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(4):
            w = b.split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [f"{say(70)} {it} {say(30)}" for it in items for _ in range(2)] + [say(20), "spam spam " * 60, None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    sf = put(spark, docs, bench, tmp_path / "a")
    at = {i: t for i, t in enumerate(texts)}
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs
        docs = corpus_pipeline.materialise(stages[name](spark, docs, sf), name)
        return {r["doc_id"]: r["text"] for r in docs.collect()}

    def good(t):
        n, _, _, _, repeated = brute_measure(t)
        return n >= 50 and 100 * repeated <= 50 * n

    got = step("quality_rules")
    assert got == {i: t for i, t in at.items() if good(t)}
    at, got = got, step("line_dedup")  # each text is one line: the second of equal ones goes
    first = {}
    assert got == {i: t if first.setdefault(t, i) == i else "" for i, t in sorted(at.items())}
    at, got = got, step("ngram_jaccard_join")
    comp = brute_components(sorted(at.items()), 5, 80, 100)
    assert got == {i: t for i, t in at.items() if comp[i][1] == i}
    at, got = got, step("benchmark_decontamination")
    assert got == {i: t for i, t in at.items() if not any(brute_hits(it, t) for it in items)}
    packed = stages["best_fit_packing"](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == got.keys()
