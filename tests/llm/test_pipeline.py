"""The pipeline by stages, and the llm queries against their SQL."""

import random

import pytest

from tests.test_queries import SF, compare, duck  # noqa: F401 - a fixture

from factloom.llm.line_dedup import MIN_DOCS
from factloom.llm.packing import CAPACITY, best_fit

from .helpers import SCHEMA, awkward, empty, prose, shingles
from .test_dedup import brute_lines, groups_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_llm_queries_equal_their_sql(spark, duck):  # noqa: F811
    from factloom.llm.queries import QUERIES, SQL

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    for name, sql in SQL.items():
        try:
            compare(spark, duck, QUERIES[name], sql)
        except AssertionError as e:
            raise AssertionError(name) from e


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables: clean, toxic, copied and contaminated documents; and what they are."""
    rng = random.Random(12)
    rows, labels, what = [], [], {}
    items = [(k, prose(rng, 30, 10**6)) for k in range(5)]
    boiler = "all rights reserved by the makers of this page"

    def add(text, kind, label=None):
        d = len(rows)
        rows.append((d, text, "en", f"src{d % 5}", len(text), "k", "h", 1, "l"))
        what.setdefault(kind, []).append(d)
        if label:
            labels.append((d, *label))
        return d

    common = lambda n: " ".join(f"w{int(rng.paretovariate(0.6)) % 3000}x" for _ in range(n))
    for k in range(900):
        add(common(60) + ("\n" + boiler if k % 9 == 0 else ""), "clean", (1, 0) if k % 2 else None)
    for k in range(150):
        w = common(60).split()
        for _ in range(8):
            w[rng.randrange(60)] = rng.choice(("vileword", "nastyword"))
        add(" ".join(w), "toxic", (1, 1) if k % 4 == 0 else None)
    for k in range(40):
        base = common(80)
        what.setdefault("groups", []).append([add(base, "copy"), add(base, "copy"), add(" ".join(base.split()[:-2]), "copy")])
    for k in range(20):
        add(f"{common(50)} {items[k % 5][1]} {common(40)}", "leak")
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, what, boiler


def test_stages_keep_clean_documents_and_drop_the_others(spark, planted):
    folder, what, boiler = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns, name
            path = f"{folder}/stage{k}.parquet"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            seen[k] = {r.doc_id: r.text for r in docs.collect()}
    kept = set(seen[0])
    assert sum(d in kept for d in what["clean"]) >= 0.97 * len(what["clean"])
    assert sum(d in kept for d in what["toxic"]) <= 0.05 * len(what["toxic"])
    # the lines that repeat stay in one document
    with_boiler = [d for d, t in seen[1].items() if boiler in t]
    assert with_boiler == [min(d for d, t in seen[0].items() if boiler in t)] and set(seen[1]) == kept
    for group in what["groups"]:
        present = [d for d in group if d in seen[1]]
        assert [d for d in group if d in seen[2]] == present[:1]
    assert set(what["clean"]) & set(seen[1]) == set(what["clean"]) & set(seen[2]) == set(what["clean"]) & set(seen[3])
    assert not set(what["leak"]) & set(seen[3])
    tokens = {}
    for r in out.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {d: -(-len(t.encode()) // 4) for d, t in seen[3].items()}


def test_run_equals_its_stages_one_by_one(spark, planted):
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_equal_brute_force(spark, planted):
    """Each stage after the classifier, on its own input, against plain Python."""
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id % 3 <> 1 or doc_id > 900")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    stage = dict(corpus_pipeline.STAGES)
    before = texts(docs)
    deduped = stage["line dedup"](spark, docs, folder)
    assert texts(deduped) == brute_lines(list(before.items()), MIN_DOCS)
    single = stage["MinHash near-dedup"](spark, docs, folder)
    groups, _ = groups_of(list(before.items()))
    assert set(texts(single)) == {d for d in before if groups.get(d, d) == d}
    clean = stage["benchmark decontamination"](spark, docs, folder)
    held = lambda t: any(len(shingles(x, 5) & shingles(t, 5)) >= 0.6 * len(shingles(x, 5)) for x in items.values())
    assert texts(clean) == {d: t for d, t in before.items() if not held(t)}
    packed = stage["best-fit packing"](spark, docs, folder).collect()
    load = {}
    for r in packed:
        load.setdefault((r.group_id, r.bin_id), []).append(r.n_tokens)
    by_group = {}
    for (g, _), n in load.items():
        assert sum(n) <= CAPACITY
        by_group.setdefault(g, []).append(n)
    for bins in by_group.values():
        sizes = [x for n in bins for x in n]
        assert len(bins) <= len(best_fit(sorted(sizes, reverse=True), CAPACITY))


@pytest.mark.parametrize("make", [awkward, empty])
def test_every_stage_takes_awkward_tables(spark, planted, make):
    folder, _, _ = planted
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes and rows <= docs.count()
        elif make is empty:
            assert rows == 0
