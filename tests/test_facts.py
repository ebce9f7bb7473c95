"""The fact table: serving, reconciliation, consolidation and the store."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions.model import StubModel
from factloom.functions.text import preview, stable_id, text_lines, truncate_bytes
from factloom.functions.vectors import cosine, from_blob, l2_normalize, to_blob
from factloom.operators import components, reconcile, serve, settle, similarity
from factloom.operators.components import connected_components
from factloom.operators.similarity import similar_pairs
from factloom.plans import jobs
from factloom.schema import conform
from factloom.settings import Settings
from factloom.sources.store import FactStore, StoreError

S = Settings()


def facts(spark, rows):
    """Rows from dicts; what isn't given is plausible."""
    full = []
    for k, r in enumerate(rows):
        base = dict(id=f"id{k}", at=1_700_000_000 + k, content=f"content {k}", embedding=[1.0, 0.0], lifecycle="accepted", scope="project", source_project="alpha", source_session=f"s{k}", entity=None, category="fact", confidence=0.9, supersedes=None, superseded_by=None) | r
        base["embedding"] = [float(x) for x in base["embedding"]]
        full.append(tuple(base[c] for c in ("id", "content", "embedding", "scope", "category", "entity", "source_project", "source_session", "lifecycle", "confidence", "supersedes", "superseded_by", "at")))
    df = spark.createDataFrame(full, "id string, content string, embedding array<float>, scope string, category string, entity string, source_project string, source_session string, lifecycle string, confidence float, supersedes string, superseded_by string, at long")
    at = F.timestamp_seconds("at")
    return conform(df.withColumns({"embedding_dim": F.size("embedding"), "source_timestamp": at, "created_at": at, "updated_at": at}))


def incoming(spark, rows):
    df = facts(spark, rows)
    extra = spark.createDataFrame([(r.get("id", f"id{k}"), float(r.get("confidence", 0.9)), float(r.get("scope_confidence", 0.9)), k) for k, r in enumerate(rows)], "id string, confidence double, scope_confidence double, seq long")
    return df.drop("confidence").join(extra, "id")


def test_cosine_and_codec(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(cosine("a", "b")).collect()] == [1, 0, 0, 0, 0, 0]
    assert [r[0] for r in df.select(l2_normalize("a")).collect()][1:5] == [[1.0, 0.0], [1.0], [], [0.0, 0.0]]
    blob = df.select("a", to_blob(spark, F.col("a")).alias("x"))
    assert blob.first().x == np.array([1, 2], "<f4").tobytes()
    assert [r[0] for r in blob.select(from_blob(spark, F.col("x"))).collect()] == [r[0] for r in rows]
    with pytest.raises(Exception, match="5 bytes"):
        spark.createDataFrame([(b"12345",)], "x binary").select(from_blob(spark, F.col("x"))).collect()


def test_text_columns(spark):
    df = spark.createDataFrame([("é—xyz",), ("a\r\nb\n",), (None,)], "t string")
    assert [r[0] for r in df.select(truncate_bytes(spark, "t", 4)).collect()] == ["é", "a\r\nb", None]
    assert df.select(preview(spark, "t", 4)).first()[0] == "é..."
    assert df.select(text_lines("t")).collect()[1][0] == ["a", "b"]
    assert df.select(stable_id("t")).first()[0] == df.select(stable_id("t")).first()[0]


def test_topk_equals_brute_force(spark):
    df = facts(spark, [{"embedding": [1.0, 0, 0, 0]}, {"embedding": [0.0, 1, 0, 0]}, {"embedding": [0.9, 0.1, 0, 0]}, {"embedding": [1.0, 0, 0, 0], "lifecycle": "candidate"}])
    assert [r.id for r in serve.vector_search(df, [1.0, 0, 0, 0], 3).collect()] == ["id0", "id2", "id1"]


def test_recall_drops_superseded_after_the_limit(spark):
    df = facts(spark, [{"superseded_by": "id1"}, {"embedding": [0.9, 0.1]}, {"embedding": [0.5, 0.5], "entity": "tabs", "scope": "personal"}])
    assert [r.id for r in serve.recall(df, [1.0, 0.0], 2).collect()] == ["id1"]
    assert [r.id for r in serve.recall(df, [1.0, 0.0], 2, strict_k=True).collect()] == ["id1", "id2"]
    assert [r.id for r in serve.recall(df, [1.0, 0.0], 0).collect()] == []
    assert serve.recall_text(serve.recall(df, [1.0, 0.0], 3)).first().text == "- (project/fact) content 1\n- (personal/fact [tabs]) content 2"
    assert serve.recall_text(serve.recall(df.limit(0), [1.0, 0.0], 3)).first().text == "Nothing relevant is known."
    with pytest.raises(ValueError):
        serve.recall(df, [1.0, 0.0], 3, "team")


def test_lists_and_lookups(spark):
    df = facts(spark, [{"entity": "rust"}, {"entity": "rust", "source_project": "beta"}, {"content": "100% sure_thing"}, {"id": "0f8fad5b-d9cb-469f-a165-70867728950e"}])
    assert [r.id for r in serve.list_facts(df, entity="rust", source_project="beta").collect()] == ["id1"]
    assert [r.id for r in serve.keyword_search(df, "100% SURE_").collect()] == ["id2"] and serve.keyword_search(df, "100%x").count() == 0
    assert serve.find_by_prefix(df, "0f8").first().id == serve.find_by_prefix(df, "0F8FAD5B-d9cb-469f-a165-70867728950e").first().id
    assert {r.name: r.value for r in serve.detail(df, "id1").collect()}["source_project"] == "beta"
    for prefix in ("zz", "id"):
        with pytest.raises(LookupError):
            serve.find_by_prefix(df, prefix)
    assert '"content" : "100% sure_thing"' in serve.export_json(df).where("id = 'id2'").first().json
    assert "embedding" not in serve.export_json(df).first().json


def test_gate_order_and_boundaries(spark):
    rows = [
        {"scope": "team", "category": "rumour"}, {"category": "rumour"}, {"confidence": 0.59}, {"confidence": 0.6}, {"confidence": 0.85}, {"scope": "PERSONAL", "scope_confidence": 0.74}, {"scope": "personal", "scope_confidence": 0.75, "category": "FACT"},
    ]
    got = {r.id: r for r in reconcile.gate(incoming(spark, rows), S).collect()}
    assert [got[f"id{k}"].outcome for k in range(7)] == ["invalid_scope", "invalid_category", "low_confidence", None, None, None, None]
    assert [got[f"id{k}"].lifecycle for k in (3, 4)] == ["candidate", "accepted"] and [got[f"id{k}"].scope for k in (5, 6)] == ["project", "personal"]


def outcomes(df):
    return {r.id: (r.outcome, r.ref_id) for r in df.collect()}


def test_duplicates_are_scoped(spark):
    store = facts(spark, [{"id": "a"}, {"id": "p", "embedding": [0.0, 1.0], "scope": "personal", "source_project": "zeta"}, {"id": "c", "source_project": "gamma", "lifecycle": "candidate"}, {"id": "dead", "source_project": "delta", "superseded_by": "x"}])
    new = incoming(spark, [{"id": "n1", "source_project": "beta"}, {"id": "n2"}, {"id": "n3", "embedding": [0.0, 1.0], "source_project": "beta"}, {"id": "n4", "source_project": "gamma"}, {"id": "n5", "source_project": "delta"}, {"id": "n6", "scope": "personal"}])
    want = {"n1": ("accepted", None), "n2": ("duplicate", "a"), "n3": ("duplicate", "p"), "n4": ("duplicate", "c"), "n5": ("accepted", None), "n6": ("accepted", None)}
    assert outcomes(reconcile.reconcile_snapshot(new, store, S)) == want
    without = new.where("id <> 'n6'")
    assert outcomes(reconcile.reconcile_ordered(without, store, S)) == {k: v for k, v in want.items() if k != "n6"}


def unit_rows(v):
    v = v.astype(float)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros(v.shape), where=n > 0)


def test_best_match_of_a_hot_project(spark, monkeypatch):
    """Many blocks of one project, small projects, repeated vectors and other lengths, against every pair."""
    monkeypatch.setattr(similarity, "ROWS", 16, raising=False)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(240):
        v = np.float32(rng.normal(size=6 if k % 10 else 4))
        rows.append({"id": f"r{k:03}", "embedding": rows[k - 7]["embedding"] if k % 9 == 8 else v.tolist(), "scope": "personal" if k % 6 == 1 else "project", "source_project": "hot" if k % 4 else f"p{k % 3}"})
    new, old = rows[::2] + [{"id": "zero", "embedding": [0.0] * 6, "source_project": "hot"}], rows[1::2]
    got = {r.id: (r.match_id, round(r.score, 9)) for r in reconcile.best_match(incoming(spark, new), facts(spark, old)).collect()}
    want = {}
    for a in new:
        scores = {}
        for b in old:
            if b["scope"] == "personal" or a.get("scope", "project") == "project" and a["source_project"] == b["source_project"]:
                x, y = (unit_rows(np.array([r["embedding"]], np.float32))[0] for r in (a, b))
                scores[b["id"]] = round(float(x @ y), 12) if len(x) == len(y) else 0.0
        best = min(scores, key=lambda i: (-scores[i], i))
        want[a["id"]] = best, round(scores[best], 9)
    assert got == want


def test_scores_equal_to_twelve_places_tie(spark):
    store = facts(spark, [{"id": i, "embedding": v, "scope": s} for s in ("personal", "project") for i, v in ((f"{s}-a", [1.0, 1e-7]), (f"{s}-z", [1.0, 0.0]))])
    new = incoming(spark, [{"id": "n1", "source_project": "beta"}, {"id": "n2", "scope": "personal"}])
    assert {(r.id, r.match_id, r.score) for r in reconcile.best_match(new, store).collect()} == {("n1", "personal-a", 1.0), ("n2", "personal-a", 1.0)}


def test_a_hot_key_is_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS", 16, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"), F.lit("hot").alias("k"))
        per_task = similarity.nearest(rows, rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) == 4 and max(r["count"] for r in per_task) < 0.5 * sum(r["count"] for r in per_task)


def test_supersession_band(spark):
    store = facts(spark, [{"id": "old", "entity": "editor"}])
    new = incoming(spark, [{"id": "n", "entity": "editor", "embedding": [0.78, 0.6258]}])
    assert outcomes(reconcile.reconcile_snapshot(new, store, S)) == {"n": ("accepted", "old")}
    out = reconcile.reconcile_ordered(new, store, S)
    assert out.first().superseded == ["old"]
    rows = reconcile.to_rows(new, out, S, F.to_timestamp(F.lit("2025-01-01"))).first()
    assert rows.supersedes == "old" and rows.lifecycle == "accepted"


def test_supersession_of_a_hot_entity(spark, monkeypatch):
    """Many blocks of one entity and project: the pairs, the latest and the number of each row, and the tasks that do the work."""
    monkeypatch.setattr(similarity, "ROWS", 16, raising=False)
    rng = np.random.default_rng(6)
    v = np.float32(rng.normal(size=(240, 6)))
    rows = [{"id": f"r{k:03}", "embedding": x.tolist(), "at": 1_700_000_000 + k % 7, "entity": "e" if k % 8 else None, "source_project": "hot" if k % 5 else "cold"} for k, x in enumerate(v)]
    new, old = incoming(spark, rows[::2]), facts(spark, rows[1::2])
    s = Settings(duplicate_above=2.0, supersede_from=0.2, supersede_below=0.6)
    c, want, ends = unit_rows(v) @ unit_rows(v).T, {}, {}
    for i in range(0, 240, 2):
        hits = [j for j in range(1, 240, 2) if 0.2 <= c[i, j] < 0.6 and rows[i]["entity"] == rows[j]["entity"] == "e" and rows[i]["source_project"] == rows[j]["source_project"]]
        want |= {(f"r{i:03}", f"r{j:03}"): 1_700_000_000 + j % 7 for j in hits}
        ends[f"r{i:03}"] = (f"r{min(hits, key=lambda j: (-(j % 7), j)):03}" if hits else None, len(hits))
    assert {r.id: (r.ref_id, r.n_superseded) for r in reconcile.reconcile_snapshot(new, old, s).collect()} == ends
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, x in off.items():
        spark.conf.set(k, x)
    try:
        found = reconcile.supersession_pairs(new, old, s).select("id", "old_id", F.unix_seconds("created_at").alias("at"), F.spark_partition_id().alias("task")).collect()
    finally:
        for k in off:
            spark.conf.unset(k)
    assert {(r.id, r.old_id): r.at for r in found} == want and len(found) == len(want)
    assert max(sum(r.task == t for r in found) for t in range(4)) < 0.6 * len(found)


def test_ordered_sees_its_predecessors(spark):
    new = incoming(spark, [{"id": "n1", "confidence": 0.7}, {"id": "n2", "confidence": 0.7}])
    store = facts(spark, [{"id": "far", "embedding": [0.0, 1.0]}])
    assert outcomes(reconcile.reconcile_snapshot(new, store, S)) == {"n1": ("candidate", None), "n2": ("candidate", None)}
    assert outcomes(reconcile.reconcile_ordered(new, store, S)) == {"n1": ("candidate", None), "n2": ("duplicate", "n1")}


def test_reversal_supersedes_the_live_row(spark):
    store = facts(spark, [{"id": "dead", "entity": "e", "superseded_by": "live"}, {"id": "live", "entity": "e", "embedding": [0.6, 0.8]}])
    new = incoming(spark, [{"id": "n", "entity": "e", "embedding": [0.95, 0.3122]}])
    assert outcomes(reconcile.reconcile_ordered(new, store, S)) == outcomes(reconcile.reconcile_snapshot(new, store, S)) == {"n": ("accepted", "live")}


def test_personal_candidates_are_folded_together(spark):
    new = incoming(spark, [{"id": "n1", "scope": "personal", "source_project": "x"}, {"id": "n2", "source_project": "y"}])
    assert outcomes(reconcile.reconcile_ordered(new, facts(spark, [{"id": "far", "embedding": [0.0, 1.0]}]), S)) == {"n1": ("accepted", None), "n2": ("duplicate", "n1")}


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components_match_union_find(spark, one_task):
    rng = random.Random(1)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(500 + k, 501 + k) for k in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}


def test_similar_pairs_match_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 8)).astype(np.float32)
    v[10] = 0
    df = spark.createDataFrame([(f"{k:04}", x.tolist()) for k, x in enumerate(v)] + [("none", None), ("short", [1.0])], "id string, embedding array<float>")
    got = {(r.a, r.b): r.score for r in similar_pairs(df, 0.5, size=40).collect()}
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v.astype(float), n, out=np.zeros(v.shape), where=n > 0)
    c = u @ u.T
    want = {(f"{i:04}", f"{j:04}") for i in range(150) for j in range(i + 1, 150) if c[i, j] >= 0.5}
    assert set(got) == want and all(abs(got[k] - c[int(k[0]), int(k[1])]) < 1e-6 for k in want)


@pytest.mark.parametrize("one_task", [10**6, 500, 0])
def test_links_have_the_components_of_pairs(spark, one_task):
    rng = np.random.default_rng(8)
    v = np.float32(rng.normal(size=(300, 6)))
    df = spark.createDataFrame([(f"{k:04}", x.tolist()) for k, x in enumerate(v)] + [("9999", [])], "id string, embedding array<float>")
    pairs, links = similar_pairs(df, 0.85, size=40), similarity.similar_links(df, 0.85, F.col("id").cast("long"), size=40)
    labels = lambda edges: sorted(map(tuple, connected_components(edges, one_task=one_task).collect()))
    assert labels(links) == labels(pairs) and 2 < len({c for _, c in labels(links)}) < len(labels(links))


def test_stars_hold_no_more_than_nodes():
    rng = np.random.default_rng(9)
    stars, every = components.Stars(chunk=100), []
    for _ in range(50):
        a, b = rng.integers(0, 60, (2, 70))
        a[:5] = b[:5] = 99  # loops
        stars.add(a, b)
        every.append((a, b))
        assert stars.rows <= 200
    assert [x.tolist() for x in stars.labels()] == [x.tolist() for x in components.label_arrays(*map(np.concatenate, zip(*every)))]
    assert [len(x) for x in components.Stars().labels()] == [0, 0]


def test_consolidation_end_to_end(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    rows = [{"id": f"p{k}", "source_project": f"proj{k}", "category": "preference" if k else "fact"} for k in range(3)]
    rows += [{"id": f"e{k}", "entity": "style", "embedding": [0.0, 1.0, 0.0] if k == 0 else [[0.0, 0.0, 1.0], [0.0, -1.0, 0.0]][k - 1], "confidence": 0.7 + k / 10, "scope": "personal"} for k in range(3)]
    for r in rows[:3]:
        r["embedding"] = [1.0, 0.0, 0.0]
    store.insert(facts(spark, rows))
    dry = jobs.settle_job(store, lambda: StubModel(3), S, dry_run=True)
    assert dry.counts == {"promotions": 1, "syntheses": 1} and store.version() == 1
    report = jobs.settle_job(store, lambda: StubModel(3), S)
    assert report.counts["failed"] == 0
    made = {r.entity: r for r in store.read().where("source_session = 'settling'").collect()}
    assert made[None].scope == "personal" and made[None].category == "preference" and made[None].supersedes == "p0" and made[None].lifecycle == "candidate" and abs(made[None].confidence - 0.8) < 1e-6
    assert made["style"].scope == "personal" and abs(made["style"].confidence - 0.9) < 1e-6 and made["style"].source_project is None
    assert {r.superseded_by for r in store.read().where("id like 'p%' and source_session <> 'settling'").collect()} == {made[None].id}
    again = jobs.settle_job(store, lambda: StubModel(3), S)
    assert again.counts == {"promotions": 0, "syntheses": 0}


def test_a_model_that_fails_leaves_the_item(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    store.insert(facts(spark, [{"source_project": f"proj{k}"} for k in range(3)]))
    report = jobs.settle_job(store, lambda: StubModel(2, {"FACTS": "not json"}), S)
    assert report.counts["failed"] == 1 and store.version() == 1


def test_vote_ties_and_defaults(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "y"), ("b", "x"), ("c", None)], "k string, v string")
    assert {r.k: r.v for r in settle.vote(df, "k", "v", "none").collect()} == {"a": "x", "b": "y", "c": "none"}


def test_store(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    assert store.read().count() == 0 and FactStore(spark, f"file://{tmp_path}/store").version() == 0
    row = facts(spark, [{"id": "a", "embedding": [0.5, 0.25, 1.0], "entity": "indent", "confidence": 0.42}])
    store.insert(row)
    assert store.read().collect() == row.collect() and store.unsound().count() == 0
    for bad in ([{"id": "b", "embedding": [1.0] * 4}], [{"id": "b", "embedding": [1.0] * 3}, {"id": "c", "embedding": [1.0]}], [{"id": "a", "embedding": [1.0] * 3}], [{"id": "b", "embedding": [1.0] * 3, "scope": "team"}], [{"id": "b", "embedding": [1.0] * 3, "content": None}]):
        with pytest.raises(StoreError):
            store.insert(facts(spark, [{k: v for k, v in r.items()} for r in bad]))
    assert store.version() == 1
    new = facts(spark, [{"id": "n", "embedding": [1.0] * 3}])
    with pytest.raises(StoreError):
        store.settle(row, spark.createDataFrame([("a", "a")], "new_id string, old_id string"))
    store.settle(new, spark.createDataFrame([("n", "a")], "new_id string, old_id string"))
    assert store.read().where("id = 'a'").first().superseded_by == "n"
    store.settle(facts(spark, [{"id": "m", "embedding": [1.0] * 3}]), spark.createDataFrame([], "new_id string, old_id string"))
    assert store.read().where("superseded_by is not null").count() == 1
    store.accept("n")
    store.promote("n")
    assert store.read().where("id = 'n'").first().scope == "personal"
    for call in (lambda: store.accept("zz"), lambda: store.update_scope("n", "team")):
        with pytest.raises(StoreError):
            call()
    store.delete("n")
    store.delete("n")
    assert {r.id for r in store.read().collect()} == {"a", "m"} and store.read(1).count() == 1
    store.insert_placeholder("ph", "text", dim=3, confidence=0.9)
    assert store.read().where("id = 'ph'").first().lifecycle == "accepted"


def test_settings_overlay(tmp_path):
    (tmp_path / "c.toml").write_text("[thresholds]\ndrop_below = 0.5\n[chunks]\nchunk_max_tokens = 10\nunknown = 1\n")
    s = Settings.from_toml(tmp_path / "c.toml")
    assert (s.drop_below, s.chunk_max_tokens, s.accept_from) == (0.5, 10, 0.85)


def test_recall_and_search(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    model = StubModel(16)
    store.insert(facts(spark, [{"content": "likes tea", "embedding": model.embed(["likes tea"])[0]}, {"content": "has a cat", "embedding": model.embed(["has a cat"])[0]}]))
    assert jobs.recall(store, "likes tea", lambda: model, 1) == "- (project/fact) likes tea"
    assert jobs.recall(store, "x", lambda: model, scope="team") == "invalid scope: team"
    assert serve.search(store.read(), "cat").first().content == serve.search(store.read(), "has a cat", model).first().content


def test_fold_matches_row_by_row_reading():
    from datetime import datetime, timedelta

    import numpy as np
    import pandas as pd

    from factloom.operators.reconcile import fold
    from factloom.settings import Settings

    s = Settings(duplicate_above=0.8, supersede_from=0.2, supersede_below=0.7)
    rng = np.random.default_rng(3)
    start = datetime(2024, 1, 1)

    def rows(n, tag):
        out = []
        for k in range(n):
            v = rng.integers(-2, 3, 4 if rng.random() < 0.9 else 3).astype(float)
            scope = "personal" if rng.random() < 0.3 else "project"
            out.append(dict(id=f"{tag}{k:03}", scope=scope, source_project=None if scope == "personal" else f"p{rng.integers(2)}", entity=rng.choice(["a", "b", None]), embedding=v.tolist(),
                            created_at=start + timedelta(minutes=int(rng.integers(5))), superseded_by="x" if tag == "s" and rng.random() < 0.1 else None, seq=f"{k:03}", outcome="low_confidence" if rng.random() < 0.1 else None, lifecycle="accepted"))
        return pd.DataFrame(out)

    def cos(a, b):
        a, b = np.array(a), np.array(b)
        d = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
        return round(float(a @ b) / d, 12) if d else 0.0

    for _ in range(20):
        old, new = rows(30, "s"), rows(30, "n")
        have = [dict(r._asdict(), live=True) for r in old[old["superseded_by"].isna()].itertuples()]
        want = []
        for r in (x._asdict() for x in new.itertuples()):
            if isinstance(r["outcome"], str):
                want.append((r["id"], r["outcome"], None, []))
                continue
            own = lambda x: isinstance(r["source_project"], str) and x["source_project"] == r["source_project"]  # noqa: B023, E731
            may = sorted((-cos(x["embedding"], r["embedding"]), x["id"]) for x in have if x["live"] and (x["scope"] == "personal" or r["scope"] == "project" and own(x)))
            if may and -may[0][0] > s.duplicate_above:
                want.append((r["id"], "duplicate", may[0][1], []))
                continue
            band = [x for x in have if x["live"] and own(x) and isinstance(r["entity"], str) and x["entity"] == r["entity"] and s.supersede_from <= cos(x["embedding"], r["embedding"]) < s.supersede_below]
            band.sort(key=lambda x: (-x["created_at"].timestamp(), x["id"]))
            for x in band:
                x["live"] = False
            have.append(dict(r, live=True))
            want.append((r["id"], "accepted", band[0]["id"] if band else None, [x["id"] for x in band]))
        got = fold(new, old, s)
        assert [(r.id, r.outcome, r.ref_id if isinstance(r.ref_id, str) else None, list(r.superseded)) for r in got.itertuples()] == want


def test_written_tables_are_dropped(spark):
    from factloom.sources.workspace import drop_tables, materialize, tables_written

    before = tables_written()
    one, two, three = (materialize(spark.range(k), f"t{k}") for k in (1, 2, 3))
    drop_tables(spark, before, keep=1)
    assert tables_written() == before + 1 and three.count() == 3
    drop_tables(spark, before)
    assert tables_written() == before
    for gone in (one, two, three):
        with pytest.raises(Exception, match="(?i)not.?exist"):
            gone.count()


def test_base_model_and_chat_template():
    from factloom.functions.model import BaseModel, render_chat

    class Echo(BaseModel):
        dim = 1

        def generate(self, prompt, max_tokens):
            return prompt

        def embed_one(self, text):
            return [float(len(text))]

    talk = [("system", "be brief"), ("user", "one"), ("assistant", "1"), ("user", "two")]
    assert Echo().chat(talk, 9) == "be brief\n\ntwo" and Echo().chat([("user", "x")], 9) == "\n\nx"
    assert Echo().embed(["a", "bcd"]) == [[1.0], [3.0]]
    assert render_chat(talk[:2]) == "<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\none<|im_end|>\n<|im_start|>assistant\n"

    class Templated(Echo):
        turn, answer = "[{role}]{content};", "[assistant]"

    assert Templated().chat(talk, 9) == "[system]be brief;[user]one;[assistant]1;[user]two;[assistant]"
