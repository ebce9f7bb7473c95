"""Transcripts: records, turns, chunks, discovery, the cursor and the tailing source."""

import json
import os

import pytest
from pyspark.sql import functions as F

from factloom.functions.model import StubModel
from factloom.functions.text import strip_noise, token_estimate
from factloom.operators import transcripts as tr
from factloom.plans import jobs
from factloom.settings import Settings
from factloom.sources import sessions
from factloom.sources.store import FactStore
from factloom.streaming import ingest
from factloom.streaming.tail import TailSource

S = Settings()


def user(content):
    return json.dumps({"type": "user", "message": {"role": "user", "content": content}})


def assistant(*blocks):
    return json.dumps({"type": "assistant", "message": {"role": "assistant", "content": list(blocks)}})


def text(t):
    return {"type": "text", "text": t}


def records(spark, lines, session="s", aside=False):
    return spark.createDataFrame([("p", session, aside, k, v) for k, v in enumerate(lines)], "project string, session string, aside boolean, line_no long, value string")


def turns_of(spark, lines):
    return [(r.role, r.text) for r in tr.record_turns(records(spark, lines), S).orderBy("line_no").collect()]


def test_records_to_turns(spark):
    small, big = {"type": "tool_result", "tool_use_id": "t1", "content": "x" * 400}, {"type": "tool_result", "tool_use_id": "t2", "content": "y" * 600}
    got = turns_of(spark, [
        user("plain é"),
        "not json",
        "",
        user("<command-message>init</command-message>"),
        user([text("one"), small, text("<system-reminder>no</system-reminder>"), big, text(" \n"), {"type": "image"}]),
        user([small]),
        json.dumps({"type": "progress", "message": {"content": "skip"}}),
        assistant(text("answer"), {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "Read", "input": {}}, {"type": "tool_use"}),
        json.dumps({"type": "assistant", "message": {"content": "a string"}}),
        json.dumps({"type": "user"}),
        json.dumps([1]),
        user("<bash-input>ls</bash-input>"),
    ])
    assert got == [
        ("Human", "plain é"),
        ("Human", "one\n[tool result: t2, 602 bytes]"),
        ("Assistant", "answer\n\n[used tool: Read]\n[used tool: unknown]"),
        ("Human", "ls"),
    ]


def test_noise(spark):
    cases = {
        "a<system-reminder>x\ny</system-reminder>b<system-reminder>z</system-reminder>c": "abc",
        "<local-command-caveat>q</local-command-caveat><local-command-stdout>out</local-command-stdout>": "out",
        "</system-reminder>x<system-reminder>": "</system-reminder>x<system-reminder>",
        "<bash-stderr></bash-stderr>": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(strip_noise("t")).collect()] == list(cases.values())


@pytest.mark.parametrize("n, kept", [(20, True), (21, False)])
def test_code_blocks(spark, n, kept):
    body = "\n".join(f"line {k}" for k in range(n))
    df = spark.createDataFrame([(f"a\n```py\n{body}\n```\nb",), (f"```\n{body}",), ("plain\n",), ("",), ("```",)], "t string")
    got = [r[0] for r in df.select(tr.shorten_code(F.col("t"), 20)).collect()]
    assert got[0] == ("a\n```py\n" + body + "\n```\nb\n" if kept else f"a\n[code block: py, {n} lines]\nb\n")
    assert got[1] == ("```\n" + body + "\n" if kept else f"[code block: code, {n} lines]\n")
    assert got[2:] == ["plain\n", "", ""]


def test_tokens_are_bytes_by_four(spark):
    df = spark.createDataFrame([("é—é—",), ("",), ("abcdefg",)], "t string")
    assert [r[0] for r in df.select(token_estimate("t")).collect()] == [2, 0, 1]


def test_merge_gate_and_format(spark):
    rows = [("s", 1, "Human", "a"), ("s", 2, "Human", "b"), ("s", 5, "Assistant", "c"), ("s", 9, "Human", "d"), ("t", 1, "Human", "x")]
    turns = spark.createDataFrame(rows, "session string, line_no long, role string, text string")
    merged = tr.merge_turns(turns)
    assert [tuple(r) for r in merged.where("session = 's'").orderBy("turn").collect()] == [("s", 0, "Human", "a\nb"), ("s", 1, "Assistant", "c"), ("s", 2, "Human", "d")]
    assert {r.session: r.text for r in tr.format_conversation(merged).collect()} == {"s": "Human: a\nb\n\nAssistant: c\n\nHuman: d\n\n", "t": "Human: x\n\n"}
    gated = lambda resumed=None: {r.session for r in tr.min_turn_gate(turns, 3, resumed).collect()}
    assert gated() == {"s"} and gated(spark.createDataFrame([("t",)], "session string")) == {"s", "t"}


def test_aside(spark):
    rows = [("s", 1, "Human", "before"), ("s", 2, "Assistant", "old"), ("s", 3, "Human", " aside? "), ("s", 4, "Assistant", " yes"), ("s", 5, "Assistant", " \n"), ("t", 1, "Assistant", "no human")]
    turns = spark.createDataFrame(rows, "session string, line_no long, role string, text string")
    assert [(r.role, r.text) for r in tr.aside_turns(turns).orderBy("line_no").collect()] == [("Human", "aside?"), ("Assistant", " yes")]


def test_packing_of_paragraphs():
    p = [c * 40 for c in "abcdefgh"]  # ten tokens each
    whole = "\n\n".join(p)
    assert tr.pack_paragraphs("short", 10, 5) == [("short", 1)]
    plain = tr.pack_paragraphs(whole, 30, 0)
    assert [n for _, n in plain] == [30, 30, 20] and "".join(c for c, _ in plain) == whole + "\n\n"
    # the overlap starts at the earliest of the last five paragraphs
    lapped = tr.pack_paragraphs(whole, 30, 10)
    assert lapped[1][0].startswith(p[0]) and lapped[1][1] == 30
    long_ = tr.pack_paragraphs("x\n\n" + "\n".join("y" * 40 for _ in range(8)) + "\n\nz", 30, 10)
    assert long_[0] == ("x\n\n", 0) and [n for _, n in long_[1:3]] == [30, 30] and long_[-1][0].endswith("z\n\n")
    assert tr.pack_paragraphs("w" * 4000, 30, 10) == [("w" * 4000 + "\n", 1000)]


@pytest.fixture
def tree(tmp_path):
    """Two projects with sessions, one aside, and a file that isn't a session."""
    talk = [user(f"I prefer option {k} here") for k in range(4)] + [assistant(text("fine"))]
    for project, session, lines in (("-home-a", "s1", talk), ("-home-a", "s2", talk[:2]), ("-home-b", "s3", [*talk, "broken {", ""])):
        d = tmp_path / "root" / project
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{session}.jsonl").write_text("\n".join(lines) + "\n")
    aside = tmp_path / "root" / "-home-a" / "s1" / "subagents"
    aside.mkdir(parents=True)
    (aside / "agent-aside_question-1.jsonl").write_text("\n".join([*talk, user("what about tea?"), assistant(text("tea is fine"))]) + "\n")
    (aside / "agent-other.jsonl").write_text(user("no") + "\n")
    (tmp_path / "root" / "-home-a" / "notes.txt").write_text("x")
    for k, name in enumerate(("-home-b/s3", "-home-a/s1", "-home-a/s2", "-home-a/s1/subagents/agent-aside_question-1")):
        os.utime(tmp_path / "root" / f"{name}.jsonl", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(tmp_path / "root")


def test_discovery(spark, tree):
    files = sessions.discover(spark, tree)
    assert [(r.project, r.session, r.aside) for r in files.collect()] == [("-home-b", "s3", False), ("-home-a", "s1", False), ("-home-a", "s2", False), ("-home-a", "agent-aside_question-1", True)]
    assert files.where("aside").first().key == "-home-a/s1/subagents/agent-aside_question-1.jsonl"
    assert {r.project for r in sessions.discover(spark, tree, exclude=["/home/a"]).collect()} == {"-home-b"}
    assert sessions.discover(spark, tree, limit=2).count() == 2 and sessions.discover(spark, tree + "/none").count() == 0
    assert [tuple(r) for r in sessions.per_project(files).collect()] == [("-home-a", 3, 1), ("-home-b", 1, 0)]
    lines = sessions.raw_lines(spark, files)
    assert lines.where("session = 's3'").count() == 6 and sessions.raw_lines(spark, files.limit(0)).count() == 0


def test_preprocess(spark, tree):
    chunks = tr.preprocess(sessions.raw_lines(spark, sessions.discover(spark, tree)), S)
    got = {r.session: r.text for r in chunks.collect()}
    assert set(got) == {"s1", "s3", "agent-aside_question-1"}
    assert got["agent-aside_question-1"] == "Human: what about tea?\n\nAssistant: tea is fine\n\n\n"


def test_cursor(spark, tree):
    files = sessions.discover(spark, tree)
    none = sessions.read_cursor(spark, "")
    assert sessions.needs_processing(files, none).count() == 4
    done = files.select("key", F.col("mtime").cast("long").alias("mtime"), F.col("size").alias("offset"))
    cursor = sessions.mark_processed(none, done)
    assert sessions.needs_processing(files, cursor).count() == 0
    saved = sessions.save_cursor(cursor)
    assert sessions.needs_processing(files, sessions.read_cursor(spark, saved)).count() == 0
    with open(f"{tree}/-home-b/s3.jsonl", "a") as f:
        f.write(user("more") + "\n")
    again = sessions.needs_processing(sessions.discover(spark, tree), sessions.read_cursor(spark, saved)).collect()
    assert [r.session for r in again] == ["s3"] and again[0].offset > 0
    old = sessions.read_cursor(spark, '{"-home-a/s1.jsonl": 1700000001, "x": {"mtime": 5, "offset": 6}}')
    assert {r.key: (r.mtime, r.offset) for r in old.collect()} == {"-home-a/s1.jsonl": (1700000001, 0), "x": (5, 6)}


def test_reconcile_depths(spark, tree, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    factory = lambda: StubModel(16)
    report = jobs.reconcile_job(spark, tree, store, factory, S, depth="chunks")
    assert report.counts == {"chunks": 3, "files": 4}
    assert jobs.chunk_preview(report.tables["chunks"], 1, 8).where("session = 's1'").first().line == "Human: I..."
    report = jobs.reconcile_job(spark, tree, store, factory, S, depth="reconcile", session_prefix="s3")
    assert report.counts["extracted"] == report.counts["curated"] == 4 and report.counts["outcome_accepted"] == 4 and store.version() == 0
    report = jobs.reconcile_job(spark, tree, store, factory, S)
    # each option replaces the one before; of the second session only the live one is a duplicate
    assert report.counts["extracted"] == 8 and report.counts["outcome_accepted"] == 7 and report.counts["outcome_duplicate"] == 1
    assert store.read().count() == 7 and store.read().where("superseded_by is null").count() == 2
    again = jobs.reconcile_job(spark, tree, store, factory, S)
    assert again.counts["known"] == 7 and again.counts["incoming"] == 1 and store.version() == 1


def recording(folder):
    """A factory of models that leave each extraction prompt in a folder."""
    import uuid

    class Recording(StubModel):
        def generate(self, prompt, max_tokens):
            if "CANDIDATES" not in prompt:
                (folder / uuid.uuid4().hex).write_text(prompt)
            return super().generate(prompt, max_tokens)

    return lambda: Recording(16)


def test_job_resumes_where_it_ended(spark, tree, tmp_path):
    store, cursor = FactStore(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/cursor.json"
    asked = tmp_path / "asked"

    def run(**more):
        asked.mkdir()
        counts = jobs.reconcile_job(spark, tree, store, recording(asked), S, cursor=cursor, **more).counts
        prompts_ = [p.read_text() for p in asked.iterdir()]
        for p in asked.iterdir():
            p.unlink()
        asked.rmdir()
        return counts, prompts_

    assert len(run(depth="extract")[1]) == 3 and not os.path.exists(tmp_path / "cursor.json")
    counts, prompts_ = run()
    assert (counts["files"], counts["skipped_by_cursor"], counts["skipped_short"]) == (4, 0, 1) and len(prompts_) == 3
    version = store.version()
    counts, prompts_ = run()
    # the short session and the one that ends in a broken line are looked at again, but nothing is asked
    assert prompts_ == [] and counts["skipped_by_cursor"] == 2 and store.version() == version
    with open(f"{tree}/-home-a/s1.jsonl", "a") as f:
        f.write(user("I prefer green tea") + "\n" + '{"type": "user", "message": {"content": "I pre')
    with open(f"{tree}/-home-a/s2.jsonl", "a") as f:
        f.write(user("I prefer the third way") + "\n" + user("and no other") + "\n")
    counts, prompts_ = run()
    one, two = sorted(prompts_, key=lambda x: "third way" in x)
    assert "green tea" in one and "option" not in one and "I pre\n" not in one and "option 0" in two and "third way" in two
    with open(f"{tree}/-home-a/s1.jsonl", "a") as f:
        f.write('fer black coffee"}}\n')
    counts, prompts_ = run()
    assert len(prompts_) == 1 and "black coffee" in prompts_[0] and "green tea" not in prompts_[0] and counts["skipped_by_cursor"] == 2


def test_lines_from_an_offset_on(spark, tmp_path):
    (tmp_path / "p").mkdir()
    raw = "é one\r\n\ntwo\nthree".encode()
    (tmp_path / "p" / "s.jsonl").write_bytes(raw)
    files = sessions.discover(spark, str(tmp_path))
    for at, want in ((0, ["é one", "two", "three"]), (8, ["two", "three"]), (raw.index(b"three"), ["three"]), (len(raw), [])):
        got = sessions.raw_lines(spark, files.withColumn("offset", F.lit(at).cast("long")))
        assert [r.value for r in got.orderBy("line_no").collect()] == want


def test_code_blocks_match_a_line_by_line_reading(spark):
    import random

    def slow(text, most):
        out, inside, lang, code = "", False, "", []
        lines = [] if text == "" else re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", text))
        for line in lines:
            if line.startswith("```"):
                if inside:
                    out += f"[code block: {lang or 'code'}, {len(code)} lines]\n" if len(code) > most else "".join(f"{x}\n" for x in [f"```{lang}", *code, "```"])
                    inside = False
                else:
                    inside, lang, code = True, line.lstrip("`"), []
            elif inside:
                code.append(line)
            else:
                out += line + "\n"
        if inside and code:
            out += f"[code block: {lang or 'code'}, {len(code)} lines]\n" if len(code) > most else "".join(f"{x}\n" for x in [f"```{lang}", *code])
        return out

    import re

    rng = random.Random(4)
    texts = ["\n".join(rng.choice(("```", "```py", "````x", "a", " ```", "b ``` c", "", "é")) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.x for r in df.select("k", tr.shorten_code(F.col("t"), 2).alias("x")).collect()}
    for k, t in enumerate(texts):
        if not re.search(r"\n{2,}\Z", t):
            assert got[k] == slow(t, 2), repr(t)


def test_asides_of_a_stream(spark, tree, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    ingest.start(spark, f"file://{tree}/-home-a/s1/subagents/*.jsonl", store, f"{tmp_path}/check", lambda: StubModel(16), S).awaitTermination()
    # of an aside only what was asked last counts, and other agents' files don't
    assert store.read().count() == 0
    with open(f"{tree}/-home-a/s1/subagents/agent-aside_question-1.jsonl", "a") as f:
        f.write(user("I prefer green tea") + "\n" + assistant(text("fine")) + "\n")
    ingest.start(spark, f"file://{tree}/-home-a/s1/subagents/*.jsonl", store, f"{tmp_path}/check", lambda: StubModel(16), S).awaitTermination()
    rows = store.read().collect()
    assert [(r.source_session, "green tea" in r.content) for r in rows] == [("agent-aside_question-1", True)]


def test_dead_letters(spark, tree, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    report = jobs.reconcile_job(spark, tree, store, lambda: StubModel(16, {"option 3": "I can't say"}), S, depth="extract")
    assert report.counts["dead_letters"] == 2 and report.counts["extracted"] == 0


def test_tail_source_sees_appends(spark, tmp_path):
    spark.dataSource.register(TailSource)
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"one\ntwo\r\n\npart")

    def run():
        lines = spark.readStream.format("tail").option("path", f"{tmp_path}/*.jsonl").option("max_bytes", 4).load()
        q = lines.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("offset", "value").collect())

    assert run() == [(0, "one"), (4, "two")]
    with path.open("ab") as f:
        f.write(b"ial\n")
    (tmp_path / "b.jsonl").write_bytes(b"new\n")
    assert run() == [(0, "new"), (0, "one"), (4, "two"), (10, "partial")]


def test_streaming_ingest_is_incremental(spark, tree, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    run = lambda: ingest.start(spark, f"{tree}/*/*.jsonl", store, f"{tmp_path}/cp", lambda: StubModel(16), S).awaitTermination()
    run()
    first = store.read().count()
    assert first > 0
    with open(f"{tree}/-home-b/s3.jsonl", "a") as f:
        f.write(user("we use kubernetes daily") + "\n")
    run()
    new = store.read().where("content like '%kubernetes%'").collect()
    assert len(new) == 1 and store.read().count() == first + 1


def test_a_session_that_grows_slowly_keeps_its_first_turns(spark, tmp_path):
    (tmp_path / "root" / "p").mkdir(parents=True)
    path = tmp_path / "root" / "p" / "slow.jsonl"
    store = FactStore(spark, f"file://{tmp_path}/store")
    run = lambda: ingest.start(spark, f"{tmp_path}/root/*/*.jsonl", store, f"{tmp_path}/cp", lambda: StubModel(16), S).awaitTermination()
    for k, thing in enumerate(("zebras", "marmalade", "granite", "violins")):
        assert store.read().count() == 0
        with path.open("a") as f:
            f.write(user(f"we like {thing}") + "\n")
        run()
    assert {r.content for r in store.read().collect()} == {"Prefers zebras", "Prefers marmalade", "Prefers granite", "Prefers violins"}
    with path.open("a") as f:
        f.write(user("we like cellos") + "\n")
    run()
    assert store.read().where("content = 'Prefers cellos'").count() == 1
