"""From transcript records to conversation chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_noise, text_lines, token_estimate
from ..settings import Settings
from ..sources.workspace import materialize, ship_package

CHUNK = "session string, project string, chunk_index int, text string, approx_tokens bigint"


def shorten_code(text: Column, most: int) -> Column:
    """Fenced blocks of more than ``most`` lines become a one-line note; lines end in a line feed.

    The text is cut at the fences that begin a line, and every other piece is a
    block, so the work is in proportion to the text.
    """
    lines = F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(text_lines(text))
    plain = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    pieces = F.split(plain, "(?dm)^```")
    rest = lambda x: F.substring_index(x, "\n", 1)  # noqa: E731 - what stands beside the fence
    body = lambda x: x.substr(F.length(rest(x)) + 2, F.length(x))

    def block(x, closed):
        lang, code = F.regexp_replace(rest(x), "^`+", ""), body(x)
        n = F.length(code) - F.length(F.translate(code, "\n", ""))
        note = F.concat(F.lit("[code block: "), F.when(lang == "", "code").otherwise(lang), F.lit(", "), n.cast("string"), F.lit(" lines]\n"))
        whole = F.concat(F.lit("```"), lang, F.lit("\n"), code, F.when(closed, "```\n").otherwise(""))
        return F.when(n > most, note).when(closed | (n > 0), whole).otherwise("")

    shown = F.transform(pieces, lambda x, k: F.when(k % 2 == 1, block(x, k < F.size(pieces) - 1)).when(k > 0, body(x)).otherwise(x))
    return F.when(~F.contains(text, F.lit("```")), plain).otherwise(F.array_join(shown, ""))


def record_turns(records: DataFrame, s: Settings) -> DataFrame:
    """(project, session, aside, line_no, role, text) of raw JSON lines (project, session, aside, line_no, value).

    Lines that aren't JSON and other record types are skipped.  A user's text is a
    string (not a command) or its blocks: texts without reminders, and a note for
    each large tool result.  An assistant's is its blocks: texts with long code
    shortened, and a note for each tool used.
    """
    v = F.try_parse_json("value")
    get = lambda x, path, kind="string": F.try_variant_get(x, path, kind)
    base = records.withColumn("v", v).where("v is not null").withColumn("type", get(F.col("v"), "$.type")).where(F.col("type").isin("user", "assistant"))
    base = base.withColumn("content", get(F.col("v"), "$.message.content", "variant"))
    kind = F.schema_of_variant("content")
    keys = ["project", "session", "aside", "line_no"]
    plain = base.where((F.col("type") == "user") & (kind == "STRING")).withColumn("raw", F.col("content").cast("string"))
    plain = plain.where(~F.contains("raw", F.lit("<command-message>")) & ~F.contains("raw", F.lit("<command-name>"))).select(*keys, F.lit("Human").alias("role"), strip_noise("raw").alias("text"))
    arrays = base.where(kind.startswith("ARRAY")).select(*keys, "type", F.col("content").cast("array<variant>").alias("blocks"))
    each = arrays.select(*keys, "type", F.posexplode("blocks").alias("pos", "block"))
    block, text = get(F.col("block"), "$.type"), get(F.col("block"), "$.text")
    size = F.coalesce(F.octet_length(F.to_json(get(F.col("block"), "$.content", "variant"))), F.lit(0))
    cleaned = strip_noise(text)
    user = (
        F.when((block == "text") & ~F.contains(text, F.lit("<system-reminder>")) & (F.trim(F.regexp_replace(cleaned, r"\s", " ")) != ""), cleaned)
        .when((block == "tool_result") & (size > s.tool_result_bytes), F.concat(F.lit("[tool result: "), F.coalesce(get(F.col("block"), "$.tool_use_id"), F.lit("unknown")), F.lit(", "), size.cast("string"), F.lit(" bytes]")))
    )
    assistant = F.when(block == "text", shorten_code(text, s.code_block_lines)).when(block == "tool_use", F.concat(F.lit("[used tool: "), F.coalesce(get(F.col("block"), "$.name"), F.lit("unknown")), F.lit("]")))
    part = each.withColumn("part", F.when(F.col("type") == "user", user).otherwise(assistant)).where("part is not null")
    joined = part.groupBy(*keys, "type").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("p"))
    blocks = joined.select(*keys, F.when(F.col("type") == "user", "Human").otherwise("Assistant").alias("role"), F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("text"))
    return plain.unionByName(blocks).where("text <> ''")


def min_turn_gate(turns: DataFrame, least: int, resumed: DataFrame | None = None) -> DataFrame:
    """Turns of sessions with at least ``least`` human turns; asides and resumed sessions pass."""
    enough = turns.groupBy("session").agg(F.count_if(F.col("role") == "Human").alias("n")).where(F.col("n") >= least).select("session")
    if resumed is not None:
        enough = enough.union(resumed.select("session")).distinct()
    aside = F.col("aside") if "aside" in turns.columns else F.lit(False)
    marked = turns.join(enough.withColumn("__ok", F.lit(True)), "session", "left")
    return marked.where(aside | F.col("__ok").isNotNull()).drop("__ok")


def aside_turns(turns: DataFrame) -> DataFrame:
    """Of aside sessions only the last human turn, trimmed, and the assistant's turns after it; blank ones go."""
    by = Window.partitionBy("session")
    last = F.max(F.when(F.col("role") == "Human", F.col("line_no"))).over(by)
    text = F.when(F.col("role") == "Human", F.regexp_replace("text", r"^\s+|\s+$", "")).otherwise(F.col("text"))
    return turns.withColumn("__last", last).where("line_no >= __last").withColumn("text", text).where(F.regexp_replace("text", r"\s", "") != "").drop("__last")


def merge_turns(turns: DataFrame) -> DataFrame:
    """(session, turn, role, text): consecutive turns of one role joined by line feeds; turn counts from 0."""
    by = Window.partitionBy("session").orderBy("line_no")
    new = F.when(F.lag("role").over(by) == F.col("role"), 0).otherwise(1)
    marked = turns.withColumn("__new", new).withColumn("turn", F.sum("__new").over(by).cast("bigint") - 1)
    rows = marked.groupBy("session", "turn", "role").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("t"))
    return rows.select("session", "turn", "role", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def format_conversation(merged: DataFrame) -> DataFrame:
    """(session, text): "Role: text" and a blank line for each turn in order."""
    rows = merged.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("session", _joined("t").alias("text"))


def _joined(turns: str) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(": "), x["text"], F.lit("\n\n"))), "")


def pack_paragraphs(text: str, most: int, overlap: int, remember: int = 5) -> list[tuple[str, int]]:
    """(chunk, tokens): paragraphs in order, as many as fit; a new chunk repeats some of those before.

    The repeated ones start from the earliest of the last ``remember`` and stop
    before the budget ``overlap`` is passed.  A paragraph that is too long by
    itself is packed by lines; a chunk may exceed ``most`` by its overlap or by one long line.
    """
    tokens = lambda t: len(t.encode()) // 4
    if tokens(text) <= most:
        return [(text, tokens(text))]
    out: list[tuple[str, int]] = []
    held, weight, recent = [], 0, []

    def emit():
        nonlocal held, weight
        if held:
            out.append(("".join(held), weight))
        held, weight = [], 0

    for paragraph in text.split("\n\n"):
        n = tokens(paragraph)
        if n > most:
            emit()
            for line in paragraph.split("\n"):
                if weight + tokens(line) > most:
                    emit()
                held.append(line + "\n")
                weight += tokens(line)
            recent = []
            continue
        if held and weight + n > most:
            emit()
            for earlier in recent:
                if weight + tokens(earlier) > overlap:
                    break
                held.append(earlier + "\n\n")
                weight += tokens(earlier)
        held.append(paragraph + "\n\n")
        weight += n
        recent = [*recent, paragraph][-remember:]
    emit()
    return out


def chunk(conversations: DataFrame, s: Settings) -> DataFrame:
    """Chunks of (project, session, text).  Short texts stay in the JVM; only long ones are packed in Python."""
    ship_package(conversations.sparkSession)
    text = conversations.withColumn("approx_tokens", token_estimate("text"))
    short = text.where(F.col("approx_tokens") <= s.chunk_max_tokens).select("session", "project", F.lit(0).alias("chunk_index"), "text", "approx_tokens")

    @F.pandas_udf("array<struct<text:string, approx_tokens:bigint>>")
    def pack(col: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "approx_tokens": n} for t, n in pack_paragraphs(x, s.chunk_max_tokens, s.chunk_overlap_tokens, s.overlap_paragraphs)] for x in col])

    long_ = text.where(F.col("approx_tokens") > s.chunk_max_tokens).select("session", "project", F.posexplode(pack("text")).alias("chunk_index", "c")).select("session", "project", "chunk_index", "c.text", "c.approx_tokens")
    return short.unionByName(long_)


def preprocess(records: DataFrame, s: Settings, resumed: DataFrame | None = None) -> DataFrame:
    """Chunks of raw transcript lines: turns, gate, asides, merge, format, pack."""
    return preprocess_turns(materialize(record_turns(records, s), "turns"), s, resumed)


def preprocess_turns(turns: DataFrame, s: Settings, resumed: DataFrame | None = None) -> DataFrame:
    """The same of turns, which should be a written table, as they are read several times."""
    turns = min_turn_gate(turns, s.min_human_turns, resumed)
    project = turns.groupBy("session").agg(F.min("project").alias("project"))
    main = turns.where("not aside").select("session", "line_no", "role", "text")
    own = aside_turns(turns.where("aside").select("session", "line_no", "role", "text"))
    merged = merge_turns(main.unionByName(own))
    rows = merged.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.max(F.regexp_replace("text", r"\s", "") != "").alias("some")).where("some")
    talk = rows.select("session", _joined("t").alias("text"))
    return chunk(talk.join(project, "session"), s)
