"""Prompt texts and the columns that fill them in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACT = (
    "You read a conversation between a person and an assistant and list what is worth knowing later: stable facts, choices and habits. "
    "Be selective: most conversations yield nothing or a few entries, and an empty list is a good answer. "
    "Rely on what the person says or plainly accepts; what only the assistant proposes, explains or assumes isn't knowledge about the person. "
    "Note only what will still hold a week from now: no steps of the task at hand, no errors that were just mended, no states of files. "
    "Leave out what the code or its history would tell anyone who looks. "
    "The scope is personal where the statement is about the person in any project (habits, tastes, background), and project where it is about this one; "
    "when in doubt take project, and say in scope_confidence how sure you are of that choice. "
    "Write each content as one sentence that can be understood alone, with names in place of 'it' and 'this'. "
    "Answer with a JSON array of objects with content, scope (personal or project), category (fact, preference, decision, pattern, interest, humor or opinion), "
    "entity (a short lower-case key of the subject, or null), confidence and scope_confidence (0 to 1). "
    "Confidence is high for what is said outright, middling for what is implied, below 0.6 for a guess. Answer with nothing but the array."
)
EXTRACT_SHOTS = [
    ("<conversation>\nHuman: I always write tests first.\n</conversation>", '[{"scope": "personal", "scope_confidence": 0.9, "content": "Writes tests first", "entity": "testing", "category": "pattern", "confidence": 0.9}]'),
    ("<conversation>\nHuman: run it again\n</conversation>", "[]"),
    ("<conversation>\nHuman: here we store times in UTC.\n</conversation>", '[{"scope": "project", "scope_confidence": 0.9, "content": "Stores times in UTC", "entity": "time", "category": "decision", "confidence": 0.85}]'),
]
CURATE = (
    "You check candidate facts against the conversation that they were drawn from. For each candidate decide: keep; keep_as_project, if it is true but only of this project; "
    "drop, if the person didn't say it, if it is trivial, about to pass, or a matter of the task alone; or merge:N, if candidate N says the same. "
    "Answer with a JSON array of objects with index, action and reason, and nothing else."
)
PROMOTE = "These facts were noted separately in several projects. State what they have in common as one general fact. Answer with a JSON object with content, category and confidence."
SYNTHESIZE = "These facts are about one subject. Combine them into one fact that loses nothing. Answer with a JSON object with content, category and confidence."


def extraction(project, session, text) -> Column:
    return F.concat(F.lit("Project: "), project, F.lit("\nSession: "), session, F.lit("\n\n<conversation>\n"), text, F.lit("\n</conversation>"))


def curation(conversation_tail, candidates) -> Column:
    """``candidates`` is an array of structs with scope, category and content."""
    lines = F.transform(candidates, lambda c, i: F.concat(i.cast("string"), F.lit(". ["), c["scope"], F.lit("/"), c["category"], F.lit("] "), c["content"]))
    return F.concat(F.lit("CONVERSATION:\n"), conversation_tail, F.lit("\n\nCANDIDATES ("), F.size(candidates).cast("string"), F.lit("):\n"), F.array_join(lines, "\n"))


def facts(contents, entity=None) -> Column:
    head = F.lit("FACTS:\n") if entity is None else F.concat(F.lit("SUBJECT: "), entity, F.lit("\nFACTS:\n"))
    return F.concat(head, F.array_join(F.transform(contents, lambda c: F.concat(F.lit("- "), c)), "\n"))
