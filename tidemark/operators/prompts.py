"""What a model is asked, as text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ENTITY_TYPES, FUNCTIONAL, MULTI
from ..functions.text import iso_time

#: Stands for the history of a session's first message.
FIRST = "(none: this message opens the session, so its recurrence is 0)"


SCORES = "Rate how much this message matters for long-term memory. Answer with one JSON object of four numbers from 0 to 1: surprise, arousal, self_ref, recurrence.\nTurns before it:\n"
FACTS = (
    "List what this turn states as true now. Answer with one JSON object: facts (subject, predicate, object, confidence) and entities (name, entity_type, aliases).\n"
    f"Predicates: {', '.join((*FUNCTIONAL, *MULTI))}. Entity types: {', '.join(ENTITY_TYPES)}.\nThe speaker is called \""
)
SPEAKER = "\". Leave out questions, guesses and what has ended; give empty lists if nothing is left.\nTurn ("


def salience_prompt(content: Column, history: Column, turns: int = 5) -> Column:
    """Asks for the four scores of a message, given the last turns before it."""
    last = F.when(F.size(history) > turns, F.slice(history, F.size(history) - turns + 1, turns)).otherwise(history)
    known = F.when(F.size(history) > 0, F.array_join(F.transform(last, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(FIRST)
    return F.concat(F.lit(SCORES), known, F.lit("\nMessage:\n"), content)


def extraction_prompt(content: Column, subject: Column, role: Column, created_at: Column) -> Column:
    """Asks for the facts and entities of a turn; what the speaker says about themselves is about subject."""
    return F.concat(F.lit(FACTS), subject, F.lit(SPEAKER), role, F.lit(", "), iso_time(created_at), F.lit("):\n"), content)
