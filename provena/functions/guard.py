"""Instructions to the model inside passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name and pattern of each kind of instruction, in order.
PATTERNS = (
    (
        "ignora_istruzioni",
        r"\b(ignor\w*|disregard|dimentic\w*|forget|override)\b[^.\n]{0,40}\b"
        r"(previous|prior|above|earlier|all|precedent\w*|sopra|tutte le)\b[^.\n]{0,20}\b"
        r"(instructions?|prompts?|rules?|istruzion\w*|indicazion\w*|regol\w*)\b",
    ),
    (
        "nuovo_ruolo",
        r"\b(you are now|from now on you|act as|pretend (to be|you are)|sei ora|da ora (in poi )?(sei|agisci)|"
        r"fingi di essere|comportati come)\b",
    ),
    (
        "rivela_prompt",
        r"\b(reveal|print|show|repeat|output|rivela|mostra|stampa|ripeti)\b[^.\n]{0,30}\b"
        r"(system prompt|prompt di sistema|your (instructions|prompt)|le tue istruzioni|il tuo prompt)\b",
    ),
    ("marcatore_di_ruolo", r"(^|\n)\s*(system|assistant|user|###\s*(system|instruction)s?)\s*:"),
    (
        "istruzione_all_assistente",
        r"\b(assistant|assistente|ai|modello|model|chatbot)\b[^.\n]{0,20}\b"
        r"(must|should|deve|dovra|devi)\b[^.\n]{0,40}\b(respond|reply|answer|rispond\w*|dire|say)\b",
    ),
)


def injection_patterns(text: Column) -> Column:
    """Names of the kinds of instruction in a text, in order; none for an empty or null text."""
    hits = [F.when(F.coalesce(text.rlike("(?isU)" + pattern), F.lit(False)), F.lit(name)) for name, pattern in PATTERNS]
    return F.array_compact(F.array(*hits))


def quarantine(passages: DataFrame, text: str = "text") -> DataFrame:
    """All passages, with injection_suspected and injection_patterns."""
    return passages.withColumn("injection_patterns", injection_patterns(F.col(text))).withColumn("injection_suspected", F.size("injection_patterns") > 0)
