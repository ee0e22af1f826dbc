"""Personal data: redaction, detection and the checks behind them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in the order of redaction: kind, pattern, what replaces it, and whether letters match in either case.
PATTERNS = (
    ("carta_credito", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CARTA_CREDITO]", False),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b", "[IBAN]", True),
    ("codice_fiscale", r"\b[A-Za-z]{6}\d{2}[A-Za-z]{1}\d{2}[A-Za-z]{1}\d{3}[A-Za-z]{1}\b", "[CODICE_FISCALE]", True),
    ("partita_iva", r"\b(?:IT\s?)?\d{11}\b", "[PARTITA_IVA]", True),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]", True),
    ("telefono_italia", r"\b(?:\+39\s?)?(?:0\d{1,4}[-\s]?\d{4,8}|3\d{2}[-\s]?\d{3,4}[-\s]?\d{3,4})\b", "[TELEFONO]", True),
    ("jwt_token", r"eyJ[a-zA-Z0-9_\-]{10,}\.eyJ[a-zA-Z0-9_\-]{10,}\.[a-zA-Z0-9_\-]{10,}", "[JWT_TOKEN]", True),
    ("api_key_generic", r"(?:api[_-]?key|secret[_-]?key|token)\s*[:=]\s*['\"]?([a-zA-Z0-9_\-]{24,})['\"]?", "[API_KEY]", True),
    ("indirizzo_ip", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[IP]", True),
)


def luhn(number: Column) -> Column:
    """Whether the digits of a text, 13 to 19 of them, pass the Luhn check."""
    digits = F.regexp_replace(number, r"\D", "")
    return F.coalesce(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), F.lit(False))


def iban(code: Column) -> Column:
    """Whether a text of 15 to 34 characters is an IBAN: its first four characters at the end, letters as 10 to 35, the remainder by 97 is 1."""
    clean = F.upper(F.regexp_replace(code, r"\s+", ""))
    turned = F.concat(F.substring(clean, F.lit(5), F.length(clean)), F.substring(clean, 1, 4))
    digit = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c == "", s).when(c.between("0", "9"), (s * 10 + digit(c)) % 97).otherwise((s * 100 + digit(c)) % 97))
    return F.coalesce(F.length(clean).between(15, 34) & clean.rlike("^[A-Z0-9]+$") & (rest == 1), F.lit(False))


def redact_simple(text: Column, kinds: tuple[str, ...] = ("codice_fiscale", "partita_iva", "email", "telefono_italia", "jwt_token", "indirizzo_ip")) -> Column:
    """The kinds that need no check, one after another, as nested replacements inside the JVM."""
    for kind, pattern, mark, either in PATTERNS:
        if kind in kinds:
            text = F.regexp_replace(text, ("(?iU)" if either else "(?U)") + pattern, mark)
    return text


def _luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def _iban(text: str) -> bool:
    clean = "".join(text.split()).upper()
    if not 15 <= len(clean) <= 34 or not clean.isalnum():
        return False
    try:
        return int("".join(str(int(c, 36)) for c in clean[4:] + clean[:4])) % 97 == 1
    except ValueError:
        return False


#: What a match must pass to count.
_CHECKS = {"carta_credito": _luhn, "iban": _iban}


def _compiled():
    return [(kind, re.compile(pattern, re.IGNORECASE if either else 0), mark, _CHECKS.get(kind)) for kind, pattern, mark, either in PATTERNS]


def redact(df: DataFrame, column: str, rules: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """``df`` with personal data in a text column replaced by marks; ``rules`` are more (pattern, replacement) pairs, applied last.

    Cards and IBANs are replaced only if their checks hold; of an API key only
    the key.  Later kinds see what earlier ones left.  Null stays null."""

    def work(batches):
        kinds = _compiled()
        more = [(re.compile(p, re.IGNORECASE), r) for p, r in rules]
        for batch in batches:
            out = []
            for text in batch.column(column).to_pylist():
                for kind, pattern, mark, check in kinds if text else ():
                    if kind == "api_key_generic":
                        text = pattern.sub(lambda m, mark=mark: m[0].replace(m[1], mark), text)
                    else:
                        text = pattern.sub(lambda m, mark=mark, check=check: mark if check is None or check(m[0]) else m[0], text)
                for pattern, replacement in more if text else ():
                    text = pattern.sub(replacement, text)
                out.append(text)
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return df.mapInArrow(work, df.schema)


def detect(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, kind, value, position) of each match in the original text, kind by kind; cards and IBANs that fail their checks are left out."""

    def work(batches):
        kinds = _compiled()
        for batch in batches:
            rows = [
                (k, kind, m[0], m.start())
                for k, text in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist(), strict=True)
                for kind, pattern, _, check in kinds
                for m in pattern.finditer(text or "")
                if check is None or check(m[0])
            ]
            if rows:
                keys, names, values, places = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(names), pa.array(values), pa.array(places, pa.int32())], [key, "kind", "value", "position"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(work, f"`{key}` {kind}, kind string, value string, position int")


def pattern_problem(pattern: str) -> str | None:
    """Why a user's pattern is refused, or None: too long, no regular expression, or a repeated group that itself repeats or branches."""
    if len(pattern) > 500:
        return "longer than 500 characters"
    try:
        re.compile(pattern)
    except re.error as error:
        return f"not a regular expression: {error}"
    # groups on a stack: does what is open so far hold a repetition or a branch?
    stack, i = [False], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            end = pattern.find("]", i + 2)
            i = len(pattern) if end < 0 else end + 1
            continue
        if c == "(":
            stack.append(False)
        elif c == ")" and len(stack) > 1:
            risky = stack.pop()
            if risky and pattern[i + 1 : i + 2] in ("+", "*", "{", "?") and pattern[i + 1 : i + 2] != "?":
                return "a repeated group that repeats or branches inside"
            stack[-1] |= risky
        elif c in "+*{|":
            stack[-1] = True
        i += 1
    return None
