"""Items of generated study material, checked against their sources."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = re.compile(r"\[(\d{1,9})\]")
BULLET = re.compile(r"^[-*•]\s+")
NUMBERED = re.compile(r"^([-*•]|\d+[.)])\s+")
ASKED, ANSWERED = re.compile(r"^[DQ]\s*[:.]\s*", re.IGNORECASE), re.compile(r"^[RA]\s*[:.]\s*", re.IGNORECASE)


def items(kind: str, text: str) -> list[tuple[str | None, str]]:
    """(heading or question, text) of a generated text's items: briefing paragraphs, faq pairs, study_guide bullets, questions."""
    lines = [line.strip() for line in text.replace("\r\n", "\n").split("\n")]
    if kind == "briefing":
        return [(None, " ".join(p.split())) for p in re.split(r"\n\s*\n", text) if p.strip()]
    out: list[tuple[str | None, str]] = []
    above: str | None = None
    for line in lines:
        if kind == "faq":
            if ASKED.match(line):
                above = ASKED.sub("", line)
            elif ANSWERED.match(line) and above:
                out.append((above, ANSWERED.sub("", line)))
                above = None
        elif kind == "study_guide":
            if line.startswith("#"):
                above = line.lstrip("#").strip()
            elif BULLET.match(line):
                out.append((above or "", BULLET.sub("", line)))
        else:
            bare = MARK.sub("", line).strip()
            if NUMBERED.match(bare) and bare.endswith("?"):
                out.append((None, NUMBERED.sub("", bare)))
    return out


def checked(found: list[tuple[str | None, str]], n: int) -> list[dict]:
    """Items that cite something, and nothing but sources 1 to n, with their markers taken out."""
    out = []
    for above, text in found:
        cited = sorted({int(m) for m in MARK.findall(text)})
        bare = MARK.sub("", text).strip()
        if cited and 1 <= cited[0] and cited[-1] <= n and bare:
            out.append({"heading": above and MARK.sub("", above).strip(), "text": bare, "citations": cited})
    return out


def parse(answers: DataFrame) -> DataFrame:
    """``answers`` (id, kind, answer, n) with their valid items and how many were dropped; questions carry no markers and all stay."""
    kind = pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string()), ("citations", pa.list_(pa.int32()))]))

    def work(batches):
        for batch in batches:
            kept, dropped = [], []
            for r in batch.to_pylist():
                found = items(r["kind"], r["answer"] or "")
                good = [{"heading": h, "text": t, "citations": []} for h, t in found] if r["kind"] == "questions" else checked(found, r["n"])
                kept.append(good)
                dropped.append(len(found) - len(good))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, kind), pa.array(dropped, pa.int32())], ["id", "items", "dropped"])

    return answers.select("id", "kind", "answer", "n").mapInArrow(work, f"id {answers.schema['id'].dataType.simpleString()}, items array<struct<heading:string,text:string,citations:array<int>>>, dropped int")
