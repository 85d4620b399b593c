"""Chat formatting: a grammar round trip.

Template, one line group per turn:  `### Name: ` body ` </turn>` newline. In a body and in a name a backslash
makes the next character literal; an unescaped ` </turn>` with its newline ends the turn. The three usual
roles have names of their own; any other role stands after an `@`.

Every turn is first rendered as it is and reparsed by the deterministic parser, which takes no unescaped `### ` or
`</turn>` in a body; where it finds one, or the recovered turn differs from the source, the turn's control strings are
escaped, and it is parsed again. The whole
conversation is then parsed once more and must give back all turns.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import table

NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
ROLES = {v: k for k, v in NAMES.items()}
END = " </turn>\n"
#: Conversations that one Arrow batch of the formatting step holds at most.
BATCH = 500


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("### ", "\\### ").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def head(role: str) -> str:
    if role in NAMES:
        return f"### {NAMES[role]}: "
    return "### @" + role.replace("\\", "\\\\").replace(":", "\\:") + ": "


_HEAD = re.compile(r"### (?:(User|Assistant|System)|@((?:[^\\:]|\\.)*)): ", re.S)
_STOP = re.compile(r"\\.|" + re.escape(END) + "|### |</turn>", re.S)


def parse(formatted: str) -> list[tuple[str, int, int]] | None:
    """(role, start, end) of each turn's body, or None if the text isn't of the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        m = _HEAD.match(formatted, at)
        if not m:
            return None
        role = ROLES[m[1]] if m[1] else unescape(m[2])
        start = at = m.end()
        while True:
            stop = _STOP.search(formatted, at)
            if not stop or stop[0] in ("### ", "</turn>"):
                return None
            at = stop.end()
            if stop[0] == END:
                turns.append((role, start, stop.start()))
                break
    return turns


def recovered(formatted: str) -> list[tuple[str, str]] | None:
    found = parse(formatted)
    return None if found is None else [(r, unescape(formatted[a:b])) for r, a, b in found]


def render(turns: list[tuple[str, str]]) -> str:
    """Formatted conversation whose parse gives back exactly these turns."""
    out = []
    for role, text in turns:
        for body in (text, escape(text)):
            one = head(role) + body + END
            if recovered(one) == [(role, text)]:
                break
        out.append(one)
    formatted = "".join(out)
    if recovered(formatted) != list(turns):
        raise ValueError("a conversation doesn't survive its round trip")
    return formatted


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss_spans (array of start, end of assistant bodies).

    Turns stand by turn number, then role, then text, nulls first; null roles and texts are empty strings. A null conv_id is a
    conversation of its own. Repeated rows are repeated turns. A conversation becomes one string, so it must
    fit in a task.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = F.struct("turn", blank("role").alias("role"), blank("text").alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turns)).alias("turns"))
    grouped = grouped.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                texts = [render(list(zip(r, t, strict=True))) for r, t in zip(part["roles"].to_pylist(), part["texts"].to_pylist(), strict=True)]
                spans = [[{"start": a, "end": b} for role, a, b in parse(x) if role == "assistant"] for x in texts]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part["conv_id"], pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "loss_spans"])

    return grouped.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            rows = []
            for text, spans in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
                turns = recovered(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation made of the template's own control strings.
HARD = r"\### Assistant: </turn> ok"


def op4_chat(spark, sf_dir: str) -> DataFrame:
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_conversations(given.unionByName(hard)))


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, CASE WHEN contains(text, '\') OR contains(text, '### ') OR contains(text, '</turn>')
      THEN replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') ELSE text END AS body,
    CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role)
      ELSE 1 + length(replace(replace(role, '\', '\\'), ':', '\:')) END AS name_chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + name_chars + 4 + 2 + 9) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
