"""Prompts: templates as data, filled by concatenation of their segments.

A template is cut at its two placeholders once; filling concatenates the segments with context and query, so braces or placeholder
names inside them stay as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    name: str
    version: str
    description: str
    system: str | None
    user: str

    def fill(self, context: Column, query: Column) -> Column:
        """The user message; context and query are stripped."""
        from ..functions.text import strip

        by = {"{context}": strip(context), "{query}": strip(query)}
        parts = [by.get(p, F.lit(p)) for p in re.split(r"(\{context\}|\{query\})", self.user) if p]
        return F.concat(*parts)

    def messages(self, context: Column, query: Column) -> Column:
        """array of (role, content): the system message, if there is one, then the user message."""
        made = [(("system"), F.lit(self.system))] if self.system else []
        made.append(("user", self.fill(context, query)))
        return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in made))


TEMPLATES = {
    t.name: t
    for t in (
        Template("T1_Baseline", "1.0", "Context and question, nothing else.", None, "Context:\n{context}\n\nQuestion: {query}\n\nAnswer:"),
        Template("T2_Structured", "1.0", "A role and labelled sections.", "You answer questions briefly and exactly from the documents you are given.", "## Documents\n{context}\n\n## Question\n{query}\n\n## Answer"),
        Template("T3_Hallucination_Guard", "1.0", "Only what the context says, or a fixed refusal.", "Use the CONTEXT alone. If it does not hold the answer, reply: INSUFFICIENT CONTEXT. Name the source of each fact. Do not guess.", "CONTEXT:\n---\n{context}\n---\n\nQUESTION: {query}\n\nGROUNDED ANSWER:"),
        Template("T4_Chain_of_Thought", "1.0", "Steps before the answer.", "Find the passages that matter, reason over them step by step, say what is missing, then answer.", "## Context\n{context}\n\n## Question\n{query}\n\n## Steps\n\n## Final answer"),
    )
}


def register(template: Template) -> None:
    TEMPLATES[template.name] = template


def build_prompts(df: DataFrame, names: list[str] | None = None, context: str = "context", query: str = "query") -> DataFrame:
    """One row per row of df and template: template, messages, prompt (all contents joined by a blank line)."""
    names = names or list(TEMPLATES)
    each = F.array(*(F.struct(F.lit(n).alias("template"), TEMPLATES[n].messages(F.col(context), F.col(query)).alias("messages")) for n in names))
    out = df.select("*", F.explode(each).alias("_t")).select(*df.columns, "_t.template", "_t.messages")
    return out.withColumn("prompt", F.array_join(F.transform("messages", lambda m: m["content"]), "\n\n"))


def rewrite_refusal(response: Column, message: str = "The documents do not hold an answer to this question.") -> Column:
    """A response that holds the refusal mark becomes a fixed message."""
    return F.when(F.contains(F.upper(response), F.lit("INSUFFICIENT")), F.lit(message)).otherwise(response)
