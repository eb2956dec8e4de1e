"""Prompt registry (F22) and chat-message building.

All wording is ours.  Prompts are rendered by splitting the template at its
``{name}`` placeholders and concatenating literal pieces with columns, so a
value that itself contains ``{feedback}`` or ``%`` is never substituted again
(rule B25).
"""
from __future__ import annotations

import re
from typing import Dict

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of

PROMPTS: Dict[str, str] = {
    "section_chained": (
        "Label the sentence with the review section it belongs to: summary_of_strengths, "
        "summary_of_weaknesses or comments,_suggestions_and_typos. Reply with the label only.\n"
        "Section text: {review}\n{context}Sentence: {sentence}\nLabel: "),
    "bio_chained": (
        "Mark where argument units start. Reply B if the sentence starts a unit, I if it "
        "continues the previous one, O if it belongs to none. Reply with one letter.\n"
        "Section text: {review}\n{context}Sentence: {sentence}\nTag: "),
    "question_mining": (
        "Issue: {issue}\nWhy it can signal a weak review: {reason}\nExample segments: {segments}\n"
        "Write 10 yes/no questions that tell whether a segment shows this issue. Answer with a "
        "list of quoted strings in square brackets."),
    "yes_no_vote": (
        "Segment: {segment}\nQuestion: {question}\n"
        "Answer [[Yes]], [[No]], or [[Other]] when the question does not apply. Nothing else."),
    "plan": (
        "Segment: {segment}\nIssue: {issue}\nSummary: {summary}\nStrengths: {strengths}\n"
        "Context the template asks for: {context}\nTemplate: {template}\nSay which knowledge (summary, abstract, template) the feedback "
        "should use and why, as keys knowledge_source and justification."),
    "candidate": (
        "Write constructive feedback on this review segment.\nSegment: {segment}\n"
        "Template: {template}\nPlan: {plan}\nFeedback:"),
    "crossover": (
        "Merge these feedback drafts into one concise, constructive feedback that keeps the "
        "template's structure:\n{parents}\nFeedback:"),
    "one_pass": "Give the reviewer constructive feedback.\nSegment: {segment}\nIssue: {issue}\nFeedback:",
    "template_guided": (
        "Adapt the template to this segment so the reviewer can revise it.\nSegment: {segment}\n"
        "Issue: {issue}\nTemplate: {template}\nFeedback:"),
    "short_plan": "Plan briefly how to address the issue.\nSegment: {segment}\nIssue: {issue}\nPlan:",
    "from_plan": "Follow the plan and adapt the template.\nPlan: {plan}\nTemplate: {template}\nFeedback:",
    "refine_draft": (
        "Draft precise, actionable feedback.\nSegment: {segment}\nIssue: {issue}\n"
        "Template: {template}\nFeedback:"),
    "refine": "Make the feedback clearer and closer to the template.\nTemplate: {template}\nFeedback: {feedback}\nRefined:",
    "judge": (
        "Criterion: {dimension}. {question}\nScore 1: {s1}\nScore 2: {s2}\nScore 3: {s3}\nScore 4: {s4}\n"
        "Score 5: {s5}\nWrite your reasoning, then '[RESULT] <score>'.\nWeakness: {weakness}\nFeedback: {feedback}\n"),
}

# the judge's rubrics, per dimension: what is asked, then what each score stands for
RUBRICS: Dict[str, tuple] = {
    "Conciseness": ("How little does the feedback waste the reviewer's time?",
                    "rambling, most of it could go", "long, with much repetition", "some passages could be cut",
                    "short, a few spare words", "every sentence is needed"),
    "Relevance": ("Does the feedback speak about this very segment?",
                  "about something else", "touches the segment by chance", "on the topic, but generic",
                  "about the segment, with minor asides", "about the segment and its issue throughout"),
    "Constructiveness": ("Does the feedback tell the reviewer what to do?",
                         "only criticises", "hints at a change", "names a change, not how to make it",
                         "names changes that can be made", "gives clear steps in a friendly tone"),
    "Specificity": ("Does the feedback point at concrete places and facts?",
                    "could be said of any review", "mentions the topic only", "names one concrete point",
                    "names several concrete points", "quotes the segment and says exactly what is missing"),
}
JUDGE_SYSTEM = "You are a careful assistant who rates feedback on peer reviews by the criterion you are given, and by it alone."

_PH = re.compile(r"\{([a-z_0-9]+)\}")


def render(name_or_template: str, **cols) -> Column:
    """Fill ``{name}`` placeholders with columns (NULL -> '')."""
    tmpl = PROMPTS.get(name_or_template, name_or_template)
    parts, pos = [], 0
    for m in _PH.finditer(tmpl):
        if m.start() > pos:
            parts.append(F.lit(tmpl[pos:m.start()]))
        parts.append(F.coalesce(col_of(cols[m.group(1)]).cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(tmpl):
        parts.append(F.lit(tmpl[pos:]))
    return F.concat(*parts)


def fill(name: str, **values: str) -> str:
    """``render`` for one Python string (inside a model's task): the template is
    split once, so a placeholder inside a value is never filled (rule B25)."""
    return _PH.sub(lambda m: values[m.group(1)], PROMPTS[name])


def chat(prompt, system: str | None = None) -> Column:
    """``array<struct<role, content>>`` message list."""
    user = F.struct(F.lit("user").alias("role"), col_of(prompt).alias("content"))
    if system is None:
        return F.array(user)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), user)
