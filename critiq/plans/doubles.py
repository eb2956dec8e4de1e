"""Deterministic stand-ins for a user's model, for the registered ``*_model``
queries and the tests only: they read the values back out of the rendered
prompts and answer by a fixed rule, so that a query's result can be checked.
Every function is a backend constructor (see ``operators.backend``)."""
from __future__ import annotations

import json
import re

from .. import fixed
from ..operators import feedback as fb
from ..operators.judge import SUGGESTIONS


def vote():
    """Answers vote prompts by the native rules."""
    form = re.compile(r"^Segment: (.*)\nQuestion: (.*)\nAnswer ", re.S)

    def one(p):
        seg, question = form.match(p).groups()
        kw = re.search(r"'([^']*)'", question)
        if (kw.group(1).lower() if kw else "") in seg.lower():
            return "[[Yes]]"
        if "!" in seg:
            return "I cannot tell"
        if len(seg) < 300:
            return "[[Other]]"
        return "NO" if len(seg) % 2 == 0 else "[[No]]"
    return lambda prompts: [one(p) for p in prompts]


def vote_plain():
    """Another voter: yes if the keyword stands in the segment as it is written, else no."""
    form = re.compile(r"^Segment: (.*)\nQuestion: (.*)\nAnswer ", re.S)

    def one(p):
        seg, question = form.match(p).groups()
        kw = re.search(r"'([^']*)'", question)
        return "Yes." if kw and kw.group(1) in seg else "[[No]]"
    return lambda prompts: [one(p) for p in prompts]


def _between(p: str, start: str, end: str) -> str:
    return p.split(start, 1)[1].rsplit(end, 1)[0]


def feedback():
    """Answers every generation prompt; ``seeds`` vary the wording as the native
    template backend does."""
    openings, closings, hole = list(fb.OPENINGS), list(fb.CLOSINGS), fixed.TEMPLATE_PLACEHOLDER

    def wording(text, c):
        return openings[(c // len(closings)) % len(openings)] + text + closings[c % len(closings)]

    def one(p, c):
        if p.startswith("Adapt the template"):                 # template_guided
            seg, template = _between(p, "\nSegment: ", "\nIssue: "), _between(p, "\nTemplate: ", "\nFeedback:")
            return wording(template.replace(hole, seg), c)
        if p.startswith("Give the reviewer"):                  # one_pass
            seg, issue = _between(p, "\nSegment: ", "\nIssue: "), _between(p, "\nIssue: ", "\nFeedback:")
            return f"Regarding '{issue}': please support the point \"{seg}\" with evidence."
        if p.startswith("Plan briefly"):                       # short_plan
            return f"Address '{_between(p, chr(10) + 'Issue: ', chr(10) + 'Plan:')}'."
        if p.startswith("Follow the plan"):                    # from_plan
            plan, template = _between(p, "\nPlan: ", "\nTemplate: "), _between(p, "\nTemplate: ", "\nFeedback:")
            return f"{plan} {template}"
        if p.startswith("Draft precise"):                      # refine_draft
            return wording(_between(p, "\nTemplate: ", "\nFeedback:"), c)
        if p.startswith("Make the feedback clearer"):          # refine
            text = _between(p, "\nFeedback: ", "\nRefined:")
            return text + fb.REFINEMENTS[len(text) % len(fb.REFINEMENTS)]
        if p.startswith("Write constructive"):                 # candidate
            plan, template = _between(p, "\nPlan: ", "\nFeedback:"), p.split("\nTemplate: ")[-1].split("\nPlan: ")[0]
            return wording(f"{template} ({plan})", c)
        if p.startswith("Merge these"):                        # crossover
            parents = re.split(r"(?:^|\n)Parent \d+: ", _between(p, "structure:\n", "\nFeedback:"))[1:]
            return f"{parents[0]} (of {len(parents)})"
        issue = _between(p, "\nIssue: ", "\nSummary: ")        # plan
        return f"knowledge_source: template; justification: '{issue}'"

    def answer(prompts, seeds=None):
        return [one(p, c) for p, c in zip(prompts, seeds or [0] * len(prompts))]
    return answer


def questions():
    """Answers mining prompts with ten questions: about the label, and about the most frequent words
    of the segments (as the native rules backend does)."""
    from collections import Counter

    def one(p):
        issue = p.split("Issue: ", 1)[1].split("\nWhy it can", 1)[0]
        text = _between(p, "\nExample segments: ", "\nWrite 10 yes/no")
        count = Counter(w for w in (t.replace("'", "") for t in text.lower().split()) if w)
        words = sorted(count, key=lambda w: (-count[w], w.encode()))[:9]
        asked = [f"Does the segment justify '{issue}'?", *(f"Does the segment use the word '{w}'?" for w in words)]
        return "Questions: [" + ", ".join(f'"{x}"' for x in asked) + "]"
    return lambda prompts: [one(p) for p in prompts]


def judge():
    """Rates by the native rules judge, reading the messages' JSON."""
    def one(p):
        message = json.loads(p)[-1]["content"]
        dim = _between(message, "Criterion: ", "\nScore 1").split(". ", 1)[0]
        seg, text = message.split("\nWeakness: ", 1)[1][:-1].rsplit("\nFeedback: ", 1)
        marks, words = sum(c in ".!?" for c in text), set(text.split())
        score = {
            "Conciseness": next((s for s, n in ((5, 2), (4, 3), (3, 5), (2, 8)) if marks <= n), 1),
            "Relevance": 1 + int(4 * len(words & set(seg.split())) / max(len(words), 1)),
            "Constructiveness": 1 + min(4, sum(w in text.lower() for w in SUGGESTIONS)),
            "Specificity": 1 + ('"' in text) + bool(re.search("[0-9]", text)) + (len(words) >= 30) + (seg[:20] in text),
        }[dim]
        reason = f"The feedback has {len(text.split(' '))} words."
        k = (marks + fixed.JUDGE_DIMENSIONS.index(dim)) % 4
        return [f"Feedback: {reason} [RESULT] {score}", f"Notes.\n### {reason}\n[RESULT] {score}",
                f"{reason} [RESULT] 3 [RESULT] {score}", reason][k]
    return lambda prompts: [one(p) for p in prompts]
