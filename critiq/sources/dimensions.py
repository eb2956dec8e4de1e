"""Dimension tables: rationale, templates, judge dimensions, questions.

Keys come from ``critiq.fixed``; all prose here is our own wording.  Every
table is bounded by construction (tens of rows), which is what makes the
``broadcast`` hints on them safe.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed

GENERIC_REASON = ("Raising this point without evidence or an explanation of why it "
                  "matters can be a sign of a superficial review.")

# our own short reasons; the eight labels without one fall back to GENERIC_REASON
_REASONS = {
    "The results are not surprising": "An outcome that seems obvious afterwards may still never have been shown, and a confirmed intuition is useful evidence.",
    "The results contradict what I would expect": "Expectations are not evidence; findings that disagree with them deserve to be judged on the data.",
    "The results are not novel": "A novelty objection needs a concrete prior publication; reproductions and analyses are legitimate contributions.",
    "This has no precedent in the existing literature": "Lack of precedent is what new work looks like and is not a flaw in itself.",
    "The results do not surpass the latest SOTA": "Beating the best score is neither required nor enough; efficiency, robustness or insight also count.",
    "The results are negative": "Knowing what does not work saves others effort and counters publication bias.",
    "This method is too simple": "Simple methods that solve the problem are easier to reuse and are usually preferable.",
    "The paper doesn't use [my preferred methodology], e.g., deep learning": "The field welcomes many kinds of methods and contributions, not only one family of models.",
    "The topic is too niche": "A focused contribution to a narrow area can still be significant.",
    "The approach is tested only on [not English], so unclear if it will generalize to other languages": "Work on a single language is valuable, exactly as work only on English is.",
    "The paper has language errors": "Clear science matters more than polished prose as long as the text is understandable.",
    "The paper is missing the [reference X]": "Missing references weigh only if the work was published well before the submission.",
    "The authors could also do [extra experiment X]": "More experiments are always possible; what matters is whether the claims are supported.",
    "The authors should compare to a 'closed' model X": "Comparisons with closed models are only needed when they bear on the claim being made.",
    "The authors should have done [X] instead": "Several valid designs exist; another choice is a suggestion unless it blocks the research question.",
    "Limitations != weaknesses": "Acknowledged limitations are expected and should not simply be restated as weaknesses.",
}


def rationale_rows():
    return [(lab, _REASONS.get(lab, "")) for lab in fixed.ISSUE_LABELS]


def _template_text(label: str) -> str:
    return ("Your remark \"" + fixed.TEMPLATE_PLACEHOLDER + "\" points to the issue '" + label +
            "'. Please support it with specific evidence, explain why it matters for the "
            "paper's claims, and suggest what the authors could change.")


def template_rows():
    """(template_key, knowledge, template) for the 22 template keys."""
    return [(k, kn, _template_text(k)) for k, kn in fixed.TEMPLATE_KEYS]


def rationale_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rationale_rows(), "issue string, reason string")


def templates_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "template_key string, knowledge string, template string")


def judge_dimensions_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fixed.JUDGE_DIMENSIONS)), "dim_idx int, dimension string")


FLAGSHIP_TEMPLATE = _template_text("X is not clear")


def sql_values(rows, names) -> str:
    """Inline VALUES for the DuckDB oracle."""
    def q(v):
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(names)})"
