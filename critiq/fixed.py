"""Fixed values.

Everything in this module must equal the values the original review-quality
tool uses, because labels, keys and literal sets are matched as data.  They
are stated plainly and in their natural order.  Prose (reasons, templates,
prompts) is our own wording and lives in ``critiq.sources.dimensions`` and
``critiq.functions.prompts``.
"""

# --- fixed values: section names accepted by the section validator --------
SECTION_NAMES = [
    "summary_of_strengthes",
    "summary_of_weaknesses",
    "comments,_suggestions_and_typos",
]
SECTION_DEFAULT = "summary_of_weaknesses"
# spelling used by the annotated data for the strengths section
SECTION_STRENGTHS_DATA = "summary_of_strengths"
# spelling the prompts offer for the comments section (no comma)
SECTION_COMMENTS_PROMPT = "comments_suggestions_and_typos"

# --- fixed values: BIO tags ---------------------------------------------------
BIO_TAGS = ["B", "I", "O"]
BIO_DEFAULT = "O"

# --- fixed values: issue labels that contain commas (cut out before split) ----
PROTECTED_PHRASES = [
    "H10. The approach is tested only on [not English], so unclear if it will generalize to other languages",
    "The paper doesn't use [my preferred methodology], e.g., deep learning",
]
OTHER_LABEL = "Other"

# --- fixed values: the 24 issue labels of the rationale table, in order -------
ISSUE_LABELS = [
    "The results are not surprising",
    "The results contradict what I would expect",
    "The results are not novel",
    "This has no precedent in the existing literature",
    "The results do not surpass the latest SOTA",
    "The results are negative",
    "This method is too simple",
    "The paper doesn't use [my preferred methodology], e.g., deep learning",
    "The topic is too niche",
    "The approach is tested only on [not English], so unclear if it will generalize to other languages",
    "The paper has language errors",
    "The paper is missing the [reference X]",
    "The authors could also do [extra experiment X]",
    "The authors should compare to a 'closed' model X",
    "The authors should have done [X] instead",
    "Limitations != weaknesses",
    "Not enough Info",
    "X is not clear",
    "The formulation of X is wrong",
    "The contribution is not novel",
    "The paper is missing recent baselines",
    "X was done in the way Y",
    "The algorithm's interaction with dataset is problematic",
    "The paper is missing relevant references",
]

# --- fixed values: the 22 template keys and their knowledge source, in order --
TEMPLATE_KEYS = [
    ("H1. The results are not surprising", "Paper summary"),
    ("H2. The results contradict what I would expect", "Paper summary"),
    ("H3. The results are not novel", "Paper summary + Abstract"),
    ("H4. This has no precedent in the existing literature", "Paper summary"),
    ("H5. The results do not surpass the latest SOTA", "Template"),
    ("H6. The results are negative", "Template"),
    ("H7. This method is too simple", "Abstract"),
    ("H8. The paper doesn't use [my preferred methodology], e.g., deep learning", "Abstract"),
    ("H9. The topic is too niche", "Abstract"),
    ("H10. The approach is tested only on [not English], so unclear if it will generalize to other languages", "Template"),
    ("H11. The paper has language errors", "Template"),
    ("H12. The paper is missing the [reference X]", "Template"),
    ("H13. The authors could also do [extra experiment X]", "Abstract"),
    ("H14. \U0001F195 The authors should compare to a 'closed' model X", "Template"),
    ("H15. The authors should have done [X] instead", "Abstract"),
    ("H16. Limitations != weaknesses", "Template"),
    ("The paper is missing relevant references", "Template"),
    ("X is not clear", "Template"),
    ("The formulation of X is wrong", "Template"),
    ("The contribution is not novel", "Template"),
    ("The paper is missing recent baselines", "Template"),
    ("X was done in the way Y", "Template"),
]
TEMPLATE_PLACEHOLDER = "[insert reviewer comment here]"

# --- fixed values: fitness ----------------------------------------------------
FORBIDDEN_TERMS = ["hi", "hello", "thanks", "good job", "nice work", "great paper"]
MAX_SENTENCES = 5
# published Flesch reading-ease formula
FLESCH_BASE, FLESCH_WPS, FLESCH_SPW = 206.835, 1.015, 84.6

# --- fixed values: judge ------------------------------------------------------
JUDGE_DIMENSIONS = ["Conciseness", "Relevance", "Constructiveness", "Specificity"]
JUDGE_SECTION_MARK = "###"
JUDGE_RESULT_MARK = "[RESULT]"
SCORE_MIN, SCORE_MAX = 1, 5

# --- fixed values: baseline strategy names -------------------------------------
BASELINES = ["1-pass", "Temp", "Plan", "BoN", "Self-Ref."]

# --- fixed values: defaults of the search shapes -------------------------------
N_CANDIDATES, N_GENERATIONS, N_PARENTS, TAU = 10, 3, 5, 1.0
BON_N, BON_GEN = 5, 3
HOLDOUT_SIZE, HOLDOUT_TRIALS, CV_FOLDS, CV_TRIALS, SEED = 0.1, 1000, 5, 100, 42
TOP_SEGMENTS_PER_ISSUE = 5
MIN_SUPPORT = 5            # keep issues with more than this many segments
SHORT_SEGMENT_CHARS = 10   # stripped segments shorter than this get no labels

# names of the compared classifiers, in the original's order
CLASSIFIER_NAMES = [
    "KNN", "Logistic Regression (L2)", "Logistic Regression (L1)", "Random Forest", "Decision Tree", "SVM (RBF)",
    "SVM (Linear)", "SVM (Poly)", "Gradient Boosting", "AdaBoost", "Extra Trees", "Multi-layer Perceptron (MLP)",
    "Gaussian Naive Bayes", "Stochastic Gradient Descent (SGD)",
]
