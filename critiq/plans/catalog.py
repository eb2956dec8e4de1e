"""Registered queries.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables; the
matching DuckDB SQL (when the operator is SQL-expressible) is registered next
to it.  Computed columns carry the same names on both sides; doubles are
rounded to 6 places on both sides.
"""
from __future__ import annotations

from typing import Callable, Dict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed as _fx
from ..functions.prompts import PROMPTS, chat, render
from ..functions.scoring import fitness, round6
from ..functions.text import clean_gold, multi_hot
from ..operators import feedback as fb
from ..operators import generate as gen
from ..operators import issues as iss
from ..operators import judge as jd
from ..operators import metrics as met
from ..operators import models as mdl
from ..operators import onepass
from ..operators import neighbors as nbr
from ..operators import split as spl
from ..operators import tagging
from ..operators.backend import BackendFactory
from ..operators.store import CompletionStore
from ..sources import dimensions as dims
from ..sources import io as sio
from ..session import checkpointed, shared_path
from . import bindings, doubles
from . import sqlgen as q
from .tables import fine, spread, table

QUERIES: Dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: Dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Segmentation on documents
# ---------------------------------------------------------------------------

_DOC_TAGS_SQL = f"""
WITH f AS (
  SELECT doc_id, list_transform({q.sentences('text')}, lambda s: {q.sentence_features('s')}) AS f
  FROM documents
), t AS (
  SELECT doc_id, f, {q.fold('f', q.rules_bio)} AS t FROM f
), x AS (
  SELECT doc_id, unnest(range(len(f))) AS pos, unnest(f) AS fi, unnest(t) AS ti FROM t
)
SELECT doc_id, pos, fi.text AS sentence, ti.tag AS tag, ti.seg AS seg_id FROM x
"""


@register("sentence_tags", sql=f"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, tag, CAST(seg_id AS BIGINT) AS seg_id,
       CAST(len({q.tokens('sentence')}) AS BIGINT) AS n_words
FROM ({_DOC_TAGS_SQL}) s
""")
def sentence_tags(spark, sf_dir):
    """Chained BIO tags (rules backend) for every sentence of every document."""
    t = tagging.tag_document_sentences(_texts(spark, sf_dir))
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "tag",
                    F.col("seg_id").cast("bigint").alias("seg_id"),
                    F.size(tagging.tokens("sentence")).cast("bigint").alias("n_words"))


_SEGMENTS_SQL = f"""
SELECT doc_id, seg_id, CAST(count(*) AS BIGINT) AS n_sentences, CAST(min(pos) AS BIGINT) AS first_pos,
       string_agg(sentence, ' ' ORDER BY pos) AS segment
FROM ({_DOC_TAGS_SQL}) s WHERE tag <> 'O' GROUP BY doc_id, seg_id
"""

_TEMPLATE = q.lit(dims.FLAGSHIP_TEMPLATE)


@register("doc_segments", sql=f"""
SELECT doc_id, CAST(seg_id AS BIGINT) AS seg_id, n_sentences, first_pos, md5(segment) AS segment_md5,
       round({q.fitness('segment', _TEMPLATE, 1)}, 6) AS fitness
FROM ({_SEGMENTS_SQL}) g
""")
def doc_segments(spark, sf_dir):
    """W2 + F18: segments assembled from the chained tags, scored as feedback."""
    segs = _segments(spark, sf_dir)
    return segs.select("doc_id", F.col("seg_id").cast("bigint").alias("seg_id"),
                       F.col("n_sentences").cast("bigint").alias("n_sentences"),
                       F.col("first_pos").cast("bigint").alias("first_pos"),
                       F.md5("segment").alias("segment_md5"),
                       round6(fitness("segment", F.lit(dims.FLAGSHIP_TEMPLATE), 1)).alias("fitness"))


def _segments(spark, sf_dir):
    return tagging.segments_from_tags(tagging.tag_document_sentences(_texts(spark, sf_dir)), "doc_id")


def _texts(spark, sf_dir):
    """(doc_id, text), dealt out finely: tagging and voting work on a text for milliseconds."""
    return fine(table(spark, sf_dir, "documents", heavy=False).select("doc_id", "text"))


@register("best_segment", sql=f"""
SELECT doc_id, seg_id, n_sentences, segment, fitness FROM (
  SELECT doc_id, CAST(seg_id AS BIGINT) AS seg_id, n_sentences, segment,
         round(fit, 6) AS fitness,
         row_number() OVER (PARTITION BY doc_id ORDER BY round(fit, 9) DESC, seg_id ASC) AS rn
  FROM (SELECT *, {q.fitness('segment', _TEMPLATE, 1)} AS fit FROM ({_SEGMENTS_SQL}) g) s
) r WHERE rn = 1
""")
def best_segment(spark, sf_dir):
    """Flagship: documents -> sentences -> chained BIO tagger -> segments ->
    fitness -> best segment per document (first wins on ties)."""
    segs = _segments(spark, sf_dir).withColumn(
        "fit", fitness("segment", F.lit(dims.FLAGSHIP_TEMPLATE), 1))
    best = segs.groupBy("doc_id").agg(F.max_by(
        F.struct("seg_id", "n_sentences", "segment", "fit"),
        F.struct(F.round("fit", 9), -F.col("seg_id"))).alias("b"))
    return best.select("doc_id", F.col("b.seg_id").cast("bigint").alias("seg_id"),
                       F.col("b.n_sentences").cast("bigint").alias("n_sentences"),
                       F.col("b.segment").alias("segment"), round6("b.fit").alias("fitness"))


# ---------------------------------------------------------------------------
# Issue labels, groups, rationale/templates, questions, votes
# ---------------------------------------------------------------------------

_LABELED_SQL = (f"WITH src AS (SELECT doc_id, text, source, {bindings.issue_string_sql()} AS issue_types "
                f"FROM documents), " + q.parse_labels_ctes("src", "doc_id", "issue_types", "text").strip())


def _labeled(spark, sf_dir, deal=spread):
    docs = deal(table(spark, sf_dir, "documents", heavy=False)).select("doc_id", "text", "lang", "source", "n_chars")
    d = docs.withColumn("issue_types", bindings.issue_string())
    return iss.label_rows(d, "doc_id", "issue_types", "text")


@register("issue_labels", sql=f"""{_LABELED_SQL}
SELECT doc_id, CAST(unnest(range(len(issues))) AS BIGINT) AS label_idx, unnest(issues) AS issue FROM labeled
""")
def issue_labels(spark, sf_dir):
    """Parsed, ordered, de-duplicated labels."""
    return iss.explode_labels(_labeled(spark, sf_dir), "doc_id").select(
        "doc_id", F.col("label_idx").cast("bigint").alias("label_idx"), "issue")


_GROUPS_SQL = f"""{_LABELED_SQL},
lab AS (SELECT doc_id, unnest(issues) AS issue FROM labeled),
groups AS (SELECT issue, CAST(count(*) AS BIGINT) AS n_segments, min(doc_id) AS first_doc FROM lab
           WHERE issue <> '' GROUP BY issue)"""


@register("issue_groups", sql=f"""{_GROUPS_SQL}
SELECT issue, n_segments, first_doc, n_segments > 5 AS supported FROM groups
""")
def issue_groups(spark, sf_dir):
    """A1 + A3: segments per issue and the support filter flag."""
    g = iss.group_by_issue(_labeled(spark, sf_dir), "doc_id")
    return g.select("issue", F.col("n_segments").cast("bigint").alias("n_segments"),
                    F.col("first_key").alias("first_doc"),
                    (F.col("n_segments") > 5).alias("supported"))


_TOP_SQL = f"""{_GROUPS_SQL},
top AS (SELECT issue, doc_id, CAST(row_number() OVER (PARTITION BY issue ORDER BY doc_id) AS BIGINT) AS rank
        FROM lab WHERE issue <> '' QUALIFY rank <= 5)"""


@register("issue_top_segments", sql=f"""{_TOP_SQL}
SELECT issue, rank, doc_id FROM top
""")
def issue_top_segments(spark, sf_dir):
    """A2: first five segments of every issue."""
    t = iss.top_segments(_labeled(spark, sf_dir), "doc_id")
    return t.select("issue", F.col("rank").cast("bigint").alias("rank"), "doc_id")


_RAT_SQL = dims.sql_values(dims.rationale_rows(), ["issue", "reason"])
_TPL_SQL = dims.sql_values(dims.template_rows(), ["template_key", "knowledge", "template"])


@register("issue_catalog", sql=f"""{_GROUPS_SQL},
rat AS (SELECT * FROM {_RAT_SQL}),
tpl AS (SELECT regexp_replace({q.normalize_label('template_key')}, '^\\W+', '') AS issue, template_key, knowledge, template
        FROM {_TPL_SQL})
SELECT g.issue, g.n_segments, coalesce(nullif(r.reason, ''), {q.lit(dims.GENERIC_REASON)}) AS reason,
       (r.reason IS NULL OR r.reason = '') AS generic_reason, t.template_key, t.knowledge,
       md5(t.template) AS template_md5
FROM groups g LEFT JOIN rat r ON g.issue = r.issue LEFT JOIN tpl t ON g.issue = t.issue
""")
def issue_catalog(spark, sf_dir):
    """J2 + J3: every issue with its reason (generic when empty) and template."""
    return _issue_catalog(spark, sf_dir, dims.templates_df(spark))


@register("issue_catalog_file", sql=ORACLE["issue_catalog"])
def issue_catalog_file(spark, sf_dir):
    """S2 + J3: the same, with the templates read from their JSON file."""
    path = shared_path(spark, "templates-json")
    whole = dims.templates_df(spark).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        "template_key", F.struct(F.col("knowledge").alias("Knowledge"), F.col("template").alias("Template")))))).alias("value"))
    whole.coalesce(1).write.text(path)             # a dimension table of 22 rows
    return _issue_catalog(spark, sf_dir, sio.read_templates(spark, path))


def _issue_catalog(spark, sf_dir, templates):
    g = iss.group_by_issue(_labeled(spark, sf_dir), "doc_id")
    r = dims.rationale_df(spark)
    j = (g.join(F.broadcast(r), "issue", "left")
         .withColumn("generic_reason", F.col("reason").isNull() | (F.col("reason") == "")))
    j = j.withColumn("reason", F.coalesce(F.nullif("reason", F.lit("")), F.lit(dims.GENERIC_REASON)))
    j = iss.attach_templates(j, templates)
    return j.select("issue", F.col("n_segments").cast("bigint").alias("n_segments"), "reason",
                    "generic_reason", "template_key", "knowledge", F.md5("template").alias("template_md5"))


# question mining (M5) with the rules backend -------------------------------------------------

_QSETS_SQL = f"""{_TOP_SQL},
sup AS (SELECT issue, first_doc FROM groups WHERE n_segments > 5),
kww AS (SELECT t.issue, replace(unnest({q.tokens('lower(d.text)')}), '''', '') AS w
        FROM top t JOIN documents d ON d.doc_id = t.doc_id JOIN sup s ON s.issue = t.issue),
kwr AS (SELECT issue, w, row_number() OVER (PARTITION BY issue ORDER BY count(*) DESC, w) AS r
        FROM kww WHERE w <> '' GROUP BY issue, w),
kw AS (SELECT issue, list(w ORDER BY r) AS kws FROM kwr WHERE r <= {iss.N_QUESTIONS - 1} GROUP BY issue),
comp AS (SELECT issue, 'Questions: [' || array_to_string(list_transform(
            list_concat(['Does the segment justify ''' || issue || '''?'],
                        list_transform(kws, lambda w: 'Does the segment use the word ''' || w || '''?')),
            lambda x: '"' || x || '"'), ', ') || ']' AS completion FROM kw),
qparsed AS (SELECT c.issue, regexp_extract_all(regexp_extract(completion, '(?s)\\[(.*?)\\]', 1), '"(.*?)"', 1) AS qs,
                   CAST(dense_rank() OVER (ORDER BY s.first_doc, c.issue) - 1 AS INTEGER) AS issue_idx
            FROM comp c JOIN sup s ON s.issue = c.issue WHERE regexp_matches(completion, '(?s)\\[.*?\\]')),
questions AS (SELECT issue, issue_idx, CAST(unnest(range(len(qs))) AS INTEGER) AS q_idx, unnest(qs) AS question
              FROM qparsed)"""


def _question_table(spark, sf_dir, **how):
    """(issue, issue_idx, q_idx, question, keyword); an issue whose list
    parsed to no question keeps its slot with NULL q_idx/question."""
    groups, top = _mined_segments(spark, sf_dir, **how)
    comp = iss.frequent_words(top).select(
        "issue", iss.rules_question_completion("issue", "keywords").alias("completion"))
    return iss.question_table(comp, groups.select("issue", F.col("first_key").alias("order_key")))


def _mined_segments(spark, sf_dir, deal=spread, groups=None):
    """Supported issues (``groups``, where they are known), and (issue, rank, doc_id, text) of their first five segments."""
    lab = _labeled(spark, sf_dir, deal)
    groups = iss.supported(iss.group_by_issue(lab, "doc_id")) if groups is None else groups
    top = iss.top_segments(lab, "doc_id", carry=["text"]).join(groups.select("issue"), "issue", "left_semi")
    return groups, top


@register("question_sets", sql=f"""{_QSETS_SQL}
SELECT issue, issue_idx, q_idx, question FROM questions
""")
def question_sets(spark, sf_dir):
    """M5 (rules backend) + F9: questions per supported issue."""
    return (_question_table(spark, sf_dir).filter(F.col("question").isNotNull())
            .select("issue", "issue_idx", "q_idx", "question"))


def _vote_code_sql(text: str, kw: str) -> str:
    comp = (f"(CASE WHEN contains(lower({text}), {kw}) THEN '[[Yes]]' WHEN contains({text}, '!') THEN 'I cannot tell' "
            f"WHEN length({text}) < 300 THEN '[[Other]]' WHEN length({text}) % 2 = 0 THEN 'NO' ELSE '[[No]]' END)")
    return (f"(CASE WHEN contains(lower({comp}), 'yes') THEN 1 WHEN contains(lower({comp}), 'no') THEN -1 ELSE 0 END)")


_VOTES_SQL = f"""{_QSETS_SQL},
qk AS (SELECT issue_idx, q_idx, lower(regexp_extract(question, '''([^'']*)''', 1)) AS keyword FROM questions),
slots AS (SELECT issue_idx FROM qparsed),
v AS (SELECT d.doc_id, qk.issue_idx, qk.q_idx, {_vote_code_sql('d.text', 'qk.keyword')} AS vote
      FROM documents d CROSS JOIN qk),
di AS (SELECT d.doc_id, s.issue_idx FROM documents d CROSS JOIN slots s),
per_issue AS (SELECT di.doc_id, di.issue_idx,
                     coalesce(list(v.vote ORDER BY v.q_idx) FILTER (WHERE v.vote IS NOT NULL), []::INTEGER[]) AS inner_v
              FROM di LEFT JOIN v ON v.doc_id = di.doc_id AND v.issue_idx = di.issue_idx
              GROUP BY di.doc_id, di.issue_idx),
per_doc AS (SELECT doc_id, max(len(inner_v)) AS w, list(inner_v ORDER BY issue_idx) AS nested FROM per_issue GROUP BY doc_id),
vec AS (SELECT doc_id, flatten(list_transform(nested, lambda x: list_concat(x, list_transform(range(w - len(x)), lambda y: 0)))) AS features,
               nested FROM per_doc)"""


@register("vote_vectors", sql=f"""{_VOTES_SQL}
SELECT doc_id, CAST(len(features) AS BIGINT) AS width, array_to_string(features, ',') AS features,
       CAST(len(list_filter(features, lambda x: x = 1)) AS BIGINT) AS n_yes,
       CAST(len(list_filter(features, lambda x: x = -1)) AS BIGINT) AS n_no,
       CAST(len(nested) AS BIGINT) AS n_issues
FROM vec
""")
def vote_vectors(spark, sf_dir):
    """J4 + M6 (rules backend) + F8 + M7 + F19: every question of every
    document, coded, nested per issue, padded and flattened."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    v = iss.vote_vectors(docs, "doc_id", "text", _question_table(spark, sf_dir))
    return v.select("doc_id", F.size("features").cast("bigint").alias("width"),
                    F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("features"),
                    F.size(F.filter("features", lambda x: x == 1)).cast("bigint").alias("n_yes"),
                    F.size(F.filter("features", lambda x: x == -1)).cast("bigint").alias("n_no"),
                    F.size("feature_vectors").cast("bigint").alias("n_issues"))


# ---------------------------------------------------------------------------
# Metrics (A4-A8, F5, F24, J7) on documents x labels
# ---------------------------------------------------------------------------

_GOLD_RAW = "CASE WHEN toxic = 1 THEN '\"Toxic\"' WHEN quality = 1 THEN 'Good' ELSE 'poor' END"
_PRED_RAW = "CASE WHEN text LIKE '%!%' THEN 'toxic' WHEN n_chars > 2000 THEN '\"GOOD\"' ELSE 'Poor' END"
_GOLD_SET = "list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)"
_PRED_SET = ("list_filter([CASE WHEN n_chars > 2000 THEN 'quality' END, CASE WHEN text LIKE '%!%' THEN 'toxic' END, "
             "CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL)")


def _gold_pred(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels")
    j = lab.join(d, "doc_id")
    nn = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    return j.select(
        "doc_id",
        clean_gold(F.expr(_GOLD_RAW)).alias("gold"), clean_gold(F.expr(_PRED_RAW)).alias("pred"),
        nn(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")).alias("gold_set"),
        nn(F.when(F.col("n_chars") > 2000, "quality"), F.when(F.col("text").like("%!%"), "toxic"),
           F.when(F.col("lang") != "en", "foreign")).alias("pred_set"))


_GP_SQL = f"""gp AS (SELECT l.doc_id, lower(replace({_GOLD_RAW}, '"', '')) AS gold, lower(replace({_PRED_RAW}, '"', '')) AS pred,
       {_GOLD_SET} AS gold_set, {_PRED_SET} AS pred_set FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


@register("label_metrics", sql=f"""WITH {_GP_SQL},
lbl AS (SELECT gold AS label FROM gp UNION SELECT pred FROM gp),
per AS (SELECT label, (SELECT count(*) FROM gp WHERE gold = label AND pred = label) AS tp,
               (SELECT count(*) FROM gp WHERE pred = label) AS n_pred,
               (SELECT count(*) FROM gp WHERE gold = label) AS n_true FROM lbl)
SELECT CAST((SELECT count(*) FROM gp) AS BIGINT) AS n,
       round((SELECT avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) FROM gp), 6) AS accuracy,
       round(avg(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END), 6) AS precision_macro,
       round(avg(CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END), 6) AS recall_macro,
       round((SELECT avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) FROM gp), 6) AS f1_micro
FROM per
""")
def label_metrics(spark, sf_dir):
    """A4 + F5: single-label accuracy, macro P/R, micro F1."""
    m = met.single_label_metrics(_gold_pred(spark, sf_dir), "gold", "pred")
    return m.select("n", *[round6(c).alias(c) for c in ["accuracy", "precision_macro", "recall_macro", "f1_micro"]])


@register("per_class_metrics", sql=f"""WITH {_GP_SQL},
t AS (SELECT doc_id, unnest(list_distinct(gold_set)) AS label FROM gp),
p AS (SELECT doc_id, unnest(list_distinct(pred_set)) AS label FROM gp),
j AS (SELECT coalesce(t.label, p.label) AS label, (t.doc_id IS NOT NULL AND p.doc_id IS NOT NULL)::INT AS tp,
             (t.doc_id IS NULL)::INT AS fp, (p.doc_id IS NULL)::INT AS fn
      FROM t FULL OUTER JOIN p ON t.doc_id = p.doc_id AND t.label = p.label),
s AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM j GROUP BY label)
SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall
FROM s
""")
def per_class_metrics(spark, sf_dir):
    """A5 via J7 (full outer join of gold and predicted label cells)."""
    m = met.per_class_relaxed(_gold_pred(spark, sf_dir), "doc_id", "gold_set", "pred_set")
    return m.select("label", "tp", "fp", "fn", round6("precision").alias("precision"), round6("recall").alias("recall"))


@register("multilabel_metrics", sql=f"""WITH {_GP_SQL},
r AS (SELECT list_distinct(gold_set) AS t, list_distinct(pred_set) AS p FROM gp),
x AS (SELECT t, p, len(list_intersect(t, p)) AS i FROM r),
y AS (SELECT *, CASE WHEN len(p) > 0 THEN i / len(p) ELSE 0.0 END AS pr,
                CASE WHEN len(t) > 0 THEN i / len(t) ELSE 0.0 END AS rc FROM x),
z AS (SELECT count(*) AS n, avg(CASE WHEN i > 0 THEN 1.0 ELSE 0.0 END) AS ra, avg(pr) AS sp, avg(rc) AS sr,
             avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) AS sf,
             sum(i) AS tp, sum(len(p) - i) AS fp, sum(len(t) - i) AS fn FROM y)
SELECT CAST(n AS BIGINT) AS n, round(ra, 6) AS relaxed_accuracy, round(sp, 6) AS sample_precision,
       round(sr, 6) AS sample_recall, round(sf, 6) AS sample_f1,
       round(CASE WHEN 0.25 * sp + sr > 0 THEN 1.25 * sp * sr / (0.25 * sp + sr) ELSE 0.0 END, 6) AS sample_f05,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS micro_precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS micro_recall,
       round(CASE WHEN 1.25 * tp + 0.25 * fn + fp > 0 THEN 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) ELSE 0.0 END, 6) AS micro_f05
FROM z
""")
def multilabel_metrics(spark, sf_dir):
    """A6 + A7 + A8 + F24: relaxed accuracy, sample-averaged and micro scores."""
    m = met.multilabel_summary(_gold_pred(spark, sf_dir), "gold_set", "pred_set", 0.5)
    return m.select("n", *[round6(c).alias(c) for c in m.columns if c != "n"])


# ---------------------------------------------------------------------------
# Group split (G1, G2, J5, P7, A10-A12) on the labeled documents
# ---------------------------------------------------------------------------

def _issue_dataset(spark, sf_dir):
    """Rows with at least one supported issue; group key = source."""
    lab = _labeled(spark, sf_dir)
    sup = iss.supported(iss.group_by_issue(lab, "doc_id"))
    return iss.with_supported_issue(lab, sup, "doc_id", ["source"])


_DS_SQL = f"""{_GROUPS_SQL},
ds AS (SELECT l.doc_id, s.source, l.issues FROM labeled l JOIN src s ON s.doc_id = l.doc_id
       WHERE len(list_intersect(l.issues, (SELECT list(issue) FROM groups WHERE n_segments > 5))) > 0),
grows AS (SELECT source, count(*) AS n_rows FROM ds GROUP BY source),
glab AS (SELECT source, label, count(*) AS n_lab FROM (SELECT source, unnest(list_distinct(issues)) AS label FROM ds) GROUP BY ALL),
labels_all AS (SELECT label, sum(n_lab) AS tot_lab FROM glab GROUP BY label)"""


def _diff_sql(assign: str, by: str) -> str:
    return f"""(SELECT {by}, avg(abs((tot_lab - coalesce(test_lab, 0)) / (tot_rows - test_rows) - coalesce(test_lab, 0) / test_rows)) AS diff
  FROM (SELECT {by}, sum(r.n_rows) AS test_rows, (SELECT sum(n_rows) FROM grows) AS tot_rows FROM {assign} a JOIN grows r ON r.source = a.source GROUP BY {by}) k
  CROSS JOIN labels_all la
  LEFT JOIN (SELECT {by}, g.label, sum(g.n_lab) AS test_lab FROM {assign} a JOIN glab g ON g.source = a.source GROUP BY {by}, g.label) tl
    USING ({by}, label)
  GROUP BY {by})"""


@register("group_split", sql=f"""{_DS_SQL},
tr AS (SELECT source, t AS trial, {q.det_uniform('42', 't', 'source')} AS u FROM grows, range(1000) r(t)),
test AS (SELECT trial, source FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY u, source) AS rk FROM tr)
         WHERE rk <= (SELECT greatest(1, floor(count(*) * 0.1)) FROM grows)),
diffs AS {_diff_sql('test', 'trial')},
best AS (SELECT trial, diff FROM diffs ORDER BY round(diff, 9), trial LIMIT 1)
SELECT g.source, CASE WHEN t.source IS NOT NULL THEN 'test' ELSE 'train' END AS side,
       CAST((SELECT trial FROM best) AS INTEGER) AS trial, round((SELECT diff FROM best), 6) AS diff
FROM grows g LEFT JOIN (SELECT source FROM test WHERE trial = (SELECT trial FROM best)) t ON t.source = g.source
""")
def group_split(spark, sf_dir):
    """G1 (10 % of groups, 1000 trials, seed 42) + P7 + J5 + A10-A12."""
    s = spl.stratified_group_split(_issue_dataset(spark, sf_dir), "issues", "source",
                                   test_size=0.1, n_trials=1000, seed=42)
    return s.select("source", "side", F.col("trial").cast("int").alias("trial"), round6("diff").alias("diff"))


@register("group_kfold", sql=f"""{_DS_SQL},
tr AS (SELECT source, t AS trial, {q.det_uniform('42', "'kfold'", 't', 'source')} AS u FROM grows, range(100) r(t)),
folds AS (SELECT trial, source, CAST((row_number() OVER (PARTITION BY trial ORDER BY u, source) - 1) % 5 AS INTEGER) AS fold FROM tr),
per_fold AS {_diff_sql('folds', 'trial, fold')},
score AS (SELECT trial, avg(diff) AS score FROM per_fold GROUP BY trial),
best AS (SELECT trial, score FROM score ORDER BY round(score, 9), trial LIMIT 1)
SELECT source, fold, CAST(trial AS INTEGER) AS trial, round((SELECT score FROM best), 6) AS score
FROM folds WHERE trial = (SELECT trial FROM best)
""")
def group_kfold(spark, sf_dir):
    """5 group folds, best of 100 seeded trials."""
    k = spl.stratified_group_kfold(_issue_dataset(spark, sf_dir), "issues", "source", 5, 100, 42)
    return k.select("source", "fold", F.col("trial").cast("int").alias("trial"), round6("score").alias("score"))


# ---------------------------------------------------------------------------
# Feedback generation (template backend) and judging
# ---------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    """(doc_id, issue, segment, template, knowledge, base) for every parsed
    label that has a template (J3); unmatched labels have no template."""
    lab = iss.explode_labels(_labeled(spark, sf_dir, deal=fine), "doc_id", ["text"]).select(
        "doc_id", "issue", F.col("text").alias("segment"))
    p = iss.attach_templates(lab, dims.templates_df(spark)).filter(F.col("template").isNotNull())
    return p.select("doc_id", "issue", "segment", "template", "knowledge",
                    fb.fill_template("template", "segment").alias("base"))


_PAIRS_SQL = f"""{_LABELED_SQL},
tpl AS (SELECT regexp_replace({q.normalize_label('template_key')}, '^\\W+', '') AS issue, knowledge, template
        FROM {_TPL_SQL}),
lab AS (SELECT doc_id, unnest(issues) AS issue FROM labeled),
pairs AS (SELECT l.doc_id, l.issue, d.text AS segment, t.template, t.knowledge,
                 replace(t.template, {q.lit(_fx.TEMPLATE_PLACEHOLDER)}, d.text) AS base
          FROM lab l JOIN tpl t ON t.issue = l.issue JOIN documents d ON d.doc_id = l.doc_id)"""


def _pick_sql(options, idx: str) -> str:
    return f"([{', '.join(q.lit(o) for o in options)}])[({idx}) % {len(options)} + 1]"


def _cand_sql(base: str, c: str) -> str:
    return f"({_pick_sql(fb.OPENINGS, f'({c}) // {len(fb.CLOSINGS)}')} || {base} || {_pick_sql(fb.CLOSINGS, c)})"


def _argmax_sql(src: str, keys: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(fitness, 9) DESC, cand_id) AS _rn
                FROM {src}) WHERE _rn = 1"""


_BASELINES_SQL = f"""{_PAIRS_SQL},
one AS (SELECT doc_id, issue, template, 0 AS cand_id,
               'Regarding ''' || issue || ''': please support the point "' || segment || '" with evidence.' AS text FROM pairs),
tmp AS (SELECT doc_id, issue, template, 0 AS cand_id, {_cand_sql('base', '0')} AS text FROM pairs),
pln AS (SELECT doc_id, issue, template, 0 AS cand_id,
               'knowledge_source: ' || coalesce(knowledge, 'Template') || '; justification: the issue is ''' || issue || '''.' || ' ' || base AS text FROM pairs),
bon_c AS (SELECT doc_id, issue, template, c AS cand_id, {_cand_sql('base', 'c')} AS text FROM pairs, range(15) r(c)),
bon AS ({_argmax_sql(f"(SELECT *, {q.fitness('text', 'template', 1)} AS fitness FROM bon_c)", 'doc_id, issue')}),
sr_c AS (SELECT doc_id, issue, template, c AS cand_id,
                {_cand_sql('base', 'c')} || {_pick_sql(fb.REFINEMENTS, 'c')} || {_pick_sql(fb.REFINEMENTS, 'c + 1')}
                || {_pick_sql(fb.REFINEMENTS, 'c + 2')} AS text FROM pairs, range(5) r(c)),
srf AS ({_argmax_sql(f"(SELECT *, {q.fitness('text', 'template', 1)} AS fitness FROM sr_c)", 'doc_id, issue')}),
allc AS (SELECT '1-pass' AS strategy, doc_id, issue, cand_id, text, {q.fitness('text', 'template', 1)} AS fitness FROM one
         UNION ALL SELECT 'Temp', doc_id, issue, cand_id, text, {q.fitness('text', 'template', 1)} FROM tmp
         UNION ALL SELECT 'Plan', doc_id, issue, cand_id, text, {q.fitness('text', 'template', 1)} FROM pln
         UNION ALL SELECT 'BoN', doc_id, issue, cand_id, text, fitness FROM bon
         UNION ALL SELECT 'Self-Ref.', doc_id, issue, cand_id, text, fitness FROM srf)"""


@register("feedback_baselines", sql=f"""{_BASELINES_SQL}
SELECT doc_id, issue, strategy, CAST(cand_id AS BIGINT) AS cand_id, round(fitness, 6) AS fitness, md5(text) AS text_md5
FROM allc
""")
def feedback_baselines(spark, sf_dir):
    """M12 + M13 + M14 + M15 + M16 + M17 (template backend), F18, W3, J3, F21."""
    return _baselines(spark, sf_dir).select(
        "doc_id", "issue", "strategy", F.col("cand_id").cast("bigint").alias("cand_id"),
        round6("fitness").alias("fitness"), F.md5("text").alias("text_md5"))


def _baselines(spark, sf_dir):
    keys = ["doc_id", "issue"]
    return fb.baselines(_pairs(spark, sf_dir), keys)


_ALL_PARENTS = f"array_to_string(list_concat([ps[1]], list_transform(ps[2:], lambda x: ({q.sentences('x')})[-1])), ' ')"


def _evolution_sql(n_cand=_fx.N_CANDIDATES, n_gen=_fx.N_GENERATIONS, n_par=_fx.N_PARENTS, seed=_fx.SEED, base="base",
                   child=_ALL_PARENTS):
    parts = [f"pop0 AS (SELECT doc_id, issue, template, c AS cand_id, {_cand_sql(base, 'c')} AS text FROM pairs, range({n_cand}) r(c))"]
    for g in range(n_gen):
        parts.append(f"""s{g} AS (SELECT *, {q.fitness('text', 'template', -1)} AS fitness FROM pop{g}),
par{g} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, issue ORDER BY
             round(fitness, 9) / 1.0 + {q.gumbel(str(seed), 'doc_id', 'issue', str(g), 'cand_id')} DESC, cand_id) AS rank FROM s{g})
           WHERE rank <= {n_par}),
ch{g} AS (SELECT doc_id, issue, template, {n_cand + g} AS cand_id,
                 {child} AS text
          FROM (SELECT doc_id, issue, template, list(text ORDER BY rank) AS ps FROM par{g} GROUP BY doc_id, issue, template)),
pop{g + 1} AS (SELECT doc_id, issue, template, cand_id, text FROM pop{g} UNION ALL SELECT * FROM ch{g})""")
    scored = f"(SELECT *, {q.fitness('text', 'template', -1)} AS fitness FROM pop{n_gen})"
    parts.append(f"fin AS ({_argmax_sql(scored, 'doc_id, issue')})")
    return ",\n".join(parts)


@register("feedback_evolution", sql=f"""{_PAIRS_SQL},
{_evolution_sql()}
SELECT doc_id, issue, CAST(cand_id AS BIGINT) AS cand_id, round(fitness, 6) AS fitness, md5(text) AS text_md5 FROM fin
""")
def feedback_evolution(spark, sf_dir):
    """M9 + W4 + M10 + M11 + U1 + W3: 10 candidates, 3 generations, 5 parents."""
    e = fb.evolve(_pairs(spark, sf_dir), ["doc_id", "issue"])
    return e.select("doc_id", "issue", F.col("cand_id").cast("bigint").alias("cand_id"),
                    round6("fitness").alias("fitness"), F.md5("text").alias("text_md5"))


def _judge_score_sql(d: str, seg: str, out: str) -> str:
    n, words = q.marks(out), f"list_distinct({q.tokens(out)})"
    return {
        "Conciseness": f"(CASE WHEN {n} <= 2 THEN 5 WHEN {n} = 3 THEN 4 WHEN {n} <= 5 THEN 3 WHEN {n} <= 8 THEN 2 ELSE 1 END)",
        "Relevance": f"CAST(1 + floor(4 * len(list_intersect({words}, {q.tokens(seg)})) / greatest(len({words}), 1)) AS INTEGER)",
        "Constructiveness": "(1 + least(4, " + " + ".join(
            f"CAST(contains(lower({out}), {q.lit(w)}) AS INTEGER)" for w in jd.SUGGESTIONS) + "))",
        "Specificity": f"(1 + CAST(contains({out}, '\"') AS INTEGER) + CAST(regexp_matches({out}, '[0-9]') AS INTEGER) "
                       f"+ CAST(len({words}) >= 30 AS INTEGER) + CAST(contains({out}, substr({seg}, 1, 20)) AS INTEGER))",
    }[d]


def _judge_sql_dim(i: int, d: str, seg: str, out: str) -> str:
    k = f"(({q.marks(out)} + {i}) % 4)"
    score = f"CAST({_judge_score_sql(d, seg, out)} AS VARCHAR)"
    reason = f"('The feedback has ' || CAST(len(string_split({out}, ' ')) AS VARCHAR) || ' words.')"
    comp = (f"(CASE WHEN {k} = 0 THEN 'Feedback: ' || {reason} || ' [RESULT] ' || {score} "
            f"WHEN {k} = 1 THEN 'Notes.' || chr(10) || '### ' || {reason} || chr(10) || '[RESULT] ' || {score} "
            f"WHEN {k} = 2 THEN {reason} || ' [RESULT] 3 [RESULT] ' || {score} ELSE {reason} END)")
    parts = f"string_split((string_split({comp}, '###'))[-1], '[RESULT]')"
    fbk = f"(CASE WHEN len({parts}) = 2 THEN replace({q.strip(f'({parts})[1]')}, chr(10), ' ') ELSE '' END)"
    sc = f"(CASE WHEN len({parts}) = 2 THEN replace({q.strip(f'({parts})[2]')}, chr(10), ' ') ELSE '' END)"
    dl = d.lower()
    return (f"{fbk} AS {dl}_feedback, {sc} AS {dl}_score, "
            f"CASE WHEN regexp_full_match({sc}, '[1-5]') THEN CAST({sc} AS INTEGER) END AS {dl}_score_int")


@register("judge_scores", sql=f"""{_BASELINES_SQL},
ji AS (SELECT doc_id, issue, string_split(p.segment, ';')[1] AS segment, t.text AS outputs
       FROM tmp t JOIN pairs p USING (doc_id, issue))
SELECT doc_id, issue, {', '.join(_judge_sql_dim(i, d, 'segment', 'outputs') for i, d in enumerate(_fx.JUDGE_DIMENSIONS))},
       'template' AS prompt
FROM ji
""")
def judge_scores(spark, sf_dir):
    """M18 (rules backend) + F10 + F11 + P2 + P10 + P11 on the template-guided
    feedback of every (document, issue) pair."""
    p = _pairs(spark, sf_dir)
    ji = p.select("doc_id", "issue", "segment", fb.template_candidate("base", F.lit(0)).alias("outputs"))
    j = jd.judge_wide(jd.judge_input(ji, "segment", "outputs"), "segment", "outputs", "template")
    return j.drop("segment", "outputs")


# ---------------------------------------------------------------------------
# Review tagging on conversations
# conv_id = review, turn = position, role = section, text = sentence; the
# review's sections are its 'user' and 'assistant' turns, so 'system' turns
# are skipped with a reason (section missing from the review).
# ---------------------------------------------------------------------------
_REVIEW_SECTIONS = ("user", "assistant")
_GOLD_SECTION = ("CASE WHEN text LIKE '%!%' THEN 'summary_of_strengthes' WHEN role = 'assistant' "
                 "THEN 'comments,_suggestions_and_typos' ELSE 'summary_of_weaknesses' END")
_GOLD_BIO = "CASE WHEN turn = 0 THEN 'B' WHEN length(text) < 100 THEN 'O' ELSE 'I' END"


def _review_tags(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())   # P1
    # P4/P5 as a join: the review's sections, keyed by (review, section name)
    sections = (conv.filter(F.col("role").isin(*_REVIEW_SECTIONS))
                .select("conv_id", "role").distinct()
                .withColumn("has_section", F.lit(True)))
    rows = (conv.join(sections, ["conv_id", "role"], "left")
            .select("conv_id", "turn", "role", "text", F.coalesce("has_section", F.lit(False)).alias("has_section")))
    processed = rows.filter("has_section")
    pred = tagging.tag_review_rows(processed, "conv_id", "turn", "text")
    out = rows.join(pred, ["conv_id", "turn"], "left")                                  # J6
    return out.select(
        "conv_id", "turn", "role", "text",
        F.coalesce("section_pred", F.lit("")).alias("section_pred"),                    # P9
        F.coalesce("bio_pred", F.lit("")).alias("bio_pred"),
        "seg_id",
        F.when(~F.col("has_section"), F.lit("section missing from review")).alias("skip_reason"))  # P12


_RT_SQL = f"""WITH conv AS (SELECT * FROM conversations WHERE text IS NOT NULL),
secs AS (SELECT DISTINCT conv_id, role AS section FROM conv WHERE role IN ('user', 'assistant')),
rows AS (SELECT c.*, s.section IS NOT NULL AS has_section FROM conv c LEFT JOIN secs s ON s.conv_id = c.conv_id AND s.section = c.role),
g AS (SELECT conv_id, list(turn ORDER BY turn) AS turns,
             list({q.sentence_features('text')} ORDER BY turn) AS f FROM rows WHERE has_section GROUP BY conv_id),
t AS (SELECT conv_id, turns, {q.fold('f', q.rules_bio)} AS b, {q.fold('f', q.rules_section)} AS s FROM g),
x AS (SELECT conv_id, unnest(turns) AS turn, unnest(b) AS bi, unnest(s) AS si FROM t),
rt AS (SELECT r.conv_id, r.turn, r.role, r.text, coalesce(x.si.tag, '') AS section_pred, coalesce(x.bi.tag, '') AS bio_pred,
              x.bi.seg AS seg_id, CASE WHEN NOT r.has_section THEN 'section missing from review' END AS skip_reason
       FROM rows r LEFT JOIN x ON x.conv_id = r.conv_id AND x.turn = r.turn)"""


@register("review_tags", sql=f"""{_RT_SQL}
SELECT conv_id, turn, section_pred, bio_pred, CAST(seg_id AS BIGINT) AS seg_id, skip_reason FROM rt
""")
def review_tags(spark, sf_dir):
    """M3 + M4 chained taggers (rules backend) per review, skipped rows kept
    with a reason and empty predictions."""
    return _review_tags(spark, sf_dir).select("conv_id", "turn", "section_pred", "bio_pred",
                                              F.col("seg_id").cast("bigint").alias("seg_id"), "skip_reason")


def _a4_sql(gold: str, pred: str, prefix: str) -> str:
    return f"""(SELECT round(avg(CASE WHEN g = p THEN 1.0 ELSE 0.0 END), 4) AS {prefix}_accuracy,
        round(avg(CASE WHEN g = p THEN 1.0 ELSE 0.0 END), 4) AS {prefix}_f1,
        round((SELECT avg(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END) FROM
               (SELECT l, (SELECT count(*) FROM ev WHERE {gold} = l AND {pred} = l) AS tp,
                       (SELECT count(*) FROM ev WHERE {pred} = l) AS n_pred
                FROM (SELECT {gold} AS l FROM ev UNION SELECT {pred} FROM ev))), 4) AS {prefix}_precision,
        round((SELECT avg(CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END) FROM
               (SELECT l, (SELECT count(*) FROM ev WHERE {gold} = l AND {pred} = l) AS tp,
                       (SELECT count(*) FROM ev WHERE {gold} = l) AS n_true
                FROM (SELECT {gold} AS l FROM ev UNION SELECT {pred} FROM ev))), 4) AS {prefix}_recall
       FROM (SELECT {gold} AS g, {pred} AS p FROM ev))"""


@register("review_tag_metrics", sql=f"""{_RT_SQL},
ev AS (SELECT lower(replace({_GOLD_SECTION}, '"', '')) AS gs, lower(replace(section_pred, '"', '')) AS ps,
              {_GOLD_BIO} AS gb, bio_pred AS pb FROM rt WHERE skip_reason IS NULL)
SELECT * FROM {_a4_sql('gs', 'ps', 'section')} a, {_a4_sql('gb', 'pb', 'bio')} b
""")
def review_tag_metrics(spark, sf_dir):
    """A4 + F5 + S7: section and BIO accuracy, macro P/R, micro F1 at 4
    decimals, over the processed rows."""
    t = _review_tags(spark, sf_dir).filter(F.col("skip_reason").isNull())
    ev = t.select(clean_gold(F.expr(_GOLD_SECTION)).alias("gs"), clean_gold("section_pred").alias("ps"),
                  F.expr(_GOLD_BIO).alias("gb"), F.col("bio_pred").alias("pb"))
    r = met.single_label_report(ev, {"section": ("gs", "ps"), "bio": ("gb", "pb")})
    out = []
    for t in ("section", "bio"):
        out += [F.round(f"{t}_accuracy", 4).alias(f"{t}_accuracy"), F.round(f"{t}_f1_micro", 4).alias(f"{t}_f1"),
                F.round(f"{t}_precision_macro", 4).alias(f"{t}_precision"),
                F.round(f"{t}_recall_macro", 4).alias(f"{t}_recall")]
    return r.select(*out)


@register("review_segments", sql=f"""{_RT_SQL},
w AS (SELECT conv_id, turn, text, bio_pred,
             sum(CASE WHEN bio_pred = 'B' OR (bio_pred = 'I' AND coalesce(prev, '') IN ('', 'O')) THEN 1 ELSE 0 END)
               OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg_id
      FROM (SELECT *, lag(bio_pred) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM rt WHERE skip_reason IS NULL))
SELECT conv_id, CAST(seg_id AS BIGINT) AS seg_id, CAST(count(*) AS BIGINT) AS n_sentences, min(turn) AS first_turn,
       md5(string_agg(text, ' ' ORDER BY turn)) AS segment_md5
FROM w WHERE bio_pred <> 'O' GROUP BY conv_id, seg_id
""")
def review_segments(spark, sf_dir):
    """W2 with windows (lag + running sum of openers) on the predicted tags,
    then segment texts in position order."""
    t = _review_tags(spark, sf_dir).filter(F.col("skip_reason").isNull()).drop("seg_id")
    w = tagging.assign_segments(t, "conv_id", "turn", "bio_pred")
    s = tagging.segments_from_tags(w, "conv_id", pos="turn", seg="seg_id", tag="bio_pred", text="text")
    return s.select("conv_id", F.col("seg_id").cast("bigint").alias("seg_id"),
                    F.col("n_sentences").cast("bigint").alias("n_sentences"),
                    F.col("first_pos").alias("first_turn"), F.md5("segment").alias("segment_md5"))


# ---------------------------------------------------------------------------
# M0 with a Python batch backend: the vote stage through model_map
# ---------------------------------------------------------------------------


@register("vote_vectors_model", sql=ORACLE["vote_vectors"])
def vote_vectors_model(spark, sf_dir):
    """M0 + J4 + M6 + F8 + M7 + F19 through a Python batch backend: a distinct
    text crosses into Python once with all its questions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    qt = _question_table(spark, sf_dir)
    v = iss.vote_with_model(docs, "doc_id", "text", qt, BackendFactory("rules-vote", doubles.vote))
    return v.select("doc_id", F.size("features").cast("bigint").alias("width"),
                    F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("features"),
                    F.size(F.filter("features", lambda x: x == 1)).cast("bigint").alias("n_yes"),
                    F.size(F.filter("features", lambda x: x == -1)).cast("bigint").alias("n_no"),
                    F.size("feature_vectors").cast("bigint").alias("n_issues"))


# ---------------------------------------------------------------------------
# Scaling and classifiers
# ---------------------------------------------------------------------------


@register("embedding_standardize", sql="""
WITH e AS (SELECT vec_id, label, embedding FROM embeddings),
x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM e),
st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY i),
z AS (SELECT x.vec_id, CASE WHEN st.s > 0 THEN (x.v - st.m) / st.s ELSE 0.0 END AS z FROM x JOIN st USING (i))
SELECT vec_id, round(sum(z), 6) AS z_sum, round(sum(z * z), 6) AS z_sq, round(max(abs(z)), 6) AS z_max FROM z GROUP BY vec_id
""")
def embedding_standardize(spark, sf_dir):
    """Per-dimension standard scaling of the embeddings (population std,
    constant dimensions -> 0)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    z = mdl.standardize(e, "embedding")
    return z.select("vec_id",
                    round6(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x)).alias("z_sum"),
                    round6(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x)).alias("z_sq"),
                    round6(F.array_max(F.transform("scaled", F.abs))).alias("z_max"))


# Gaussian naive Bayes in SQL: cells (doc, label) of a test part, from the class means and variances of
# the rest (population, plus 1e-9 of the largest feature variance), features standardised on the rest.
_NB_DATA_SQL = f"""{_VOTES_SQL}{_DS_SQL[len(_GROUPS_SQL):]},
lbl AS (SELECT issue AS l FROM groups WHERE n_segments > 5),
feat AS (SELECT ds.doc_id, ds.source, unnest(range(len(features))) AS i, CAST(unnest(features) AS DOUBLE) AS v
         FROM ds JOIN vec ON vec.doc_id = ds.doc_id)"""


def _nb_cells_sql(parts: str) -> str:
    """``parts``: (part, source, test) rows; the result has (part, l, y_true, y_pred)."""
    return f"""x AS (SELECT p.part, p.test, f.doc_id, i, v FROM feat f JOIN {parts} p ON p.source = f.source),
st AS (SELECT part, i, avg(v) AS m, stddev_pop(v) AS s FROM x WHERE NOT test GROUP BY part, i),
z AS (SELECT x.part, x.test, x.doc_id, x.i, CASE WHEN s > 0 THEN (v - m) / s ELSE 0.0 END AS z
      FROM x JOIN st ON st.part = x.part AND st.i = x.i),
y AS (SELECT p.part, p.test, ds.doc_id, l, list_contains(issues, l) AS y FROM ds JOIN {parts} p ON p.source = ds.source, lbl),
cls AS (SELECT part, l, y, ln(count(*)) AS prior FROM y WHERE NOT test GROUP BY part, l, y),
eps AS (SELECT part, 1e-9 * max(var) AS e FROM (SELECT part, i, var_pop(z) AS var FROM z WHERE NOT test GROUP BY part, i) GROUP BY part),
mom AS (SELECT z.part, l, y, i, avg(z) AS mu, var_pop(z) + any_value(e) AS s2
        FROM z JOIN y ON y.part = z.part AND y.doc_id = z.doc_id JOIN eps ON eps.part = z.part
        WHERE NOT z.test GROUP BY z.part, l, y, i),
sc AS (SELECT z.part, z.doc_id, mom.l, mom.y, any_value(prior) - 0.5 * sum(ln(2 * pi() * s2) + (z - mu) * (z - mu) / s2) AS s
       FROM z JOIN mom ON mom.part = z.part AND mom.i = z.i JOIN cls ON cls.part = z.part AND cls.l = mom.l AND cls.y = mom.y
       WHERE z.test GROUP BY z.part, z.doc_id, mom.l, mom.y),
pr AS (SELECT part, doc_id, l, max_by(y, s) AS y_pred FROM sc GROUP BY part, doc_id, l),
cells AS (SELECT pr.part, CAST(y.y AS INT) AS t, CAST(y_pred AS INT) AS p FROM pr JOIN y ON y.part = pr.part AND y.doc_id = pr.doc_id AND y.l = pr.l),
micro AS (SELECT part, sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn FROM cells GROUP BY part),
nb AS (SELECT part, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
              CASE WHEN 1.25 * tp + 0.25 * fn + fp > 0 THEN 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) ELSE 0.0 END AS f05 FROM micro)"""


@register("classifier_nb_holdout", sql=f"""{_NB_DATA_SQL},
tr AS (SELECT source, t AS trial, {q.det_uniform('42', 't', 'source')} AS u FROM grows, range(1000) r(t)),
test AS (SELECT trial, source FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY u, source) AS rk FROM tr)
         WHERE rk <= (SELECT greatest(1, floor(count(*) * 0.1)) FROM grows)),
diffs AS {_diff_sql('test', 'trial')},
best AS (SELECT trial FROM diffs ORDER BY round(diff, 9), trial LIMIT 1),
parts AS (SELECT 0 AS part, source, source IN (SELECT source FROM test WHERE trial = (SELECT trial FROM best)) AS test FROM grows),
{_nb_cells_sql('parts')}
SELECT 'Gaussian Naive Bayes' AS model, round(f05, 6) AS f05, round(precision, 6) AS precision, round(recall, 6) AS recall FROM nb
""")
def classifier_nb_holdout(spark, sf_dir):
    """J1 + J5 + G1 + F19 + G3 + G4 + G6 + A8 + C13: the hold-out with the one model that
    SQL can write down."""
    data, sides, vocab = _holdout_data(spark, sf_dir)
    tested = data.join(sides.select("source", (F.col("side") == "test").alias("test")), "source")
    scores = onepass.hold_out(tested, "features", "issues", "test", vocab, ["Gaussian Naive Bayes"])
    return scores.select("model", round6("f05").alias("f05"), round6("precision").alias("precision"), round6("recall").alias("recall"))


_HOLDOUT_MODELS = ["Logistic Regression (L2)", "Gaussian Naive Bayes"]


@register("classifier_holdout")
def classifier_holdout(spark, sf_dir):
    """J1 + G1 + F19 + G3 + G4 + G6 + A8: vote vectors joined to the labeled
    rows, group hold-out split, standardised features, binary relevance per
    supported issue for two MLlib classifiers, micro F0.5 on the test side.
    Trained models are not SQL-expressible: rows-only check."""
    return _holdout(spark, sf_dir, _HOLDOUT_MODELS)


def _voted_data(spark, sf_dir):
    """P7 + J1: (rows with their vote vectors, label vocabulary).  Labels and questions are written once (shared
    checkpoint folder), so the texts are read three times: for the labels, the questions and the votes."""
    lab = checkpointed(_labeled(spark, sf_dir, deal=fine).select("doc_id", "source", "issues"))
    sup = checkpointed(iss.supported(iss.group_by_issue(lab, "doc_id")))
    ds = iss.with_supported_issue(lab, sup, "doc_id", ["source"])
    qt = checkpointed(_question_table(spark, sf_dir, deal=fine, groups=sup))
    vec = iss.vote_vectors(_texts(spark, sf_dir), "doc_id", "text", qt).select("doc_id", "features")
    # checkpointed so the split's subqueries and every fit start from the materialized rows; dealt evenly, as a
    # shuffle is coalesced by its compressed bytes, and vote vectors are few bytes for much work
    data = checkpointed(ds.join(vec, "doc_id", "left").repartition(spark.sparkContext.defaultParallelism))
    return data, [r["issue"] for r in sup.orderBy("issue").collect()]          # bounded label vocabulary


def _holdout_data(spark, sf_dir):
    """(rows with their vote vectors, sides of the split, label vocabulary)."""
    data, vocab = _voted_data(spark, sf_dir)
    return data, spl.stratified_group_split(data, "issues", "source", 0.1, 1000, 42), vocab


def _holdout(spark, sf_dir, models):
    data, sides, vocab = _holdout_data(spark, sf_dir)
    train, test = spl.split_sides(data, sides, "source")
    train = mdl.standardize(train, "features", out="x")
    test = mdl.standardize(test, "features", fit=data.join(sides.filter("side = 'train'"), "source", "left_semi"),
                           out="x")
    train, test = checkpointed(train), checkpointed(test)

    def fit(name):   # models are independent: their fits are submitted concurrently
        cells = mdl.binary_relevance(train, test, "doc_id", "x", "issues", vocab, mdl.CLASSIFIERS[name])
        return mdl.holdout_scores(cells).select(F.lit(name).alias("model"), round6("f05").alias("f05"),
                                                round6("precision").alias("precision"), round6("recall").alias("recall"))
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=len(models)) as ex:
        parts = list(ex.map(fit, models))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# M5 prompt render, M19 vote sweep, A14 count report
# ---------------------------------------------------------------------------


@register("question_prompts", sql=f"""{_TOP_SQL},
rat AS (SELECT * FROM {_RAT_SQL}),
segs AS (SELECT t.issue, string_agg(d.text, chr(10) ORDER BY t.rank) AS segments
         FROM top t JOIN documents d ON d.doc_id = t.doc_id GROUP BY t.issue),
p AS (SELECT g.issue, {q.lit(PROMPTS['question_mining'].split('{issue}')[0])} || g.issue
             || {q.lit(PROMPTS['question_mining'].split('{issue}')[1].split('{reason}')[0])}
             || coalesce(nullif(r.reason, ''), {q.lit(dims.GENERIC_REASON)})
             || {q.lit(PROMPTS['question_mining'].split('{reason}')[1].split('{segments}')[0])}
             || s.segments || {q.lit(PROMPTS['question_mining'].split('{segments}')[1])} AS prompt
      FROM groups g JOIN segs s ON s.issue = g.issue LEFT JOIN rat r ON r.issue = g.issue WHERE g.n_segments > 5)
SELECT issue, CAST(length(prompt) AS BIGINT) AS prompt_chars, md5(prompt) AS prompt_md5 FROM p
""")
def question_prompts(spark, sf_dir):
    """M5 render (F22): per supported issue, label + reason (J2) + its first
    five segments in position order (A2)."""
    return _prompts(spark, sf_dir).select("issue", F.length("prompt").cast("bigint").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


_SYSTEM = "You read peer reviews and ask short questions that can be answered with yes or no."


@register("question_messages", sql=ORACLE["question_prompts"].rsplit("SELECT issue, CAST(length", 1)[0] + f"""
SELECT issue, CAST(2 AS BIGINT) AS n_messages, md5('system' || chr(10) || {q.lit(_SYSTEM)} || chr(10) || 'user' || chr(10) || prompt) AS messages_md5 FROM p
""")
def question_messages(spark, sf_dir):
    """the question-mining prompts as system and user chat messages."""
    m = _prompts(spark, sf_dir).select("issue", chat("prompt", _SYSTEM).alias("m"))
    lines = F.flatten(F.transform("m", lambda x: F.array(x["role"], x["content"])))
    return m.select("issue", F.size("m").cast("bigint").alias("n_messages"), F.md5(F.array_join(lines, "\n")).alias("messages_md5"))


def _prompts(spark, sf_dir):
    _, top = _mined_segments(spark, sf_dir)
    segs = (top.groupBy("issue")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_s"))
            .select("issue", F.array_join(F.transform("_s", lambda x: x["text"]), "\n").alias("segments")))
    withr = iss.attach_rationale(segs, dims.rationale_df(spark))
    return withr.select("issue", render("question_mining", issue="issue", reason="reason", segments="segments").alias("prompt"))


_SWEEP = {"rules/lower v1": doubles.vote, "rules/plain v1": doubles.vote_plain}


def _sweep_sql() -> str:
    base = _VOTES_SQL
    plain = base.replace(_vote_code_sql('d.text', 'qk.keyword'),
                         "(CASE WHEN contains(d.text, regexp_extract(qk.question, %s, 1)) THEN 1 ELSE -1 END)"
                         % q.lit("'([^']*)'")).replace("qk AS (SELECT issue_idx,", "qk AS (SELECT question, issue_idx,")
    def sel(src_sql, model):
        return (f"SELECT {q.lit(model)} AS raw_model, doc_id, array_to_string(features, ',') AS features FROM "
                f"({src_sql} SELECT * FROM vec)")
    first, second = _SWEEP
    return (f"SELECT regexp_replace(raw_model, '[^a-zA-Z0-9_-]', '_', 'g') AS model, doc_id, features FROM ("
            f"{sel(base, first)} UNION ALL {sel(plain, second)})")


@register("vote_sweep", sql=_sweep_sql())
def vote_sweep(spark, sf_dir):
    """The vote stage once per model backend, with a file-safe model
    name (S8) -- the column a ``partitionBy('model')`` write would use."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    qt = checkpointed(_question_table(spark, sf_dir))
    out = gen.sweep({name: BackendFactory(name, make) for name, make in _SWEEP.items()},
                    lambda backend: iss.vote_with_model(docs, "doc_id", "text", qt, backend))
    return out.select("model", "doc_id", F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("features"))


@register("split_counts", sql=f"""{_DS_SQL},
tr AS (SELECT source, t AS trial, {q.det_uniform('42', 't', 'source')} AS u FROM grows, range(1000) r(t)),
test AS (SELECT trial, source FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY u, source) AS rk FROM tr)
         WHERE rk <= (SELECT greatest(1, floor(count(*) * 0.1)) FROM grows)),
diffs AS {_diff_sql('test', 'trial')},
best AS (SELECT trial FROM diffs ORDER BY round(diff, 9), trial LIMIT 1),
tg AS (SELECT source FROM test WHERE trial = (SELECT trial FROM best))
SELECT CAST((SELECT count(*) FROM labeled) AS BIGINT) AS n_rows,
       CAST((SELECT count(*) FROM ds) AS BIGINT) AS n_filtered,
       CAST((SELECT count(*) FROM grows) AS BIGINT) AS n_groups,
       CAST((SELECT count(*) FROM tg) AS BIGINT) AS n_test_groups,
       CAST((SELECT count(*) FROM ds WHERE source NOT IN (SELECT source FROM tg)) AS BIGINT) AS n_train,
       CAST((SELECT count(*) FROM ds WHERE source IN (SELECT source FROM tg)) AS BIGINT) AS n_test
""")
def split_counts(spark, sf_dir):
    """A14 + A12: rows, filtered rows (P7), groups, test groups and the sizes
    of both sides of the G1 split, as one row (count_if over one pass)."""
    lab = _labeled(spark, sf_dir)
    ds = _issue_dataset(spark, sf_dir)
    sides = spl.stratified_group_split(ds, "issues", "source", 0.1, 1000, 42)
    per = ds.join(sides.select("source", "side"), "source")
    c = per.agg(F.count(F.lit(1)).alias("n_filtered"),
                F.count_distinct("source").alias("n_groups"),
                F.count_distinct(F.when(F.col("side") == "test", F.col("source"))).alias("n_test_groups"),
                F.count_if(F.col("side") == "train").alias("n_train"),
                F.count_if(F.col("side") == "test").alias("n_test"))
    return c.select(lab.select(F.count(F.lit(1))).scalar().cast("bigint").alias("n_rows"),
                    *[F.col(x).cast("bigint").alias(x) for x in c.columns])


@register("classifier_cv", sql=f"""{_NB_DATA_SQL},
tr AS (SELECT source, t AS trial, {q.det_uniform('42', "'kfold'", 't', 'source')} AS u FROM grows, range(100) r(t)),
folds AS (SELECT trial, source, CAST((row_number() OVER (PARTITION BY trial ORDER BY u, source) - 1) % 5 AS INTEGER) AS fold FROM tr),
per_fold AS {_diff_sql('folds', 'trial, fold')},
score AS (SELECT trial, avg(diff) AS score FROM per_fold GROUP BY trial),
best AS (SELECT trial FROM score ORDER BY round(score, 9), trial LIMIT 1),
parts AS (SELECT r.f AS part, source, fold = r.f AS test FROM folds, range(5) r(f) WHERE trial = (SELECT trial FROM best)),
{_nb_cells_sql('parts')}
SELECT 'Gaussian Naive Bayes' AS model, round(avg(f05), 6) AS mean_f05, round(avg(precision), 6) AS mean_precision,
       round(avg(recall), 6) AS mean_recall FROM nb
""")
def classifier_cv(spark, sf_dir):
    """G2 + G5 + A9: group folds (best of 100 seeded trials), binary relevance
    per supported issue trained on four folds and scored on the fifth, mean
    micro F0.5 / precision / recall (C13), all folds and labels in one pass."""
    return _cross_validated(spark, sf_dir, ["Gaussian Naive Bayes"])


@register("classifier_cv_csv", sql=ORACLE["classifier_cv"])
def classifier_cv_csv(spark, sf_dir):
    """The cross-validation results as a CSV file, read back."""
    path = shared_path(spark, "cv-results")
    sio.write_csv(_cross_validated(spark, sf_dir, ["Gaussian Naive Bayes"]), path)
    return spark.read.schema("model string, mean_f05 double, mean_precision double, mean_recall double").option("header", True).csv(path)


@register("classifier_cv_onepass")
def classifier_cv_onepass(spark, sf_dir):
    """G5 + A9 with every classifier that is fitted for all folds and labels at once (C2, C10, C13); checked
    against plain versions in tests/test_onepass.py."""
    return _cross_validated(spark, sf_dir, list(onepass.ONE_PASS))


def _cross_validated(spark, sf_dir, names):
    data, vocab = _voted_data(spark, sf_dir)
    folds = spl.stratified_group_kfold(data, "issues", "source", 5, 100, 42).select("source", "fold")
    res = onepass.cross_validate(data.join(folds, "source"), "features", "issues", "fold", vocab, 5, names)
    return res.select("model", round6("mean_f05").alias("mean_f05"), round6("mean_precision").alias("mean_precision"),
                      round6("mean_recall").alias("mean_recall"))


# ---------------------------------------------------------------------------
# k nearest neighbours (C1, J8, W5) on the embeddings, leave-one-out
# ---------------------------------------------------------------------------

_KNN_SQL = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
pairs AS (SELECT a.vec_id AS q, b.vec_id AS t,
                 sqrt(list_sum(list_transform(range(len(a.v)), lambda i: (a.v[i + 1] - b.v[i + 1]) * (a.v[i + 1] - b.v[i + 1])))) AS dist
          FROM e a, e b WHERE a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT q, t, dist, row_number() OVER (PARTITION BY q ORDER BY round(dist, 9), t) AS rank FROM pairs)
       WHERE rank <= 5)"""


@register("knn_neighbors", sql=f"""{_KNN_SQL}
SELECT q AS vec_id, CAST(rank AS INTEGER) AS rank, t AS neighbor_id, round(dist, 5) AS dist FROM nn
""")
def knn_neighbors(spark, sf_dir):
    """W5 + J8: the 5 nearest other embeddings of every embedding, exact,
    through blocks of cells that the k-th distance leaves."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    e2 = e.withColumnRenamed("vec_id", "qid")
    n = nbr.knn(e.withColumnRenamed("vec_id", "tid"), e2, "tid", "qid", "embedding", 5, exclude_self=True)
    return n.select(F.col("qid").alias("vec_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("tid").alias("neighbor_id"), F.round("dist", 5).alias("dist"))


@register("knn_predict", sql=f"""{_KNN_SQL},
lab AS (SELECT nn.q, e.label, count(*) AS c FROM nn JOIN e ON e.vec_id = nn.t GROUP BY nn.q, e.label),
pred AS (SELECT q, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, label) AS r FROM lab) WHERE r = 1)
SELECT e.vec_id, e.label, p.predicted, e.label = p.predicted AS correct FROM e JOIN pred p ON p.q = e.vec_id
""")
def knn_predict(spark, sf_dir):
    """Leave-one-out 5-NN label vote on the embeddings."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    n = nbr.knn(e.withColumnRenamed("vec_id", "tid"), e.withColumnRenamed("vec_id", "qid"),
                "tid", "qid", "embedding", 5, exclude_self=True)
    p = nbr.knn_vote(n, e.withColumnRenamed("vec_id", "tid"), "qid", "tid", "label")
    return (e.select("vec_id", "label").join(p.withColumnRenamed("qid", "vec_id"), "vec_id")
            .select("vec_id", "label", "predicted", (F.col("label") == F.col("predicted")).alias("correct")))


_EMB_LABELS = ("CASE WHEN label % 2 = 0 THEN 'even' END", "CASE WHEN label % 3 = 0 THEN 'third' END", "CASE WHEN label < 4 THEN 'low' END")


@register("knn_multilabel", sql=f"""{_KNN_SQL},
el AS (SELECT vec_id, unnest(list_filter([{', '.join(_EMB_LABELS)}], lambda x: x IS NOT NULL)) AS l FROM embeddings),
v AS (SELECT nn.q, el.l FROM nn JOIN el ON el.vec_id = nn.t GROUP BY nn.q, el.l HAVING count(*) > 2.5)
SELECT e.vec_id, coalesce(string_agg(v.l, ',' ORDER BY v.l), '') AS predicted FROM embeddings e LEFT JOIN v ON v.q = e.vec_id GROUP BY e.vec_id
""")
def knn_multilabel(spark, sf_dir):
    """C1 as one of the multi-label models: a label is predicted if more than half of
    the 5 nearest have it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.array_compact(F.array(
        *[F.expr(x) for x in _EMB_LABELS])).alias("labels"))
    n = nbr.knn(e.withColumnRenamed("vec_id", "tid"), e.withColumnRenamed("vec_id", "qid"),
                "tid", "qid", "embedding", 5, exclude_self=True)
    p = nbr.knn_label_sets(n, e.withColumnRenamed("vec_id", "tid"), "qid", "tid", "labels")
    return p.select(F.col("qid").alias("vec_id"), F.array_join("predicted", ",").alias("predicted"))


# ---------------------------------------------------------------------------
# S4 + P4 + P5: review bodies as Python dict literals, parsed back and looked up
# ---------------------------------------------------------------------------


def _py_str_literal(c):
    """Single-quoted Python string literal of a column (backslash, quote and
    control characters escaped as ``repr`` would)."""
    s = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for a, b in [("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit("'"), s, F.lit("'"))


@register("review_dict_sections", sql="""
WITH conv AS (SELECT * FROM conversations WHERE text IS NOT NULL),
secs AS (SELECT conv_id, role AS section, string_agg(text, ' ' ORDER BY turn) AS section_text
         FROM conv WHERE role IN ('user', 'assistant') GROUP BY conv_id, role)
SELECT c.conv_id, c.turn, s.section IS NOT NULL AS has_section,
       CAST(length(s.section_text) AS BIGINT) AS section_chars, md5(s.section_text) AS section_md5
FROM conv c LEFT JOIN secs s ON s.conv_id = c.conv_id AND s.section = c.role
""")
def review_dict_sections(spark, sf_dir):
    """S4 + P4 + P5: each review's sections written as a Python dict literal
    (the original's ``Review`` column), parsed back to a map (JVM JSON path,
    ``literal_eval`` fallback for the rest), then every sentence row checks
    and looks up its own section."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    secs = (conv.filter(F.col("role").isin(*_REVIEW_SECTIONS))
            .groupBy("conv_id", "role")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                                          lambda x: x["text"]), " ").alias("section_text")))
    literal = (secs.groupBy("conv_id")
               .agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(
                   F.concat(_py_str_literal(F.col("role")), F.lit(": "), _py_str_literal(F.col("section_text"))))), ", "),
                   F.lit("}")).alias("review")))
    parsed = sio.parse_review_dict(literal, "review", "review_map").select("conv_id", "review_map")
    rows = conv.join(parsed, "conv_id", "left")
    sec = F.try_element_at("review_map", F.col("role"))                                   # P5
    return rows.select("conv_id", "turn",
                       F.coalesce(F.map_contains_key("review_map", F.col("role")), F.lit(False)).alias("has_section"),  # P4
                       F.length(sec).cast("bigint").alias("section_chars"), F.md5(sec).alias("section_md5"))


@register("judge_scores_model", sql=ORACLE["judge_scores"])
def judge_scores_model(spark, sf_dir):
    """M18 through M0 with a Python judge backend + A13 pivot; same result
    as ``judge_scores``."""
    p = _pairs(spark, sf_dir)
    ji = p.select("doc_id", "issue", "segment", fb.template_candidate("base", F.lit(0)).alias("outputs"))
    return jd.judge_with_model(ji, ["doc_id", "issue"], "segment", "outputs",
                               BackendFactory("rules-judge", doubles.judge), "template")


@register("feedback_bon_model", sql=f"SELECT * FROM ({ORACLE['feedback_baselines']}) b WHERE strategy = 'BoN'")
def feedback_bon_model(spark, sf_dir):
    """M15 through M0: 15 seeded candidates per (segment, issue) from the
    template-guided prompt, scored (F18) and the best kept (W3); equal to the
    BoN rows of ``feedback_baselines``."""
    keys = ["doc_id", "issue"]
    best = gen.best_of_n(_pairs(spark, sf_dir), keys, BackendFactory("template-sampler", doubles.feedback))
    return best.select("doc_id", "issue", F.lit("BoN").alias("strategy"), F.col("cand_id").cast("bigint").alias("cand_id"),
                       round6("fitness").alias("fitness"), F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------------------
# Generation with a model backend (M8-M14, M16, M17), question mining with a model (M5)
# ---------------------------------------------------------------------------

_SAID = q.lit("Regarding '") + " || issue || " + q.lit("': please support the point \"") + " || segment || " + q.lit("\" with evidence.")
_ADDRESS = q.lit("Address '") + " || issue || " + q.lit("'. ") + " || template"
_PLANNED = "(template || " + q.lit(" (knowledge_source: template; justification: '") + " || issue || " + q.lit("')") + ")"


def _refined_sql(t: str) -> str:
    for _ in range(_fx.BON_GEN):
        t = f"({t} || {_pick_sql(fb.REFINEMENTS, f'length({t})')})"
    return t


_BASELINES_MODEL_SQL = f"""{_PAIRS_SQL},
c AS (SELECT '1-pass' AS strategy, doc_id, issue, template, 0 AS cand_id, {_SAID} AS text FROM pairs
      UNION ALL SELECT 'Temp', doc_id, issue, template, 0, {_cand_sql('base', '0')} FROM pairs
      UNION ALL SELECT 'Plan', doc_id, issue, template, 0, {_ADDRESS} FROM pairs
      UNION ALL SELECT 'Self-Ref.', doc_id, issue, template, c, {_refined_sql('t')}
        FROM (SELECT doc_id, issue, template, c, {_cand_sql('template', 'c')} AS t FROM pairs, range({_fx.BON_N}) r(c)))"""


@register("feedback_baselines_model", sql=f"""{_BASELINES_MODEL_SQL}
SELECT doc_id, issue, strategy, CAST(cand_id AS BIGINT) AS cand_id, round(fitness, 6) AS fitness, md5(text) AS text_md5
FROM ({_argmax_sql(f"(SELECT *, {q.fitness('text', 'template', 1)} AS fitness FROM c)", 'doc_id, issue, strategy')})
""")
def feedback_baselines_model(spark, sf_dir):
    """M12 + M13 + M14 + M16 + M17 through the model map (M15: ``feedback_bon_model``)."""
    b = gen.baselines(_pairs(spark, sf_dir), ["doc_id", "issue"], BackendFactory("feedback", doubles.feedback),
                      ["1-pass", "Temp", "Plan", "Self-Ref."])
    return b.select("doc_id", "issue", "strategy", F.col("cand_id").cast("bigint").alias("cand_id"),
                    round6("fitness").alias("fitness"), F.md5("text").alias("text_md5"))


@register("feedback_evolution_model", sql=f"""{_PAIRS_SQL},
{_evolution_sql(base=_PLANNED, child="ps[1] || ' (of ' || CAST(len(ps) AS VARCHAR) || ')'")}
SELECT doc_id, issue, CAST(cand_id AS BIGINT) AS cand_id, round(fitness, 6) AS fitness, md5(text) AS text_md5 FROM fin
""")
def feedback_evolution_model(spark, sf_dir):
    """M8-M11 through the model map: plan (with F25 context), candidates, crossover
    of all numbered parents."""
    e = gen.evolve(_pairs(spark, sf_dir), ["doc_id", "issue"], BackendFactory("feedback", doubles.feedback))
    return e.select("doc_id", "issue", F.col("cand_id").cast("bigint").alias("cand_id"),
                    round6("fitness").alias("fitness"), F.md5("text").alias("text_md5"))


@register("question_sets_model", sql=ORACLE["question_sets"])
def question_sets_model(spark, sf_dir):
    """M5 + F9 with a mining model: label, reason and five whole segments in the prompt."""
    groups, top = _mined_segments(spark, sf_dir)
    done = iss.mine_questions(top, dims.rationale_df(spark), BackendFactory("miner", doubles.questions))
    qt = iss.question_table(done, groups.select("issue", F.col("first_key").alias("order_key")))
    return qt.filter(F.col("question").isNotNull()).select("issue", "issue_idx", "q_idx", "question")


# ---------------------------------------------------------------------------
# A1 in full, B13 report, F20, M1 + M2, S3 and S1 + S5 + P3 written and read back
# ---------------------------------------------------------------------------


@register("issue_segments", sql=f"""{_LABELED_SQL},
lab AS (SELECT doc_id, unnest(issues) AS issue FROM labeled)
SELECT l.issue, CAST(row_number() OVER (PARTITION BY l.issue ORDER BY l.doc_id) - 1 AS BIGINT) AS pos, l.doc_id, md5(d.text) AS segment_md5
FROM lab l JOIN documents d ON d.doc_id = l.doc_id WHERE l.issue <> ''
""")
def issue_segments(spark, sf_dir):
    """A1: the segments of every issue, in order."""
    r = iss.issue_segments(_labeled(spark, sf_dir), "doc_id", "text")
    return r.select("issue", F.col("pos").cast("bigint").alias("pos"), "doc_id", F.md5("segment").alias("segment_md5"))


@register("issues_without_template", sql=f"""{_GROUPS_SQL},
tpl AS (SELECT regexp_replace({q.normalize_label('template_key')}, '^\\W+', '') AS issue FROM {_TPL_SQL})
SELECT issue, n_segments FROM groups g WHERE NOT EXISTS (SELECT 1 FROM tpl t WHERE t.issue = g.issue)
""")
def issues_without_template(spark, sf_dir):
    """Labels that no template fits, which the feedback stage leaves out."""
    g = iss.group_by_issue(_labeled(spark, sf_dir), "doc_id")
    return iss.missing_templates(g, dims.templates_df(spark)).select(
        "issue", F.col("n_segments").cast("bigint").alias("n_segments"))


@register("label_multi_hot", sql=f"""{_GROUPS_SQL},
v AS (SELECT list(issue ORDER BY issue) AS vocab FROM groups WHERE n_segments > 5)
SELECT doc_id, array_to_string(list_transform(vocab, lambda x: CAST(list_contains(issues, x) AS INTEGER)), '') AS hot FROM labeled, v
""")
def label_multi_hot(spark, sf_dir):
    """F20 over the sorted vocabulary of supported issues."""
    lab = _labeled(spark, sf_dir)
    vocab = iss.supported(iss.group_by_issue(lab, "doc_id")).select(F.array_sort(F.collect_list("issue"))).scalar()
    hot = lab.select("doc_id", "issues", vocab.alias("vocab")).select("doc_id", multi_hot("issues", "vocab").alias("h"))
    return hot.select("doc_id", F.array_join(F.transform("h", lambda x: x.cast("string")), "").alias("hot"))


@register("tags_independent", sql=f"""
WITH f AS (SELECT conv_id, turn, {q.sentence_features('text')} AS f FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, {q.rules_section("''", 'f')} AS section_pred, {q.rules_bio("''", 'f')} AS bio_pred FROM f
""")
def tags_independent(spark, sf_dir):
    """M1 + M2: every sentence tagged on its own."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    return tagging.tag_rows_independent(conv, "text").select("conv_id", "turn", "section_pred", "bio_pred")


@register("question_store", sql=ORACLE["question_sets"])
def question_store(spark, sf_dir):
    """S3: question sets saved per model name and loaded back."""
    path = shared_path(spark, "questions")
    sio.write_questions(question_sets(spark, sf_dir), path, "rules/v1")
    return sio.read_questions(spark, path, "rules/v1").drop("model")


@register("question_sets_resumed", sql=ORACLE["question_sets"])
def question_sets_resumed(spark, sf_dir):
    """M0 + S3: a run that mined every other issue left its completions in a store; this one asks for the rest only."""
    groups, top = _mined_segments(spark, sf_dir)
    store = CompletionStore(shared_path(spark, "completions"), "miner/v1")
    reasons, miner = dims.rationale_df(spark), BackendFactory("miner", doubles.questions)
    iss.mine_questions(top.filter(F.crc32(F.col("issue").cast("binary")) % 2 == 0), reasons, miner, store=store)
    done = iss.mine_questions(top, reasons, miner, store=store)
    qt = iss.question_table(done, groups.select("issue", F.col("first_key").alias("order_key")))
    return qt.filter(F.col("question").isNotNull()).select("issue", "issue_idx", "q_idx", "question")


@register("review_tsv", sql="""
SELECT CAST(conv_id AS VARCHAR) AS id, text AS sentence, count(*) AS n FROM conversations GROUP BY ALL
""")
def review_tsv(spark, sf_dir):
    """S5 + S1 + P3: sentences written as TSV (multi-line cells, quotes), read
    back with the fixed schema; row ids are unique."""
    conv = table(spark, sf_dir, "conversations")
    path = shared_path(spark, "review-tsv")
    sio.write_tsv(conv.select(F.col("conv_id").cast("string").alias("ID"), F.col("text").alias("Review Segment"),
                              F.col("role").alias("Combined Issue Types")), path)
    back = sio.with_row_id(sio.read_tsv(spark, path, sio.ISSUE_SEGMENTS))
    return back.groupBy(F.col("ID").alias("id"), F.col("Review Segment").alias("sentence")).agg(F.count_distinct("row_id").alias("n"))
