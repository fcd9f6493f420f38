"""Question answering over workflows: search, evidence, scores, explanation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright import config
from loomwright.functions import rules as R
from loomwright.functions import text as X
from loomwright.functions import vectors as V
from loomwright.session import cut

#: Questions and index rows of a tile.
ASKED, ENTRIES = 2_048, 16_384


def _dense(lists: list, dim: int = R.EMBED_DIM) -> np.ndarray:
    """Embeddings of lists of buckets, a row each, of length 1; no words, all zero."""
    x = np.zeros((len(lists), dim))
    np.add.at(x, (np.repeat(np.arange(len(lists)), [len(b) for b in lists]), np.array([i for b in lists for i in b], dtype=np.int64)), 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def search(questions: DataFrame, entries: DataFrame, k: int, over: int = 3) -> DataFrame:
    """(question_id, workflow_id, vector_id, score, rank): the best ``over * k`` entries of each question, then the first of each workflow, at most k.

    ``questions`` (question_id, question) meet ``entries`` (workflow_id, vector_id,
    text) in the tiles of a block matrix, so every entry is scored; entries without
    a common bucket are no hits.
    """
    most = over * k
    nq, ne = (max(1, -(-df.count() // n)) for df, n in ((questions, ASKED), (entries, ENTRIES)))
    q = questions.select("question_id", V.buckets(F.col("question")).alias("buckets"), F.pmod(F.xxhash64("question_id"), F.lit(nq)).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ne - 1).cast("bigint"))).alias("j"))
    e = entries.select("workflow_id", "vector_id", V.buckets(F.col("text")).alias("buckets"), F.pmod(F.xxhash64("vector_id"), F.lit(ne)).alias("j"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))).alias("i"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, [("vector_id", "ascending")]))
        a, b = (_dense(t.column("buckets").to_pylist()) for t in (left, right))
        at, to, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for lo in range(0, len(a), 256) if len(b) else ():
            score = np.round(a[lo : lo + 256] @ b.T, 6)
            width = score.shape[1]
            bar = np.partition(score, width - most, axis=1)[:, width - most] if width > most else np.zeros(len(score))
            r, c = np.nonzero((score >= bar[:, None]) & (score > 0))
            order = np.lexsort((c, -score[r, c], r))
            r, c = r[order], c[order]
            keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(score)))[r] < most
            r, c = r[keep], c[keep]
            at, to, what = [*at, lo + r], [*to, c], [*what, score[r, c]]
        r, c = pa.array(np.concatenate(at)), pa.array(np.concatenate(to))
        return pa.table([left.column("question_id").take(r), right.column("workflow_id").take(c), right.column("vector_id").take(c), pa.array(np.concatenate(what))], names=["question_id", "workflow_id", "vector_id", "score"])

    found = q.groupBy("i", "j").cogroup(e.groupBy("i", "j")).applyInArrow(tile, "question_id string, workflow_id string, vector_id string, score double")
    top = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "vector_id"))
    best = found.withColumn("r", top).where(F.col("r") <= most)
    one = F.row_number().over(Window.partitionBy("question_id", "workflow_id").orderBy("r"))
    first = best.withColumn("w", one).where("w = 1")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("r"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "workflow_id", "vector_id", "score", "rank")


def nearest_entries(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): exact search of dense vectors, all entries scored, an entry of the query's own id left out.

    ``queries`` (query_id, query_vec) meet ``entries`` (vec_id, vec) in the tiles of
    a block matrix of bounded size, whatever the number of either.
    """
    nq, ne = (max(1, -(-df.count() // n)) for df, n in ((queries, ASKED), (entries, ENTRIES)))

    def dealt(df: DataFrame, name: str, vec: str, own: str, n: int, other: str, m: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
        return df.where(F.col(vec).isNotNull()).select(name, F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(name), F.lit(n)).alias(own), every.alias(other))

    q, e = dealt(queries, "query_id", "query_vec", "i", nq, "j", ne), dealt(entries, "vec_id", "vec", "j", ne, "i", nq)

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table([left.column("query_id").slice(0, 0), right.column("vec_id").slice(0, 0), pa.array([], pa.float64())], names=names)
        right = right.take(pc.sort_indices(right, [("vec_id", "ascending")]))
        a, b = (np.array(t.column("v").to_pylist()) for t in (left, right))
        asked, held = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        at, to, what = [], [], []
        for lo in range(0, len(a), 256):
            score = np.round(a[lo : lo + 256] @ b.T, 4)
            score[asked[lo : lo + 256, None] == held[None, :]] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            r, c = np.repeat(np.arange(len(score)), best.shape[1]), best.ravel()
            good = np.isfinite(score[r, c])
            at.append(lo + r[good]), to.append(c[good]), what.append(score[r, c][good])
        r, c = pa.array(np.concatenate(at)), pa.array(np.concatenate(to))
        return pa.table([left.column("query_id").take(r), right.column("vec_id").take(c), pa.array(np.concatenate(what))], names=names)

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {entries.schema['vec_id'].dataType.simpleString()}, score double"
    found = q.groupBy("i", "j").cogroup(e.groupBy("i", "j")).applyInArrow(tile, kinds)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def evidence(workflows: DataFrame, limit: int = 8) -> DataFrame:
    """(workflow_id, pos, sentence): the first ``limit`` distinct sentences that are no descriptions."""
    rows = workflows.select("workflow_id", F.posexplode("evidence_sources").alias("at", "e")).select("workflow_id", "at", X.strip(F.col("e.sentence")).alias("sentence")).distinct()
    rows = rows.where("sentence is not null").where(~X.looks_descriptive(F.col("sentence")))
    first = rows.groupBy("workflow_id", "sentence").agg(F.min("at").alias("at"))
    number = F.row_number().over(Window.partitionBy("workflow_id").orderBy("at", "sentence"))
    return first.withColumn("pos", number).where(F.col("pos") <= limit).select("workflow_id", "pos", "sentence")


def question_nodes(questions: DataFrame) -> DataFrame:
    """Adds lookup, phrases, hints, keywords to questions (question_id, question)."""
    q = F.col("question")
    return questions.withColumns({"lookup": X.is_lookup(q), "phrases": X.query_phrases(q), "hints": X.query_hints(q), "keywords": X.query_keywords(q)})


def query_labels(question: Column) -> Column:
    """Labels of the steps a question names: its phrase, its hints unless it is a lookup, else its keywords."""
    none = F.array().cast("array<string>")
    named = F.coalesce(F.array_distinct(F.concat(X.query_phrases(question), F.when(X.is_lookup(question), none).otherwise(X.query_hints(question)))), none)
    named = F.filter(named, lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, named).otherwise(X.query_keywords(question))


def lookup_adjustment(question: Column, title: Column, steps: Column) -> Column:
    """What a lookup of a weld or repair adds to a workflow's similarity, by its title and length; else 0."""
    q, t = F.lower(F.trim(question)), F.lower(F.coalesce(title, F.lit("")))
    field = F.when(t.contains("field repair") | t.contains("fuselage"), 0.35).otherwise(0.0)
    mount = F.when((t.contains("engine mount") | t.contains("bracket")) & ~q.rlike("engine|mount|bracket"), -0.25).otherwise(0.0)
    length = F.when(steps >= 6, 0.15).when(steps <= 4, -0.10).otherwise(0.0)
    return F.when(X.is_lookup(question) & q.rlike("weld|repair"), field + mount + length).otherwise(0.0)


def title_overlap(question: Column, haystack: Column) -> Column:
    """The larger of the share of the question's words that a text has, and of its phrases' score: 1 as it stands, 0.75 with all its words."""
    asked, held = F.array_distinct(X.tokens(question)), X.tokens(haystack)
    share = F.size(F.array_intersect(asked, held)) / F.size(asked)
    low = F.lower(haystack)
    phrases = F.transform(X.query_phrases(question), lambda p: F.when(F.instr(low, p) > 0, 1.0).when(F.size(F.array_except(F.split(p, " "), held)) == 0, 0.75).otherwise(0.0))
    best = F.greatest(share, F.coalesce(F.array_max(phrases), F.lit(0.0)))
    return F.when((F.size(asked) == 0) | (F.size(held) == 0), 0.0).otherwise(best)


def lookup_boost(question: Column, title: Column, steps: Column) -> Column:
    """The adjustment of lookups, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), lookup_adjustment(question, title, steps)))


def label_overlap(left: list[str], right: list[str], a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Set overlap of two label lists with embeddings a and b: Jaccard of their common clusters, blended with the share of left labels that are near a right one."""
    if not left or not right:
        return float(not left and not right)
    x, names = np.concatenate([a, b]), [*left, *right]
    leaders: list[int] = []
    ids = []
    for i in range(len(x)):
        hit = np.flatnonzero(x[leaders] @ x[i] >= threshold) if leaders else []
        if not len(hit):
            leaders.append(i)
        ids.append(int(hit[0]) if len(hit) else len(leaders) - 1)
    p, q = set(ids[: len(left)]), set(ids[len(left) :])
    s, t = ({names[leaders[c]] for c in z} for z in (p, q))
    hard = max(len(p & q) / len(p | q), len(s & t) / len(s | t))
    soft = float(((a @ b.T).max(axis=1) >= min(threshold, 0.45)).mean())
    return soft if hard <= 0 < soft else 0.6 * hard + 0.4 * soft if soft > hard else hard


def question_scores(pairs: DataFrame, settings: config.Similarity = config.Similarity()) -> DataFrame:
    """(question_id, workflow_id, blended) of pairs with their question, title_hint, texts and labels: semantic similarity and set overlap by ``query_weights``."""
    q, n = F.col("question"), F.size("labels")
    texts = F.when(F.size("texts") > 0, F.col("texts")).otherwise(F.when(n > 0, F.array(F.array_join("labels", " → "))).otherwise(F.array().cast("array<string>")))
    rows = pairs.withColumn("named", query_labels(q)).select(
        "question_id", "workflow_id", "named", "labels", V.buckets(q).alias("asked"), lookup_adjustment(q, F.col("title_hint"), n).alias("adjust"),
        *(F.transform(c, lambda t: V.buckets(t)).alias(x) for x, c in (("t", texts), ("a", F.col("named")), ("b", F.col("labels")))),
    )
    meaning, overlap = settings.query_weights

    def run(frames):
        for pdf in frames:
            blended = []
            for r in pdf.itertuples(index=False):
                near = float((_dense(r.t) @ _dense([r.asked])[0]).max()) + r.adjust if len(r.t) and len(r.asked) else r.adjust * bool(len(r.t))
                same = label_overlap(list(r.named), list(r.labels), _dense(r.a), _dense(r.b), settings.cluster_threshold)
                blended.append(round(meaning * max(0.0, min(1.0, near)) + overlap * same, 4))
            yield pd.DataFrame({"question_id": pdf["question_id"], "workflow_id": pdf["workflow_id"], "blended": blended})

    return rows.mapInPandas(run, "question_id string, workflow_id string, blended double")


def ranked_evidence(best: DataFrame, workflows: DataFrame, limit: int = 8) -> DataFrame:
    """(question_id, workflow_id, pos, sentence): the evidence of each question's workflow, or its steps' sentences or labels if it has none, closest to the question first."""
    said = F.transform("nodes", lambda n: F.when(F.coalesce(n["sentence"], F.lit("")) != "", n["sentence"]).otherwise(X.label(n["action"], n["object"])))
    own = F.when(F.size("evidence_sources") > 0, F.transform("evidence_sources", lambda e: e["sentence"])).otherwise(F.when(F.size("nodes") > 0, said))
    rows = best.select("question_id", "question", "workflow_id").join(workflows.select("workflow_id", own.alias("own")), "workflow_id")
    rows = rows.select("question_id", "question", "workflow_id", F.posexplode("own").alias("at", "s")).withColumn("sentence", X.strip(F.col("s"))).where("sentence <> ''").where(~X.looks_descriptive(F.col("sentence")))
    first = rows.groupBy("question_id", "question", "workflow_id", "sentence").agg(F.min("at").alias("at"))
    near = first.withColumn("near", F.round(V.bucket_cosine(V.buckets(F.col("question")), V.buckets(F.col("sentence"))), 6))
    number = F.row_number().over(Window.partitionBy("question_id", "workflow_id").orderBy(F.desc("near"), "at"))
    return near.withColumn("pos", number).where(F.col("pos") <= limit).select("question_id", "workflow_id", "pos", "sentence")


def answers(questions: DataFrame, hits: DataFrame, workflows: DataFrame, settings: config.Settings = config.Settings()) -> DataFrame:
    """(question_id, workflow_id, confidence, explanation): the workflow of the best blended score among a question's hits that reach ``min_score``, among all workflows where none does.

    The longer workflow wins ties, then the earlier hit. The explanation names
    title, chain length, confidence and up to five proofs.
    """
    keep = ("title_hint", "summary", "sections", "nodes", "evidence_sources")
    one = workflows.where("workflow_id is not null").groupBy("workflow_id").agg(F.min(F.struct(*keep)).alias("w")).select("workflow_id", *(F.col(f"w.{c}").alias(c) for c in keep))
    ordered = F.transform(F.array_sort(F.transform("nodes", lambda n: F.struct(n["ord"].alias("ord"), n["node_id"].alias("node_id"), X.label(n["action"], n["object"]).alias("label")))), lambda n: n["label"])
    texts = F.filter(F.array("summary", "title_hint", F.array_join("sections", " ")), lambda t: F.coalesce(t, F.lit("")) != "")
    shown = one.select("workflow_id", "title_hint", texts.alias("texts"), F.coalesce(ordered, F.array().cast("array<string>")).alias("labels"))

    good = cut(hits).where(F.col("score") >= settings.retrieval.min_score).select("question_id", "workflow_id", "rank")
    rest = questions.join(good, "question_id", "left_anti").select("question_id").crossJoin(one.select("workflow_id")).withColumn("rank", F.lit(None).cast("int"))
    pairs = good.unionByName(rest)
    scores = question_scores(pairs.join(questions, "question_id").join(shown, "workflow_id"), settings.similarity)
    told = scores.join(pairs, ["question_id", "workflow_id"]).join(shown.select("workflow_id", "title_hint", F.size("labels").alias("node_count")), "workflow_id")
    order = Window.partitionBy("question_id").orderBy(F.desc("blended"), F.desc("node_count"), "rank", "workflow_id")
    best = told.withColumn("place", F.row_number().over(order)).where("place = 1").join(questions, "question_id")

    proofs = ranked_evidence(best, one, settings.retrieval.evidence).where("pos <= 5")
    proofs = proofs.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " / ").alias("proof"))
    confidence = F.bround(F.col("blended") * 100).cast("int")
    text = F.concat(F.coalesce("title_hint", F.lit("untitled")), F.lit(": "), F.col("node_count").cast("string"), F.lit(" steps, "), confidence.cast("string"), F.lit("%; "), F.coalesce("proof", F.lit("no evidence")))
    return best.join(proofs, "question_id", "left").select("question_id", "workflow_id", confidence.alias("confidence"), text.alias("explanation"))
