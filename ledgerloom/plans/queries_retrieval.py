"""Document chunks and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import identifiers
from ledgerloom.operators import cases, retrieval
from ledgerloom.plans.catalog import query
from ledgerloom.plans.fixtures import spread

# Sentences become headings, so the structural rules have something to split on.
_HEADED_SQL = "replace(text, '. ', '.' || chr(10) || '# ')"
SECTIONS_SQL = {
    "t_sections": f"""
select doc_id || '_' || section_no as section_id, doc_id, section_no, content from (
  select doc_id, unnest(parts) as content, unnest(range(len(parts))) as section_no from (
    select doc_id, string_split(regexp_replace({_HEADED_SQL}, '\\n(#{{1,3}}\\s)', chr(1) || '\\1',
           'g'), chr(1)) as parts from documents))
where trim(content, chr(32) || chr(10) || chr(9) || chr(13)) <> ''""",
}


def headed(fx):
    text = F.replace("text", F.lit(". "), F.lit(".\n# "))
    return spread(fx.raw("documents").select("doc_id", text.alias("text")))


def sections(fx):
    cut = retrieval.split_sections(headed(fx), "doc_id", "text")
    return cut.select(F.concat_ws("_", F.col("doc_id").cast("string"),
                                  F.col("section_no").cast("string")).alias("section_id"),
                      "doc_id", "section_no", "content")


@query("document_sections", """
select section_id, doc_id, section_no,
       md5(trim(content, chr(32) || chr(10) || chr(9) || chr(13))) as fingerprint
from t_sections""", SECTIONS_SQL)
def document_sections(fx):
    return sections(fx).select("section_id", "doc_id", "section_no",
                               F.md5("content").alias("fingerprint"))


@query("document_chunks")
def document_chunks(fx):
    chunks = retrieval.chunk_documents(headed(fx), "doc_id", "text")
    return chunks.select("chunk_id", "doc_id", "chunk_index", F.length("content").alias("length"),
                         "section", "sub_chunk")


@query("chunk_ingest_counts")
def chunk_ingest_counts(fx):
    chunks = retrieval.chunk_documents(fx.raw("documents").select("doc_id", "text"), "doc_id",
                                       "text")
    return retrieval.ingest_counts(chunks, "doc_id")


_STOP = ("'the', 'a', 'an', 'is', 'of', 'and', 'in', 'to', 'what', 'how', 'why', 'are', 'for'")


HITS_SQL = f"""
select question_id, section_id, score from (
  select question_id, section_id, score, row_number() over (partition by question_id
           order by score desc, section_id) as k
  from (
    select question_id, section_id, count(*) as score
    from (select distinct item_id as question_id, word from (
            select item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as word
            from benchmark) where word not in ({_STOP})) q
    join t_sections s on contains(lower(s.content), q.word)
    group by 1, 2))
where k <= 5"""


@query("keyword_search", HITS_SQL, SECTIONS_SQL)
def keyword_search(fx):
    questions = fx.raw("benchmark").select(F.col("item_id").alias("question_id"), "text")
    return retrieval.keyword_search(questions, sections(fx))


def _centroids(fx):
    vectors = fx.raw("embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("place", "x")).groupBy(
        "label", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"])
    return means.groupBy("label").agg(ordered.alias("vector")).select(
        F.col("label").cast("bigint").alias("query_id"), "vector")


@query("vector_search_label_centroids", """
select query_id, vector_id, round(score, 4) as score from (
  select *, row_number() over (partition by query_id order by score, vector_id) as k from (
    select c.label as query_id, v.vec_id as vector_id, sum((c.x - v.x) * (c.x - v.x)) as score
    from (select label, place, avg(x) as x from (
            select label, unnest(embedding)::double as x, unnest(range(64)) as place
            from embeddings) group by 1, 2) c
    join (select vec_id, unnest(embedding)::double as x, unnest(range(64)) as place
          from embeddings) v on v.place = c.place
    group by 1, 2))
where k <= 5""")
def vector_search_label_centroids(fx):
    vectors = fx.raw("embeddings").select(F.col("vec_id").alias("vector_id"),
                                          F.col("embedding").alias("vector"), "label")
    found = retrieval.vector_search(_centroids(fx), vectors)
    return found.withColumn("score", F.round("score", 4))


@query("vector_search_filtered", """
select query_id, vector_id, round(score, 4) as score from (
  select *, row_number() over (partition by query_id order by score, vector_id) as k from (
    select c.label as query_id, v.vec_id as vector_id, sum((c.x - v.x) * (c.x - v.x)) as score
    from (select label, place, avg(x) as x from (
            select label, unnest(embedding)::double as x, unnest(range(64)) as place
            from embeddings) group by 1, 2) c
    join (select vec_id, unnest(embedding)::double as x, unnest(range(64)) as place
          from embeddings where label < 3) v on v.place = c.place
    group by 1, 2))
where k <= 3""")
def vector_search_filtered(fx):
    vectors = fx.raw("embeddings").select(F.col("vec_id").alias("vector_id"),
                                          F.col("embedding").alias("vector"), "label")
    found = retrieval.vector_search(_centroids(fx), vectors, top_k=3, where=F.col("label") < 3)
    return found.withColumn("score", F.round("score", 4))


@query("question_evidence", f"""
with q as (select cast(item_id as varchar) as question_id,
                  'PAY_' || lpad(cast(item_id + 1 as varchar), 6, '0') as record_id
           from benchmark)
select question_id, source, count(*) as pieces from (
  select cast(question_id as varchar) as question_id, 'DOCUMENT' as source from ({HITS_SQL})
  union all
  select q.question_id, 'DATABASE' from q join t_payments p on p.payment_id = q.record_id
  union all
  select q.question_id, 'RECONCILIATION_ENGINE' from q
  join t_payments p on p.payment_id = q.record_id)
group by 1, 2""", SECTIONS_SQL)
def question_evidence(fx):
    """Sections, records and cases for questions that name a payment."""
    asked = fx.raw("benchmark").select(
        F.col("item_id").cast("string").alias("question_id"), "text",
        identifiers.mention(F.concat(F.lit("What about pay_"), F.lpad(
            (F.col("item_id") + 1).cast("string"), 6, "0"), F.lit("? "), "text")).alias("m"))
    questions = asked.select("question_id", F.col("m.id").alias("mentioned_id"),
                             F.col("m.kind").alias("kind"))
    records = fx.payments.select(
        F.lit("payment").alias("kind"), F.col("payment_id").alias("record_id"),
        F.to_json(F.struct("payment_id", "order_id", "amount", "status")).alias("record"))
    found = cases.reconcile_payments(fx.all()).select(
        F.lit("payment").alias("kind"), F.col("source_record_id").alias("record_id"),
        F.to_json(F.struct("status", "matched_record_id", "reason_codes")).alias("case"))
    cut = sections(fx)
    hits = retrieval.keyword_search(asked.select("question_id", "text"), cut)
    evidence = retrieval.assemble_evidence(questions, hits, cut.select("section_id", "content"),
                                           records, found)
    return evidence.groupBy("question_id", "source").agg(F.count(F.lit(1)).alias("pieces"))
