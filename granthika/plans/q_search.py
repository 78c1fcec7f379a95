"""Queries: vector and lexical search with priors, caps, merges, evidence and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer as A
from ..operators import lexical as X
from ..operators import search as V
from ..sources.tables import cut
from ..sources.tables import table as t
from . import q_text as _text
from . import sql as Q

#: Embedded rows whose id is divisible by this are queries against all rows.
EVERY = 100
P = V.SearchParams(k=10)
#: Ids of found chunks that are broadcast, so that only the texts of these are shuffled.
FOUND_IDS = 500_000


def chunks(s, d):
    """Each chunk once: rows that stand twice are equal in full."""
    return t(s, d, "chunks").dropDuplicates(["chunk_id"])


def questions(s, d):
    """Stated query set: the questions whose id is divisible by 100."""
    q = t(s, d, "proper_manual_qacite").filter(f"qa_id % {EVERY} = 0 and question is not null")
    lang, _ = T.query_language(F.col("question"))
    return q.select(F.col("qa_id").alias("query_id"), F.col("question").alias("query"), lang.alias("query_lang"), F.lit("auto").alias("prefer"))


def w2_nearest(s, d):
    e = t(s, d, "embeddings")
    v = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), V.norm(F.col("embedding")).alias("norm"))
    q = v.filter(f"row_id % {EVERY} = 0").select(F.col("row_id").alias("query_id"), F.col("vec").alias("q_vec"), F.col("norm").alias("q_norm"))
    n = V.nearest(q, v, 30)
    return n.select("query_id", "row_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def nearby(s, d, params=P):
    """The 3k nearest chunks of the chunks that the stated questions cite, with what scores need."""
    c = t(s, d, "chunks").filter("embedding is not null").withColumn("row_id", F.col("chunk_id")).withColumn("vec", F.col("embedding")).withColumn("norm", V.norm(F.col("embedding"))).filter("norm > 0")
    q = t(s, d, "proper_manual_qacite").filter(f"qa_id % {EVERY // 10} = 0").select(F.col("qa_id").cast("string").alias("query_id"), "chunk_id", "question")
    lang, _ = T.query_language(F.coalesce("question", F.lit("")))
    q = q.select("query_id", "chunk_id", lang.alias("query_lang"), T.is_tabular(F.coalesce("question", F.lit(""))).alias("tabular"), F.coalesce("question", F.lit("")).alias("question"))
    q = c.select("chunk_id", "vec", "norm").join(q, "chunk_id").dropDuplicates(["query_id"]).select("query_id", F.col("vec").alias("q_vec"), F.col("norm").alias("q_norm"), "query_lang", "tabular", "question")
    near = V.nearest(q, c.select("row_id", "vec", "norm"), params.over_retrieve * params.k).withColumnRenamed("row_id", "chunk_id").drop("rank")
    rows = c.drop("embedding", "vec", "norm", "row_id", "text").dropDuplicates(["chunk_id"])
    return near.join(rows, "chunk_id").join(q.select("query_id", "query_lang", "tabular", "question"), "query_id")


def candidates(s, d, params=P):
    """Chunk candidates of the stated questions, with priors."""
    return V.scored(nearby(s, d, params), params)


def searched(pairs, params=P):
    """One search over given pairs: scores, caps, and the authoritative results in order."""
    c = V.diversified(V.scored(pairs, params).withColumn("score", F.round("score", 6)))
    return c.filter("source_authority = 'authoritative'").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def k4_priors(s, d):
    return candidates(s, d).select("query_id", "chunk_id", F.round("base_score", 6).alias("base_score"), F.round("prior", 6).alias("prior"))


def w1_diversified(s, d):
    c = candidates(s, d).withColumn("score", F.round("score", 6))
    return V.diversified(c).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def w3_split(s, d):
    c = V.diversified(candidates(s, d).withColumn("score", F.round("score", 6)))
    return V.split_and_cap(c, 5, 2).select("query_id", "chunk_id", "is_authoritative", F.col("rank").cast("long").alias("rank"))


def w4_fallback_merge(s, d):
    """Where the authoritative results fall short of the question's threshold, a second search in the other language, at a price, is merged."""
    pairs, k = cut(nearby(s, d)), P.k
    first = searched(pairs).filter(f"nth <= {k}")
    limits = cut(_text.l20_fallback_threshold(s, d)).select(F.col("query_id").cast("string").alias("query_id"), "threshold")
    found = pairs.select("query_id", "query_lang").distinct().join(first.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").join(limits, "query_id")
    short = found.filter((F.coalesce("n", F.lit(0)) / k < F.col("threshold")) & (F.col("query_lang") != "mixed")).select("query_id")
    other = pairs.join(short, "query_id").withColumn("query_lang", F.when(F.col("query_lang") == "ne", "en").otherwise("ne"))
    second = searched(other, V.SearchParams(k=k, cross_penalty=0.2)).filter(f"nth <= {k}")
    m = V.merge_fallback(*(x.select("query_id", "chunk_id", "score") for x in (first, second)))
    return m.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("source_no").cast("long").alias("source_no"), F.col("rank").cast("long").alias("rank"))


def w5_bilingual_merge(s, d):
    """A search in each language, the first half of each, one result a place."""
    pairs, out = cut(nearby(s, d)), None
    for lang in ("ne", "en"):
        part = searched(pairs.withColumn("query_lang", F.lit(lang))).withColumn("language", F.lit(lang))
        out = part if out is None else out.unionByName(part)
    c = out.withColumn("bbox_text", F.concat_ws(",", F.transform("bbox", lambda x: x.cast("decimal(10,1)").cast("string"))))
    return V.merge_bilingual(c, P.k).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def a21_language_metrics(s, d):
    m = V.language_metrics(V.diversified(candidates(s, d).withColumn("score", F.round("score", 6))))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("consistency", "cross_5", "cross_10")])


def a13_purity(s, d):
    return V.purity(V.diversified(candidates(s, d).withColumn("score", F.round("score", 6)))).select("query_id", F.round("purity", 6).alias("purity"), "considered")


def w7_fusion(s, d):
    """One score of a candidate over the searches in both languages."""
    pairs, out = cut(nearby(s, d)), None
    for lang in ("ne", "en"):
        part = V.scored(pairs.withColumn("query_lang", F.lit(lang)), P).select("query_id", "chunk_id", F.round("score", 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return V.fused(out, "max").withColumn("fused_score", F.round("fused_score", 6))


def w6_rerank(s, d):
    c = V.diversified(candidates(s, d).withColumn("score", F.round("score", 6))).withColumn("rerank_score", F.coalesce("quality_score", F.lit(0.5)))
    return V.reranked(c, 5).select("query_id", "chunk_id", F.col("new_rank").cast("long").alias("new_rank"))


def _lexical(variant, prefer="auto"):
    def run(s, d):
        r = X.lexical_search(questions(s, d).withColumn("prefer", F.lit(prefer)), t(s, d, "chunks"), variant, 10)
        return r.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))

    return run


def lexical_topk(s, d):
    """Flagship: lexical scores of the stated questions against all chunks, capped by page and document."""
    r = X.lexical_search(questions(s, d), t(s, d, "chunks"), "dynamic", 60).drop("rank").withColumn("score", F.round("score", 6))
    return V.diversified(r).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def results(s, d):
    """Search of the stated questions: diversified candidates in order."""
    return V.diversified(candidates(s, d).withColumn("score", F.round("score", 6)))


def evidence(s, d, found=None):
    """Spans of the authoritative ones of the first ten results of every question, in the order of the results: the cited spans of a chunk, else all of it.

    `found`: results that are kept as a table, which can be asked for their ids first."""
    hits = (results(s, d) if found is None else found).filter("rank <= 10").withColumnRenamed("rank", "hit")
    texts = chunks(s, d)
    if found is not None:
        ids = hits.select("chunk_id").distinct()
        if ids.count() <= FOUND_IDS:
            texts = t(s, d, "chunks").join(F.broadcast(ids), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    e = hits.join(texts.select("chunk_id", "text"), "chunk_id").filter(A.is_authority(F.lit(False), F.col("source_authority"), F.col("doc_id"), F.col("text")))
    sp = A.spans(e.join(t(s, d, "proper_manual_qacite").select("chunk_id", "qa_id", "char_spans"), "chunk_id", "left"))
    return sp.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("hit", "qa_id", "start_char", "end_char")))


def f7_f15_spans(s, d):
    return evidence(s, d).select("query_id", "qa_id", "start_char", "end_char", F.md5("span_text").alias("h"), F.col("rank").cast("long").alias("rank"))


def f14_preferred(s, d):
    return A.preferred(evidence(s, d)).select("query_id", F.col("rank").cast("long").alias("rank"), "same", "fallback_used")


def w8_round_robin(s, d):
    return A.round_robin(evidence(s, d)).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("pick").cast("long").alias("pick"))


def w9_w21_domain_order(s, d):
    """The domain is that of the question."""
    return A.domain_order(A.round_robin(evidence(s, d)), A.domain_of(F.col("question"))).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("hits").cast("long").alias("hits"), "is_table", F.col("place").cast("long").alias("place"))


def w10_k15_best_per_document(s, d):
    e = evidence(s, d).withColumn("quality", F.round(A.evidence_quality(F.col("span_text"), F.coalesce("language", F.lit("")), F.col("query_lang"), A.domain_of(F.col("question"))), 6))
    return A.one_per_document(e).select("query_id", "quality", F.col("rank").cast("long").alias("rank"), F.col("pick").cast("long").alias("pick"))


def asked(s, d):
    """The questions that are searched, with their language."""
    q = t(s, d, "proper_manual_qacite").filter(f"qa_id % {EVERY // 10} = 0")
    return q.select(F.col("qa_id").cast("string").alias("query_id"), T.query_language(F.coalesce("question", F.lit("")))[0].alias("query_lang"))


def x20_f16_answers(s, d):
    """Question to answer: search, evidence in the preferred language, pages in turn, synthesis with citations or a refusal."""
    e = A.round_robin(A.preferred(evidence(s, d)))
    return A.answers(asked(s, d), e).select("query_id", F.md5("answer").alias("h"), "is_refusal", "evidence_count")


def u4_citation_union(s, d):
    e = cut(evidence(s, d).select("query_id", "doc_id", "page_id", "start_char", "end_char", "rank"))
    a = e.filter("rank <= 5").select("query_id", "doc_id", "page_id", "start_char", "end_char", F.lit(0).alias("side"), "rank")
    u = a.unionByName(e.filter("rank between 3 and 9").select("query_id", "doc_id", "page_id", "start_char", "end_char", F.lit(1).alias("side"), "rank"))
    w = Window.partitionBy("query_id", "doc_id", "page_id", "start_char", "end_char").orderBy("side", "rank")
    return u.withColumn("_r", F.row_number().over(w)).filter("_r = 1").groupBy("query_id").agg(F.count("*").alias("n"))


def w14_sentences(s, d):
    q = X.with_query_features(t(s, d, "proper_manual_qacite").filter("question is not null").select(F.col("qa_id").alias("query_id"), F.col("question").alias("query"), "chunk_id"))
    c = chunks(s, d).select("chunk_id", "text")
    r = X.sentence_ranking(q.join(c, "chunk_id"))
    return r.select("query_id", F.col("pos").cast("long").alias("pos"), F.round("share", 6).alias("share"), F.col("rank").cast("long").alias("rank"))


def a28_a29_coverage(s, d):
    """Results of each document by question, with the confidence of the answer."""
    r = X.lexical_search(questions(s, d), t(s, d, "chunks"), "intelligent", 10)
    sure = F.round(F.least(F.avg("score").over(Window.partitionBy("query_id")) / 25.0, F.lit(1.0)), 6)
    return r.withColumn("confidence", sure).groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.first("confidence").alias("confidence"))


# --- SQL ------------------------------------------------------------------------------------------------------------

_C = "(select distinct on (chunk_id) * from chunks)"
_DOT = "list_sum(list_transform(list_zip({a},{b}),lambda z: z[1]::double*z[2]::double))"
_LANG = f"case when length({Q.trim('question')})=0 then 'mixed' when {Q.ratio('question')}>0.7 then 'ne' when {Q.ratio('question')}<0.05 then 'en' else 'mixed' end"
_QS = f"(select qa_id query_id, question query, {_LANG} query_lang, lower(question) q from proper_manual_qacite where qa_id%100=0 and question is not null)"


def _dot(a, b):
    return _DOT.format(a=a, b=b)


_TAB = f"({Q.cnt('question', '[0-9०-९]')}::double/greatest(length(question),1)>0.08 or " + Q.any_in("lower(question)", (*T.TABLE_WORDS, "how many")) + ")"
_V = f"(select *, sqrt({_dot('embedding', 'embedding')}) nn from {_C} where embedding is not null)"
_CQ = f"(select qa_id::varchar query_id, question, c.embedding qv, c.nn qn, {_LANG} query_lang, {_TAB} tabular from (select qa_id, chunk_id, coalesce(question,'') question from proper_manual_qacite where qa_id%10=0) join {_V} c using (chunk_id) where c.nn>0)"
_NEAR = f"(select * from (select *, row_number() over (partition by query_id order by cosine desc, chunk_id) rn from (select q.query_id, q.query_lang, q.tabular, q.question, c.*, {_dot('c.embedding', 'q.qv')}/(q.qn*c.nn) cosine from {_V} c, {_CQ} q where c.nn>0 and c.chunk_id<>q.query_id)) where rn<=30)"
_PRIOR = """((case when query_lang<>'mixed' and language=query_lang then 0.15::double*coalesce(language_confidence,1.0::double) when query_lang<>'mixed' and coalesce(language,'')<>'mixed' and coalesce(language,'')<>query_lang then -0.03::double else 0.0::double end)
 +(case when source_authority='authoritative' then 0.08::double else 0.0::double end)+(case quality_tier when 'high' then 0.06 when 'medium' then 0.02 when 'low' then -0.02 when 'recovery' then -0.04 else 0.0 end)::double
 -(case when has_watermark then 0.05::double else 0.0::double end)-(case when conf_mean is null then 0.0 when conf_mean<30 then 0.08 when conf_mean<50 then 0.05 when conf_mean<70 then 0.02 else 0.0 end)::double
 +(case when tabular and chunk_type='table' then 0.04::double else 0.0::double end)-(case when is_reconstructed and reconstruction_score<0.5 then 0.02::double else 0.0::double end)-(case when token_count<10 then 0.02 when token_count>800 then 0.01 else 0.0 end)::double)"""
_CAND = f"(select *, 2*cosine-1 base_score, {_PRIOR} prior, round(2*cosine-1+{_PRIOR},6) score from {_NEAR})"
_DIV = f"""(select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rk from (select *, row_number() over (partition by query_id, doc_id order by score desc, chunk_id) rd from
 (select * from (select *, row_number() over (partition by query_id, page_id order by score desc, chunk_id) rp from {_CAND}) where rp<=3 or score>1.5)) where rd<=5 or score>1.5) where rk<=20)"""


def _div_of(near, price):
    """The search over given pairs, with a price for the other language."""
    cross = f"(case when coalesce(language,'')<>query_lang then {price}::double else 0.0::double end)"
    return _DIV.replace(_CAND, f"(select *, 2*cosine-1 base_score, {_PRIOR} prior, round(2*cosine-1+{_PRIOR}-{cross},6) score from {near})")


def _phr(longest, base, each):
    tok = Q.tok("q")
    return f"list_sum(list_transform(list_filter(flatten(list_transform(range(1,greatest(len({tok}),2)),lambda i: list_transform(range(2,{longest}+1),lambda k: {{'p': case when i+k-1<=len({tok}) then array_to_string({tok}[i:(i+k-1)],' ') end,'k':k}}))),lambda z: z.p is not null and contains(t,z.p)),lambda z: {base}::double+z.k*{each}::double))"


_WORDSET = "list_distinct(regexp_extract_all({x},'[\\p{{L}}\\p{{N}}_]+'))"
_QW, _TW = _WORDSET.format(x="q"), _WORDSET.format(x="t")
_PAIR = f"(select q.*, c.chunk_id, c.doc_id, c.page_id, c.source_authority, c.text, c.language, lower(c.text) t, lower(c.doc_id) d from {_C} c, {_QS} q)"
_BOTH = f"(select *, {_QW} qw, {_TW} tw from {_PAIR})"
_JAC = "(case when len(qw)>0 and len(tw)>0 then len(list_intersect(qw,tw))::double/(len(qw)+len(tw)-len(list_intersect(qw,tw))) else 0.0::double end)"
_COV = "(case when len(qw)>0 and len(tw)>0 then len(list_intersect(qw,tw))::double/len(qw) else 0.0::double end)"
_TCOV = f"(case when len({Q.tok('q')})>0 then len(list_intersect(list_distinct({Q.tok('q')}),list_distinct({Q.tok('t')})))::double/len(list_distinct({Q.tok('q')})) else 0.0::double end)"


def _w(cond, a, b="0.0"):
    return f"(case when {cond} then {a}::double else {b}::double end)"


_K8 = "+".join([
    _w("contains(t,q)", "25.0"), f"coalesce({_phr(5, 5.0, 2.0)},0.0::double)", f"{_JAC}*15.0::double", f"{_COV}*10.0::double",
    "(" + "+".join(f"(case when {Q.any_in('q', a)} then " + "+".join(f"contains(t,'{w}')::int" for w in ws) + " else 0 end)" for a, ws in X.CONTEXT) + ")*3.0::double",
    _w("regexp_matches(text,'\\([0-9०-९]+\\)')", "4.0"), _w("regexp_matches(t,'(article|section|chapter) [0-9०-९]+')", "3.0"), _w("regexp_matches(text,'[a-z]\\)[ \\t\\n\\x0B\\f\\r]|[0-9]+\\.[ \\t\\n\\x0B\\f\\r]')", "2.0"),
    "(case when length(text) between 100 and 1000 then 2.0 when length(text)>1000 then 1.0 else 0.0 end)::double",
])


def _lang2(c):
    return f"case when {Q.letters(c)}=0 then 'en' when ({Q.dev(c)}+2*(" + "+".join(f"contains(lower({c}),'{p}')::int" for p in T.ROMANISED) + f"))::double/{Q.letters(c)}>0.3 then 'ne' else 'en' end"


_K9 = "+".join([
    _w(f"({_lang2('query')})=({_lang2('text')})", "15.0"), f"(case when {Q.dev('query')}>0 and {Q.dev('text')}>0 then 50.0 when {Q.dev('query')}>0 then -30.0 else 0.0 end)::double",
    _w("contains(t,q)", "30.0"), f"coalesce({_phr(5, 8.0, 3.0)},0.0::double)", f"{_JAC}*20.0::double", f"{_COV}*15.0::double",
    _w("regexp_matches(text,'\\([0-9०-९]+\\)')", "5.0"), _w("regexp_matches(t,'(article|section|धारा) [0-9०-९]+')", "4.0"), _w(f"{Q.dev('text')}>0 and {Q.dev('text')}::double/length(text)>0.1", "10.0"),
])
_TOPIC = "(case " + " ".join(f"when {Q.any_in('q', ask)} then (case when {Q.any_in('d', ds)} then {a}::double" + (f" when {Q.any_in('t', ps)} then {b}::double" if ps else "") + " else 0.0::double end)" for ask, ds, ps, a, b in X.TOPICS) + " else 0.0::double end)"
_K11 = "+".join([_w("contains(t,q)", "20.0"), f"{_TCOV}*15.0::double", _TOPIC, "(case when length(text)>500 then 5.0 when length(text)>200 then 2.0 else 0.0 end)::double", _w("regexp_matches(text,'[0-9०-९]{4}')", "2.0"), _w("regexp_matches(t,'(article|section|chapter) [0-9०-९]+')", "3.0")])
_GOV = Q.any_in("q", ("governance", "political", "constitution"))
_K12a = "+".join([_w("contains(t,q)", "25.0"), f"coalesce({_phr(40, 10.0, 2.0)},0.0::double)", _w(f"{Q.any_in('q', X.GOVERNANCE)} and contains(d,'constitution')", f"(30.0::double+{_w(Q.any_in('t', X.GOVERNANCE_TEXT), '20.0')})"), f"{_TCOV}*12.0::double"])
_K12 = f"(select *, case when {_GOV} and {Q.any_in('t', X.MONEY)} and not {Q.any_in('t', ('governance', 'political', 'constitution'))} then s3*0.1::double else s3 end s4 from (select *, s2+(case when length(text)>500 then 3.0 when length(text)>200 then 1.0 else 0.0 end)::double+{_w(chr(114) + 'egexp_matches(t,' + chr(39) + '(article|section|chapter) [0-9०-९]+|\\([0-9०-९]+\\)' + chr(39) + ')', '4.0')} s3 from (select *, case when {Q.any_in('q', ('health', 'medical', 'hospital', 'covid'))} and {Q.any_in('d', ('health', 'covid', 'medical'))} then s1+15.0::double when {Q.any_in('q', ('health', 'medical', 'hospital', 'covid'))} and {_GOV} then s1*0.3::double else s1 end s2 from (select *, {_K12a} s1 from {_PAIR}))))"
_HITS = f"len(list_filter({Q.tok('q')},lambda w: contains(t,w)))"
_K13 = "+".join([_w("contains(t,q)", "10.0"), f"{_HITS}*1.0::double", f"(case when len({Q.tok('q')})>1 then {_HITS}::double/len({Q.tok('q')})*5.0::double else 0.0::double end)", _w(Q.any_in("t", ("constitution", "fundamental", "rights", "duties")) + " and " + Q.any_in("q", ("constitution", "fundamental", "rights")), "3.0"), _w(Q.any_in("t", ("health", "medical", "hospital", "treatment")) + " and " + Q.any_in("q", ("health", "medical", "hospital", "covid")), "3.0")])


def _top(score, source, bound, k=10):
    return f"select query_id, chunk_id, round(score,6) score, rn as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rn from (select *, {score} score from {source}) where score>{bound}) where rn<={k}"


_EV = f"""(select *, row_number() over (partition by query_id order by hit, qa_id nulls first, start_char, end_char) rank from (select *, (case when ok then s[1] else 0 end)::bigint start_char, (case when ok then least(s[2],length(text)) else length(text) end)::bigint end_char, case when ok then text[(s[1]+1):s[2]] else text end span_text from
 (select *, s is not null and s[2]>s[1] ok from (select v.query_id, v.query_lang, v.question, v.rk hit, q.qa_id, v.language, v.doc_id, v.page_id, v.chunk_id, v.source_authority, v.text, unnest(case when len(q.char_spans)>0 then q.char_spans else [null] end) s from {_DIV} v left join proper_manual_qacite q on q.chunk_id=v.chunk_id
 where v.rk<=10 and (coalesce(v.source_authority,'')='authoritative' or {Q.any_in('lower(v.doc_id)', A.AUTHORITY_IDS)}) and length({Q.trim('v.text')})>=30))))"""
_PREF = f"""(select * from (select *, share<0.6 and others>0 fallback_used, row_number() over (partition by query_id, crs order by rank) nth from (select *, avg(same::int) over (partition by query_id) share, sum(crs::int) over (partition by query_id) others from (select *, coalesce(language,'unknown')=query_lang same, coalesce(language,'unknown')<>query_lang and coalesce(language,'unknown')<>'unknown' crs from {_EV}))) where same or (fallback_used and crs and nth<=2))"""


def _robin(src):
    return f"(select * from (select *, row_number() over (partition by query_id order by turn, first_seen, rank) pick from (select *, row_number() over (partition by query_id, doc_id, page_id order by length(span_text) desc, rank) turn, min(rank) over (partition by query_id, doc_id, page_id) first_seen from {src})) where pick<=5)"


_DOM = "(case " + " ".join(f"when {Q.any_in('lower(question)', [w.lower() for w in ws])} then '{n}'" for n, ws in A.DOMAIN_WORDS.items()) + " else 'general' end)"


def _hits(of):
    return "(case " + _DOM + " " + " ".join(f"when '{n}' then " + "+".join(f"contains(lower(span_text),'{w.lower()}')::int" for w in ws) for n, ws in of.items()) + " else 0 end)"


_THRESHOLD = _text.QUERIES["l20_fallback_threshold"][1]
_HITS_G, _HITS_Q = _hits(A.DOMAIN_WORDS), _hits(A.QUALITY_WORDS)

QUERIES = {
    "w2_nearest": (w2_nearest, f"select query_id, row_id, round(cosine,6) cosine, rn as rank from (select *, row_number() over (partition by query_id order by cosine desc, row_id) rn from (select q.vec_id query_id, r.vec_id row_id, {_dot('q.embedding', 'r.embedding')}/(sqrt({_dot('q.embedding', 'q.embedding')})*sqrt({_dot('r.embedding', 'r.embedding')})) cosine from embeddings r, embeddings q where q.vec_id%100=0 and q.vec_id<>r.vec_id)) where rn<=30"),
    "k4_priors": (k4_priors, f"select query_id, chunk_id, round(base_score,6) base_score, round(prior,6) prior from {_CAND}"),
    "w1_diversified": (w1_diversified, f"select query_id, chunk_id, score, rk as rank from {_DIV}"),
    "w3_split": (w3_split, f"select query_id, chunk_id, is_authoritative, rk as rank from (select *, coalesce(source_authority='authoritative',false) is_authoritative, row_number() over (partition by query_id, source_authority='authoritative' order by rk) r from {_DIV}) where r<=case when is_authoritative then 5 else 2 end"),
    "w4_fallback_merge": (w4_fallback_merge, f"with one as (select *, row_number() over (partition by query_id order by rk) nth from {_DIV} where source_authority='authoritative'), short as (select query_id from (select distinct query_id, query_lang from {_NEAR}) left join (select query_id, count(*) n from one where nth<=10 group by 1) using (query_id) join (select query_id::varchar query_id, threshold from ({_THRESHOLD})) using (query_id) where coalesce(n,0)/10.0::double<threshold and query_lang<>'mixed'), two as (select *, row_number() over (partition by query_id order by rk) nth from {_div_of(chr(40) + 'select * replace (case when query_lang=' + chr(39) + 'ne' + chr(39) + ' then ' + chr(39) + 'en' + chr(39) + ' else ' + chr(39) + 'ne' + chr(39) + ' end as query_lang) from ' + _NEAR + chr(41), '0.2')} where source_authority='authoritative' and query_id in (select query_id from short)) select query_id, chunk_id, round(sc,6) score, src::bigint source_no, row_number() over (partition by query_id order by sc desc, chunk_id) rank from (select *, row_number() over (partition by query_id, chunk_id order by src) r from (select query_id, chunk_id, score sc, 0 src from one where nth<=10 union all select query_id, chunk_id, score-0.1::double, 1 from two where nth<=10)) where r=1"),
    "w5_bilingual_merge": (w5_bilingual_merge, "select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from (select *, row_number() over (partition by query_id, doc_id, page_id, b[1:50] order by score desc, chunk_id) p from (select *, array_to_string(list_transform(bbox,lambda v: v::decimal(10,1)::varchar),',') b, row_number() over (partition by query_id, lg order by score desc, chunk_id) h from (" + " union all ".join(f"select *, '{g}' lg from {_div_of(chr(40) + f'select * replace ({chr(39)}{g}{chr(39)} as query_lang) from {_NEAR})', '0.0')} where source_authority='authoritative'" for g in ("ne", "en")) + ")) where h<=5) where p=1) where rank<=10"),
    "a21_language_metrics": (a21_language_metrics, f"select query_id, round(avg((coalesce(language,'')=query_lang)::int),6) consistency, round(sum((rk<=5 and coalesce(language,'')<>query_lang)::int)::double/least(5,count(*)),6) cross_5, round(sum((rk<=10 and coalesce(language,'')<>query_lang)::int)::double/least(10,count(*)),6) cross_10 from {_DIV} group by 1"),
    "a13_purity": (a13_purity, f"select query_id, round(avg((source_authority='authoritative')::int),6) purity, count(*) considered from {_DIV} group by 1"),
    "w7_fusion": (w7_fusion, "select query_id, chunk_id, max(score) fused_score from (" + " union all ".join(f"select query_id, chunk_id, round(2*cosine-1+{_PRIOR},6) score from (select * replace ('{g}' as query_lang) from {_NEAR})" for g in ("ne", "en")) + ") group by 1,2"),
    "w6_rerank": (w6_rerank, f"select query_id, chunk_id, r new_rank from (select *, row_number() over (partition by query_id order by coalesce(quality_score,0.5) desc, rk) r from {_DIV}) where r<=5"),
    "k8_lexical_dynamic": (_lexical("dynamic"), _top(_K8, _BOTH, 3.0)),
    "k9_lexical_bilingual": (_lexical("bilingual"), _top(_K9, _BOTH, 1.0)),
    "k11_lexical_intelligent": (_lexical("intelligent", "ne"), _top(f"case when coalesce(language,'en')='ne' then ({_K11})+5.0::double else ({_K11})*0.8::double end", _PAIR, 1.0)),
    "k12_lexical_fixed": (_lexical("fixed", "en"), _top("case when coalesce(language,'en')='en' then s4+3.0::double else s4*0.9::double end", _K12, 2.0)),
    "k13_lexical_words": (_lexical("words"), _top(_K13, _PAIR, 0.0)),
    "lexical_topk": (lexical_topk, f"""select query_id, chunk_id, score, rk as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rk from (select *, row_number() over (partition by query_id, doc_id order by score desc, chunk_id) rd from (select * from (select *, row_number() over (partition by query_id, page_id order by score desc, chunk_id) rp from
      (select query_id, chunk_id, doc_id, page_id, round(score,6) score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rn from (select *, {_K8} score from {_BOTH}) where score>3.0) where rn<=60)) where rp<=3 or score>1.5)) where rd<=5 or score>1.5) where rk<=20"""),
    "f7_f15_spans": (f7_f15_spans, f"select query_id, qa_id, start_char, end_char, md5(span_text) h, rank from {_EV}"),
    "f14_preferred": (f14_preferred, f"select query_id, rank, same, fallback_used from {_PREF}"),
    "w8_round_robin": (w8_round_robin, f"select query_id, rank, pick from {_robin(_EV)}"),
    "w9_w21_domain_order": (w9_w21_domain_order, f"select query_id, rank, hits, is_table, row_number() over (partition by query_id order by hits desc, pick) place from (select *, ({_HITS_G})::bigint hits, {Q.any_in('lower(span_text)', A.TABLE_WORDS)} is_table from {_robin(_EV)})"),
    "w10_k15_best_per_document": (w10_k15_best_per_document, f"select query_id, quality, rank, pick from (select *, row_number() over (partition by query_id order by quality desc, rank) pick from (select *, row_number() over (partition by query_id, doc_id order by quality desc, rank) dd from (select *, round(least(1.0::double,0.5::double+least(0.3::double,length(span_text)/1000.0::double)+(case when coalesce(language,'')=query_lang then 0.2 when coalesce(language,'') in ('en','ne') then 0.1 else 0.0 end)::double+least(0.2::double,({_HITS_Q})*0.05::double)),6) quality from {_EV}) where quality>=0.3) where dd=1) where pick<=3"),
    "x20_f16_answers": (x20_f16_answers, f"""select m.query_id, md5(coalesce(answer,case when query_lang='ne' then 'पर्याप्त प्रमाण छैन।' else 'There is not enough evidence in the documents.' end)) h, answer is null is_refusal, coalesce(n,0) evidence_count from (select qa_id::varchar query_id, {_LANG} query_lang from (select qa_id, coalesce(question,'') question from proper_manual_qacite where qa_id%10=0)) m left join
      (select query_id, string_agg('• '||(case when length(span_text)>200 then span_text[1:197]||'...' else span_text end)||' [[doc:'||doc_id||'|page:'||regexp_extract(page_id,'_page_(\\d+)',1)::int||'|span:'||start_char||':'||end_char||']]',chr(10) order by pick) answer, count(*) n from {_robin(_PREF)} group by 1) e using (query_id)"""),
    "u4_citation_union": (u4_citation_union, f"select query_id, count(*) n from (select distinct query_id, doc_id, page_id, start_char, end_char from {_EV} where rank<=9) group by 1"),
    "w14_sentences": (w14_sentences, f"select query_id, pos, round(share,6) share, rank from (select *, row_number() over (partition by query_id order by share desc, pos) rank from (select query_id, pos, len(list_intersect(qw,{_WORDSET.format(x='lower(s)')}))::double/greatest(len(qw),1) share from (select query_id, qw, pos-1 pos, {Q.trim('s0')} s from (select qa_id query_id, {_WORDSET.format(x='lower(question)')} qw, unnest(regexp_split_to_array(c.text,'[.!?।॥]+')) s0, generate_subscripts(regexp_split_to_array(c.text,'[.!?।॥]+'),1) pos from proper_manual_qacite q join {_C} c on q.chunk_id=c.chunk_id where question is not null)) where length(s)>10) where share>0) where rank<=3"),
    "a28_a29_coverage": (a28_a29_coverage, f"select query_id, doc_id, count(*) n, any_value(c) confidence from (select *, round(least(avg(score) over (partition by query_id)/25.0::double,1.0::double),6) c from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rn from (select *, {_K11} score from {_PAIR}) where score>1.0) where rn<=10) group by 1,2"),
}
