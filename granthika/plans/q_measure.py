"""Queries: measures of retrieval, citations, faithfulness and language; statistics of corpus and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as K
from ..operators import answer as A
from ..operators import metrics as M
from ..sources.tables import cut
from ..sources.tables import table as t
from . import q_search as S
from . import sql as Q


def graded_by_chunk(s, d, c):
    """Candidates with a graded relevance: the chunk that the question's item cites is a match."""
    q = t(s, d, "proper_manual_qacite").select(F.col("qa_id").cast("string").alias("query_id"), F.col("chunk_id").alias("q_chunk"))
    return c.join(q, "query_id").withColumn("rel", M.graded(F.col("source_authority"), F.col("chunk_id") == F.col("q_chunk")))


def ranked(s, d):
    return graded_by_chunk(s, d, S.results(s, d))


def a11_ndcg(s, d):
    return M.ndcg(ranked(s, d)).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def a12_recall(s, d):
    return M.recall(ranked(s, d)).select("query_id", F.round("recall", 6).alias("recall"))


def a14_diversity(s, d):
    return M.diversity(ranked(s, d)).select("query_id", "docs", "pages", F.round("coverage", 6).alias("coverage"))


def a15_slices(s, d):
    return M.slices(ranked(s, d)).select("query_id", "field", "value", "n", F.round("purity", 6).alias("purity"), F.round("mean_rel", 6).alias("mean_rel"))


def _dataset(r):
    """Six measures with mean and deviation over the queries, and the number of all candidates."""
    per = M.ndcg(r).join(M.recall(r), "query_id").join(S.V.purity(r.filter("rank <= 10")).select("query_id", "purity"), "query_id").join(M.diversity(r), "query_id")
    n = r.groupBy("query_id").agg(F.count("*").alias("candidates"))
    return per.join(n, "query_id")


SIX = ("ndcg", "recall", "purity", "docs", "pages", "coverage")


def a17_dataset(s, d):
    """Six measures over the data set, all candidates, and shares of expanded and diversified queries by what the items say of it."""
    per = _dataset(cut(ranked(s, d)))
    m = per.agg(*[f for c in SIX for f in (F.round(F.avg(c), 6).alias(f"mean_{c}"), F.round(F.stddev_pop(c), 6).alias(f"std_{c}"))], F.sum("candidates").alias("candidates"))
    return m.crossJoin(F.broadcast(a31_usage(s, d)))


def a34_ablation(s, d):
    """The six measures by configuration of the search, on one set of scored candidates."""
    scored, out = cut(S.candidates(s, d).withColumn("score", F.round("score", 6))), None
    for name, per_page in (("tight", 1), ("default", 3)):
        per = _dataset(graded_by_chunk(s, d, S.V.diversified(scored, params=S.V.SearchParams(per_page=per_page))))
        part = per.agg(F.lit(name).alias("config"), *[F.round(F.avg(c), 6).alias(c) for c in SIX], F.sum("candidates").alias("candidates"))
        out = part if out is None else out.unionByName(part)
    return out


def measured(s, d):
    """(metric, current) under the names of the gates, from one search: retrieval, citations, answers, language."""
    r = cut(ranked(s, d))
    e = cut(S.evidence(s, d, r.drop("rel", "q_chunk")))
    c = _cites(e)
    iou = M.span_iou(c, truth(s, d))
    own = t(s, d, "proper_manual_qacite").select(F.col("qa_id").cast("string").alias("query_id"), "chunk_id")
    cited = S.asked(s, d).join(own, "query_id").join(c.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1.0)), ["query_id", "chunk_id"], "left")
    answered = A.answers(S.asked(s, d), A.round_robin(A.preferred(e)))
    parts = {
        "ndcg_at_10": (M.ndcg(r), F.avg("ndcg")),
        "recall_at_10": (M.recall(r), F.avg("recall")),
        "authority_purity": (S.V.purity(r.filter("rank <= 10")), F.avg("purity")),
        "citation_precision": (c, F.avg((F.col("source_authority") == "authoritative").cast("double"))),
        "citation_recall": (cited, F.avg(F.coalesce("hit", F.lit(0.0)))),
        "refusal_rate": (answered, F.avg(F.col("is_refusal").cast("double"))),
        "language_consistency": (S.V.language_metrics(r), F.avg("consistency")),
        "char_iou": (iou, F.avg("char_iou")),
    }
    out = None
    for name, (df, value) in parts.items():
        part = df.agg(F.lit(name).alias("metric"), value.alias("current"))
        out = part if out is None else out.unionByName(part)
    return out


def cites(s, d):
    return _cites(S.evidence(s, d))


def _cites(e):
    return e.filter("rank <= 3").select(F.concat_ws("-", "query_id", F.col("rank").cast("string")).alias("cite_id"), "query_id", "qa_id", "chunk_id", "doc_id", A.page_of(F.col("page_id")).alias("page_num"), "start_char", "end_char", "source_authority")


def truth(s, d):
    """True spans: those of the answers, one row a span."""
    q = t(s, d, "proper_manual_qacite").select("doc_id", A.page_of(F.col("page_id")).alias("page_num"), F.explode("char_spans").alias("s"))
    return q.select("doc_id", "page_num", F.col("s")[0].cast("long").alias("t_start"), F.col("s")[1].cast("long").alias("t_end")).distinct()


def j6_k19_span_iou(s, d):
    return M.span_iou(cites(s, d), truth(s, d)).select("cite_id", F.round("char_iou", 6).alias("char_iou"))


def j7_box_iou(s, d):
    """Best overlap of the boxes of an item with those of the other items of its page."""
    q = t(s, d, "proper_manual_qacite").filter("size(bbox_list) > 0").select("qa_id", "page_id", F.col("bbox_list")[0].alias("box"))
    o = q.select(F.col("qa_id").alias("other"), "page_id", F.col("box").alias("o_box"))
    j = q.join(o, "page_id").filter("qa_id <> other")
    return j.groupBy("qa_id").agg(F.round(F.max(K.box_iou(F.col("box"), F.col("o_box"))), 6).alias("iou"))


def j5_cited_candidates(s, d):
    """Citations whose document and page are among the chunks."""
    c = t(s, d, "chunks").select("doc_id", A.page_of(F.col("page_id")).alias("page_num")).distinct()
    return cites(s, d).join(c, ["doc_id", "page_num"], "left_semi").select("cite_id")


def a18_citations(s, d):
    c = cut(cites(s, d))
    c = c.join(M.span_iou(c, truth(s, d)), "cite_id")
    valid = F.sum((F.col("source_authority") == "authoritative").cast("int"))
    return c.agg(F.count("*").alias("n"), F.round(valid / F.count("*"), 6).alias("precision"), F.round(F.avg("char_iou"), 6).alias("mean_iou"))


def x12_citations(s, d):
    e = S.A.round_robin(S.evidence(s, d))
    a = S.A.synthesised(e)
    return A.citations(a, "query_id", "answer").select("query_id", F.col("pos").cast("long").alias("pos"), "doc_id", "page_num", "start_char", "end_char")


def a19_faithfulness(s, d):
    found = cut(S.results(s, d).filter("rank <= 10").select("query_id", "rank", "chunk_id", "doc_id", "page_id", "source_authority"))
    e = cut(S.A.round_robin(S.evidence(s, d, found)).select("query_id", "pick", "source_authority", "doc_id", "page_id", "start_char", "end_char", "span_text"))
    a = e.groupBy("query_id").agg(F.count("*").alias("n_cites"), F.sum((F.col("source_authority") == "authoritative").cast("int")).alias("n_auth")).join(S.A.synthesised(e).select("query_id", "answer"), "query_id").withColumn("is_refusal", A.is_refusal(F.col("answer")))
    return M.faithfulness(a).select("query_id", F.round("faithfulness", 6).alias("faithfulness"), "claims", "supported")


def a20_refusals(s, d):
    """Refusals among the first 1, 3, 5 and 10 items and in all."""
    q = t(s, d, "proper_manual_qacite").select(F.col("qa_id").alias("ordinal"), (F.coalesce("answer_exact", F.lit("")) == "").alias("is_refusal"))
    return q.agg(*[F.round(M.refusals_at(None, k), 6).alias(f"at_{k}") for k in (1, 3, 5, 10)], F.round(F.avg(F.col("is_refusal").cast("double")), 6).alias("rate"))


def a22_language_analytics(s, d):
    """Language agreement and other languages in the first 5 and 10, over all questions and by the question's domain."""
    e = S.evidence(s, d).withColumn("domain", A.domain_of(F.col("question")))
    same = F.coalesce("language", F.lit("")) == F.col("query_lang")
    cross = lambda k: F.sum(F.when((F.col("rank") <= k) & ~same, 1).otherwise(0))
    g = e.groupBy("query_id", "domain").agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("share"), cross(5).alias("c5"), cross(10).alias("c10"))
    rate = lambda k: F.round(F.avg(F.when(F.col("n") >= k, F.col(f"c{k}") / float(k)).otherwise(0.0)), 6).alias(f"cross_{k}")
    both = g.withColumn("domain", F.explode(F.array(F.lit("all"), "domain")))
    return both.groupBy("domain").agg(F.count("*").alias("queries"), F.round(F.avg("share"), 6).alias("same_rate"), rate(5), rate(10))


def a23_shares(s, d):
    return M.shares(t(s, d, "proper_manual_qacite").select(F.coalesce("language", F.lit("none")).alias("language")), "language").select("language", "n", F.round("share", 6).alias("share"))


def a24_histogram(s, d):
    return M.histogram(t(s, d, "chunks").select("quality_score"), "quality_score")


def a25_describe(s, d):
    c = t(s, d, "chunks")
    return c.agg(F.round(F.avg("quality_score"), 6).alias("mean"), F.round(F.stddev_pop("quality_score"), 6).alias("std"), F.min("quality_score").alias("least"), F.max("quality_score").alias("most"), F.round(F.median("token_count"), 6).alias("median_tokens"))


def a1_corpus_statistics(s, d):
    b = t(s, d, "corpus_blocks")
    return b.groupBy("block_type").agg(F.count("*").alias("n"), F.count_if(F.col("source_page_is_ocr")).alias("ocr"), F.round(F.avg("conf_mean"), 6).alias("mean_conf"), F.sum("tokens").cast("long").alias("tokens"), F.round(F.avg(F.when(F.col("tokens") > 0, F.col("tokens"))), 6).alias("mean_tokens"))


def a2_document_stats(s, d):
    """A2: chunks, characters and commonest language (the smallest of ties) of each document."""
    c = t(s, d, "chunks")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.mode("language", deterministic=True).alias("language"))


def a6_a7_counts(s, d):
    m = t(s, d, "manifest")
    return m.groupBy("authority", "language_guess").agg(F.count("*").alias("n"))


def a5_verification(s, d):
    """A4, A5: files by what is unknown of them, with the first five ids."""
    m = t(s, d, "manifest").select("doc_id", F.when(F.col("title_guess").isNull() | F.col("year_guess").isNull(), "low").when(F.col("license").isNull(), "medium").otherwise("high").alias("confidence")).distinct()
    w = Window.partitionBy("confidence").orderBy("doc_id")
    first = m.withColumn("nth", F.row_number().over(w)).filter("nth <= 5").groupBy("confidence").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("first_ids"))
    return m.groupBy("confidence").agg(F.count("*").alias("n")).join(first, "confidence")


def a31_usage(s, d):
    q = t(s, d, "proper_manual_qacite")
    return q.agg(F.round(F.avg((F.size("expansion_terms_used") > 0).cast("double")), 6).alias("expanded"), F.round(F.avg(F.when(F.col("diversification_caps").isNotNull(), 1.0).otherwise(0.0)), 6).alias("capped"))


def k16_k18_enrichment(s, d):
    """Confidence, bin of recognition, reading time and reasons of each candidate, by its score."""
    c = t(s, d, "chunks").select("chunk_id", "text", "quality_score", "conf_mean", "source_authority", "language", "language_confidence").distinct()
    auth = F.coalesce(F.col("source_authority") == "authoritative", F.lit(False))
    conf = F.coalesce("language_confidence", F.lit(0.0)) * 0.4 + F.coalesce("quality_score", F.lit(0.5)) * 0.3 + F.coalesce(F.col("conf_mean") / 100.0, F.lit(0.8)) * 0.2 + F.when(auth, 1.0).otherwise(0.5) * 0.1
    why = F.concat_ws("; ", F.when(auth, "Authoritative document"), F.when(F.col("quality_score") > 0.8, "High quality content"), F.when(F.col("language").isin("en", "ne"), F.concat(F.lit("Native "), F.upper("language"), F.lit(" content"))))
    words = F.size(S.T.tokens(F.col("text")))
    return c.select("chunk_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)), 6).alias("confidence"), K.ocr_bin(F.col("conf_mean")).alias("ocr_bin"), K.reading_seconds(words).alias("seconds"), F.when(why == "", "Semantic similarity match").otherwise(why).alias("why"))


_R = f"(select c.*, case when c.chunk_id=q.q_chunk then 1.0 when source_authority='authoritative' then 0.8 when source_authority='wikipedia' then 0.3 else 0.0 end::double rel from {S._DIV} c join (select qa_id::varchar query_id, chunk_id q_chunk from proper_manual_qacite) q using (query_id))"
_R = _R.replace("(select c.*,", "(select c.* ,")
_ND = f"(select query_id, case when sum(rel/log2(ideal+1))>0 then sum(rel/log2(rk+1))/sum(rel/log2(ideal+1)) else 0.0 end ndcg from (select *, row_number() over (partition by query_id order by rel desc, rk) ideal from {_R} where rk<=10) group by 1)"
_RE = f"(select query_id, case when sum((rel>0)::int)>0 then sum((rel>0 and rk<=10)::int)::double/sum((rel>0)::int) else 0.0 end recall from {_R} group by 1)"
_PU = f"(select query_id, avg((source_authority='authoritative')::int) purity from {_R} where rk<=10 group by 1)"


def _di(r):
    return f"(select query_id, count(distinct case when rk<=10 then doc_id end) docs, count(distinct case when rk<=10 then page_id end) pages, (count(distinct case when rk<=10 then doc_id end)::double/count(distinct doc_id)+count(distinct case when rk<=10 then page_id end)::double/count(distinct page_id))/2 coverage, count(*) candidates from {r} group by 1)"


def _six(r):
    return f"({_ND.replace(_R, r)} join {_RE.replace(_R, r)} using (query_id) join {_PU.replace(_R, r)} using (query_id) join {_di(r)} using (query_id))"


_CI = f"(select query_id||'-'||rank cite_id, query_id, qa_id, chunk_id, doc_id, regexp_extract(page_id,'_page_(\\d+)',1)::int page_num, start_char, end_char, source_authority from {S._EV} where rank<=3)"
_TR = "(select distinct doc_id, page_num, s[1]::bigint t_start, s[2]::bigint t_end from (select doc_id, regexp_extract(page_id,'_page_(\\d+)',1)::int page_num, unnest(char_spans) s from proper_manual_qacite))"
_IOU = f"(select cite_id, max(coalesce(case when t_start is null or least(end_char,t_end)-greatest(start_char,t_start)<=0 or end_char<=start_char or t_end<=t_start then 0.0::double else (least(end_char,t_end)-greatest(start_char,t_start))::double/(greatest(end_char,t_end)-least(start_char,t_start)) end,0.0::double)) char_iou from {_CI} c left join {_TR} t using (doc_id,page_num) group by 1)"
_ROB = S._robin(S._EV)
_ANS = f"(select query_id, string_agg('• '||(case when length(span_text)>200 then span_text[1:197]||'...' else span_text end)||' [[doc:'||doc_id||'|page:'||regexp_extract(page_id,'_page_(\\d+)',1)::int||'|span:'||start_char||':'||end_char||']]',chr(10) order by pick) answer, count(*) n_cites, sum((source_authority='authoritative')::int) n_auth from {_ROB} group by 1)"
_REF = "(" + " or ".join([f"contains(lower(answer),'{w.replace(chr(39), chr(39) * 2)}')" for w in A.REFUSALS_EN] + [f"contains(answer,'{w}')" for w in A.REFUSALS_NE]) + ")"

QUERIES = {
    "a11_ndcg": (a11_ndcg, f"select query_id, round(ndcg,6) ndcg from {_ND}"),
    "a12_recall": (a12_recall, f"select query_id, round(recall,6) recall from {_RE}"),
    "a14_diversity": (a14_diversity, f"select query_id, count(distinct case when rk<=10 then doc_id end) docs, count(distinct case when rk<=10 then page_id end) pages, round((count(distinct case when rk<=10 then doc_id end)::double/count(distinct doc_id)+count(distinct case when rk<=10 then page_id end)::double/count(distinct page_id))/2,6) coverage from {_R} group by 1"),
    "a15_slices": (a15_slices, f"select query_id, field, value, count(*) n, round(avg((source_authority='authoritative')::int),6) purity, round(avg(rel),6) mean_rel from (select query_id, source_authority, rel, unnest(['ocr','type','confidence','watermark']) field, unnest([coalesce(source_page_is_ocr::varchar,'null'),chunk_type,case when conf_mean is null then 'None' when conf_mean>=80 then 'high' when conf_mean>=60 then 'medium' else 'low' end,case when has_watermark then 'has' else 'no' end]) as value from {_R}) group by all having count(*)>=3"),
    "a17_dataset": (a17_dataset, "select " + ", ".join(f"round(avg({c}),6) mean_{c}, round(stddev_pop({c}),6) std_{c}" for c in SIX) + f", sum(candidates)::bigint candidates, any_value(expanded) expanded, any_value(capped) capped from {_six(_R)}, (select round(avg((len(expansion_terms_used)>0)::int),6) expanded, round(avg((diversification_caps is not null)::int),6) capped from proper_manual_qacite)"),
    "a34_ablation": (a34_ablation, " union all ".join(f"select '{n}' config, " + ", ".join(f"round(avg({c}),6) {c}" for c in SIX) + f", sum(candidates)::bigint candidates from {_six(_R.replace('rp<=3', f'rp<={k}'))}" for n, k in (("tight", 1), ("default", 3)))),
    "j6_k19_span_iou": (j6_k19_span_iou, f"select cite_id, round(char_iou,6) char_iou from {_IOU}"),
    "j7_box_iou": (j7_box_iou, """select qa_id, round(max(case when w<=0 or h<=0 then 0.0::double else w*h/((a[3]-a[1])*(a[4]-a[2])+(b[3]-b[1])*(b[4]-b[2])-w*h) end),6) iou from (select *, least(a[3],b[3])-greatest(a[1],b[1]) w, least(a[4],b[4])-greatest(a[2],b[2]) h from (select x.qa_id, x.bbox_list[1] a, y.bbox_list[1] b from proper_manual_qacite x join proper_manual_qacite y on x.page_id=y.page_id and x.qa_id<>y.qa_id where len(x.bbox_list)>0 and len(y.bbox_list)>0)) group by 1"""),
    "j5_cited_candidates": (j5_cited_candidates, f"select cite_id from {_CI} where (doc_id,page_num) in (select doc_id, regexp_extract(page_id,'_page_(\\d+)',1)::int from chunks)"),
    "a18_citations": (a18_citations, f"select count(*) n, round(sum((source_authority='authoritative')::int)::double/count(*),6) as precision, round(avg(char_iou),6) mean_iou from {_CI} join {_IOU} using (cite_id)"),
    "x12_citations": (x12_citations, f"select query_id, i-1 pos, regexp_extract(x,'doc:([^|]+)',1) doc_id, regexp_extract(x,'page:(\\d+)',1)::bigint page_num, regexp_extract(x,'span:(\\d+)',1)::bigint start_char, regexp_extract(x,'span:\\d+:(\\d+)',1)::bigint end_char from (select query_id, unnest(regexp_extract_all(answer,'\\[\\[doc:[^|]+\\|page:\\d+\\|span:\\d+:\\d+\\]\\]')) x, generate_subscripts(regexp_extract_all(answer,'\\[\\[doc:[^|]+\\|page:\\d+\\|span:\\d+:\\d+\\]\\]'),1) i from {_ANS})"),
    "a19_faithfulness": (a19_faithfulness, f"select query_id, round(case when {_REF} then 1.0::double when n_cites=0 then 0.0::double else n_auth::double/n_cites end,6) faithfulness, c claims, least(c,n_auth)::bigint supported from (select *, len(list_filter(string_split(answer,'.'),lambda v: trim(v)<>'')) c from {_ANS})"),
    "a20_refusals": (a20_refusals, "select " + ", ".join(f"round(sum((qa_id<={k} and r)::int)::double/least({k},count(*)),6) at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(r::int),6) rate from (select qa_id, coalesce(answer_exact,'')='' r from proper_manual_qacite)"),
    "a22_language_analytics": (a22_language_analytics, f"select domain, count(*) queries, round(avg(sh),6) same_rate, round(avg(case when n>=5 then c5/5.0::double else 0.0::double end),6) cross_5, round(avg(case when n>=10 then c10/10.0::double else 0.0::double end),6) cross_10 from (select *, unnest(['all',dm]) as domain from (select query_id, {S._DOM} dm, count(*) n, avg((coalesce(language,'')=query_lang)::int) sh, sum((rank<=5 and coalesce(language,'')<>query_lang)::int) c5, sum((rank<=10 and coalesce(language,'')<>query_lang)::int) c10 from {S._EV} group by 1,2)) group by 1"),
    "a23_shares": (a23_shares, "select coalesce(language,'none') as language, count(*) n, round(count(*)::double/sum(count(*)) over (),6) share from proper_manual_qacite group by 1"),
    "a24_histogram": (a24_histogram, "select label, arg_max(n, bin) n from (select case when hi>lo then printf('%.2f-%.2f',lo+bin*w,lo+(bin+1)*w) else printf('%.2f',lo) end as label, bin, coalesce(n,0) n from (select *, (hi-lo)/5 w, unnest(case when hi>lo then range(5) else [0] end) bin from (select min(quality_score) lo, max(quality_score) hi from chunks)) left join (select case when hi>lo then " + "+".join(f"(quality_score>=lo+{i}*((hi-lo)/5))::int" for i in range(1, 5)) + " else 0 end bin, count(*) n from chunks, (select min(quality_score) lo, max(quality_score) hi from chunks) where quality_score is not null group by 1) using (bin)) group by 1"),
    "a25_describe": (a25_describe, "select round(avg(quality_score),6) mean, round(stddev_pop(quality_score),6) std, min(quality_score) least, max(quality_score) most, round(median(token_count),6) median_tokens from chunks"),
    "a1_corpus_statistics": (a1_corpus_statistics, "select block_type, count(*) n, count(*) filter (source_page_is_ocr) ocr, round(avg(conf_mean),6) mean_conf, sum(tokens)::bigint tokens, round(avg(case when tokens>0 then tokens end),6) mean_tokens from corpus_blocks group by 1"),
    "a2_document_stats": (a2_document_stats, "select doc_id, n chunks, c chars, l as language from (select doc_id, count(*) n, sum(length(text))::bigint c from chunks group by 1) left join (select doc_id, language l from (select doc_id, language, row_number() over (partition by doc_id order by count(*) desc, language) r from chunks where language is not null group by all) where r=1) using (doc_id)".replace("group by all", "group by doc_id, language")),
    "a6_a7_counts": (a6_a7_counts, "select authority, language_guess, count(*) n from manifest group by all"),
    "a5_verification": (a5_verification, "select confidence, count(*) n, array_to_string(list_sort(list(doc_id))[1:5],',') first_ids from (select distinct doc_id, case when title_guess is null or year_guess is null then 'low' when license is null then 'medium' else 'high' end confidence from manifest) group by 1"),
    "a31_usage": (a31_usage, "select round(avg((len(expansion_terms_used)>0)::int),6) expanded, round(avg((diversification_caps is not null)::int),6) capped from proper_manual_qacite"),
    "k16_k18_enrichment": (k16_k18_enrichment, f"select chunk_id, confidence, ocr_bin, seconds, case when why='' then 'Semantic similarity match' else why end why from (select distinct chunk_id, round(greatest(0.0::double,least(1.0::double,coalesce(language_confidence,0.0)*0.4::double+coalesce(quality_score,0.5)*0.3::double+coalesce(conf_mean/100.0::double,0.8::double)*0.2::double+(case when source_authority='authoritative' then 1.0 else 0.5 end)::double*0.1::double)),6) confidence, case when conf_mean is null then 'none' when conf_mean>=80 then 'high' when conf_mean>=60 then 'medium' else 'low' end ocr_bin, greatest(1,floor(len({Q.tok('text')})/200.0::double*60))::bigint as seconds, concat_ws('; ',case when source_authority='authoritative' then 'Authoritative document' end,case when quality_score>0.8 then 'High quality content' end,case when language in ('en','ne') then 'Native '||upper(language)||' content' end) why from chunks)"),
}

#: The measured metrics in SQL, for the gates.
MEASURED = "(" + " union all ".join(f"select '{n}' metric, ({q})::double cur" for n, q in {
    "ndcg_at_10": f"select avg(ndcg) from {_ND}",
    "recall_at_10": f"select avg(recall) from {_RE}",
    "authority_purity": f"select avg(purity) from {_PU}",
    "citation_precision": f"select avg((source_authority='authoritative')::int) from {_CI}",
    "citation_recall": f"select avg(coalesce(hit,0.0)) from (select qa_id::varchar query_id, chunk_id from proper_manual_qacite where qa_id%10=0) left join (select distinct query_id, chunk_id, 1.0 hit from {_CI}) using (query_id, chunk_id)",
    "refusal_rate": f"select avg(is_refusal::int) from ({S.QUERIES['x20_f16_answers'][1]})",
    "language_consistency": f"select avg(consistency) from (select query_id, avg((coalesce(language,'')=query_lang)::int) consistency from {S._DIV} group by 1)",
    "char_iou": f"select avg(char_iou) from {_IOU}",
}.items()) + ")"
