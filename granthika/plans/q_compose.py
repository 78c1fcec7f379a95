"""Queries: composed answers, spans, question sets, titles, further filters and joins, models behind interfaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compose as C
from ..operators import layout, ops
from ..operators import search as V
from ..sources import tables as S
from . import q_ingest as _I
from . import q_search as Z
from . import q_text as _X
from . import sql as Q

t = S.table


def pairs(s, d):
    """Each question with the text of its cited chunk."""
    q = t(s, d, "proper_manual_qacite").filter("question is not null").select(F.col("qa_id").alias("query_id"), F.col("question").alias("query"), "chunk_id", "doc_id", "answer_exact")
    return q.join(Z.chunks(s, d).select("chunk_id", "text"), "chunk_id")


def x6_relevant_portion(s, d):
    return C.relevant_portion(pairs(s, d)).select("query_id", F.md5("portion").alias("h"))


def x26_multi_source(s, d):
    """Answers of documents: the portions of the first four questions' chunks of each document."""
    from pyspark.sql import Window

    p = C.relevant_portion(pairs(s, d)).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("query_id"))).withColumn("score", F.length("portion") / 10.0)
    r = C.multi_source_answer(p.select(F.col("doc_id").alias("query_id"), "rank", "portion", F.col("doc_id").alias("title"), "score"))
    return r.select("query_id", F.md5("answer").alias("h"), F.round("confidence", 6).alias("confidence"))


def x27_bilingual(s, d):
    e = t(s, d, "eval_items").groupBy("source_authority").agg(F.min(F.when(F.col("language") == "en", F.col("answer"))).alias("en"), F.min(F.when(F.col("language") == "ne", F.col("answer"))).alias("ne"))
    return e.select("source_authority", F.md5(C.bilingual_format(F.col("en"), F.col("ne"))).alias("h"))


def x16_spans(s, d):
    sp = C.exact_spans(F.col("answer_exact"), F.col("text"))
    return pairs(s, d).filter("answer_exact is not null").select("query_id", F.posexplode(sp).alias("pos", "s")).select("query_id", F.col("pos").cast("long").alias("pos"), F.col("s.s").cast("long").alias("start_char"), F.col("s.e").cast("long").alias("end_char"))


def x16_fuzzy(s, d):
    f = C.fuzzy_spans()
    return pairs(s, d).filter("answer_exact is not null").select("query_id", f("answer_exact", "text").alias("span"))


def x17_boxes(s, d):
    """The first box of an item for each of its spans."""
    q = t(s, d, "proper_manual_qacite").filter("size(bbox_list) > 0 and size(char_spans) > 0")
    return q.select("qa_id", F.posexplode("char_spans").alias("pos", "s"), F.col("bbox_list")[0][0].alias("x0")).select("qa_id", F.col("pos").cast("long").alias("pos"), "x0")


def x18_x29_qa_pairs(s, d):
    return C.qa_pairs(Z.chunks(s, d)).select("chunk_id", "question", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


def x8_content_titles(s, d):
    return t(s, d, "documents").filter("text is not null").select("doc_id", C.content_title(F.col("text"), F.col("source")).alias("title"))


def l17_cross_terms(s, d):
    x = t(s, d, "documents").filter("title is not null").select("doc_id", "title")
    return x.select("doc_id", F.array_join(C.cross_terms(F.col("title"), "ne"), " | ").alias("ne"), F.array_join(C.cross_terms(F.col("title"), "en"), " | ").alias("en")).filter("ne <> '' or en <> ''")


def l26_target_report(s, d):
    """The decision on a query's language with what it rests on."""
    q = F.col("question")
    lang, conf = T.query_language(q)
    a, b, _ = T.script_shares(q)
    x = t(s, d, "eval_items").filter("question is not null")
    return x.select(F.col("item_id").cast("long").alias("item_id"), T.target_language(q).alias("target"), lang.alias("detected"), F.round(conf, 6).alias("confidence"), F.round(a, 6).alias("devanagari"), F.round(b, 6).alias("latin"), T.english_patterns(q).cast("long").alias("english_words"))


def m2_tfidf(s, d):
    r = C.tfidf_top(t(s, d, "documents").filter("text is not null").select("doc_id", "text"), "doc_id", "text")
    return r.select("doc_id", "term", "tf", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def m3_signature_index(s, d):
    e = t(s, d, "embeddings")
    v = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), V.norm(F.col("embedding")).alias("norm"))
    q = v.filter(f"row_id % {Z.EVERY} = 0").select(F.col("row_id").alias("query_id"), F.col("vec").alias("q_vec"), F.col("norm").alias("q_norm"))
    return C.signature_neighbours(q, C.save_index(v, S.shared_path(s, "index"))).select("query_id", "row_id", F.round("cosine", 6).alias("cosine"), "rank")


def m4_neutral_scores(s, d):
    return C.cross_scores(pairs(s, d)).groupBy("rerank_score").agg(F.count("*").alias("n"))


def k24_creation(s, d):
    b = ops.latest(t(s, d, "corpus_blocks"), "block_id", "ingested_at")
    o = layout.span_objects(b).groupBy("page_id").agg(F.countDistinct("font").alias("fonts"))
    p = layout.page_metrics(b).join(o, "page_id", "left").join(b.groupBy("page_id").agg(F.max(F.coalesce("source_page_is_ocr", F.lit(False))).alias("has_image")), "page_id")
    return C.creation_method(p.withColumn("fonts", F.coalesce("fonts", F.lit(0)))).groupBy("method").agg(F.count("*").alias("n"))


def k30_rotation(s, d):
    """Spans by rotation and opacity, estimated from the font."""
    o = layout.turned(layout.span_objects(ops.latest(t(s, d, "corpus_blocks"), "block_id", "ingested_at")))
    return o.groupBy("rotation", "alpha").agg(F.count("*").alias("n"), F.countDistinct("font").alias("fonts"))


def f5_authority(s, d):
    return t(s, d, "chunks").filter("source_authority = 'authoritative'").select("chunk_id", "doc_id").distinct()


def f9_substantial_tables(s, d):
    x = F.from_json("text", "rows int, cols int")
    return t(s, d, "corpus_blocks").filter("block_type = 'table'").select("block_id", x["rows"].cast("long").alias("rows"), x["cols"].cast("long").alias("cols")).filter("rows >= 2 and cols >= 2").distinct()


def f8_enhanced_authority(s, d):
    """F8: a missing flag counts as true; ids by prefix; the target language or an unknown one."""
    c = Z.chunks(s, d)
    ok = ~F.coalesce("is_distractor", F.lit(False)) | c.doc_id.rlike("^(act|notice|guideline|report)")
    return c.filter(ok & F.coalesce("language", F.lit("unknown")).isin("ne", "unknown") & (F.length("text") >= 30)).select("chunk_id")


def j1_j2_page_types(s, d):
    """Blocks with the type of their page; pages without one are unknown."""
    b = t(s, d, "corpus_blocks").select("block_id", "page_id", "doc_id").distinct()
    p = layout.page_type(layout.page_metrics(ops.latest(t(s, d, "corpus_blocks"), "block_id", "ingested_at"))).filter("n_blocks > 1").select("page_id", "page_type")
    return b.join(p, "page_id", "left").groupBy(F.coalesce("page_type", F.lit("unknown")).alias("page_type")).agg(F.count("*").alias("n"))


def j14_results_with_metadata(s, d):
    """Results joined with what was recorded of the same query, by key."""
    q = t(s, d, "proper_manual_qacite")
    left, right = q.select("qa_id", "split"), q.filter("ocr_confidence is not null").select("qa_id", "ocr_confidence")
    return left.join(right, "qa_id", "left").groupBy("split").agg(F.count("*").alias("n"), F.count("ocr_confidence").alias("known"))


def u3_candidate_concat(s, d):
    """Authoritative results of each question, then its distractors, numbered through."""
    c = S.cut(V.split_and_cap(Z.results(s, d), 5, 2).select("query_id", "chunk_id", "is_authoritative", "rank"))
    both = c.filter("is_authoritative").withColumn("part", F.lit(0)).unionByName(c.filter("NOT is_authoritative").withColumn("part", F.lit(1)))
    w = Window.partitionBy("query_id").orderBy("part", "rank")
    return both.select("query_id", "chunk_id", F.row_number().over(w).cast("long").alias("place"))


def r2_snapshot(s, d):
    """R2: a version that loses more than a twentieth of the rows is published, evaluated and rolled back."""
    m = t(s, d, "manifest")
    root = S.shared_path(s, "versions")
    enough = lambda old, new: new.count() >= 0.95 * old.count()
    C.publish(m, root, "1", None)
    C.publish(m.filter("year_guess is null"), root, "2", enough)
    version, rows = C.in_use(s, root)
    return rows.groupBy("authority").agg(F.count("*").alias("n")).withColumn("version", F.lit(version))


def x23_transliterated(s, d):
    return t(s, d, "eval_items").filter("language = 'ne'").select("item_id", C.transliterate({"क": "ka", "का": "kaa", "ा": "a", "न": "na", "े": "e"})("answer").alias("latin"))


_P = f"(select q.qa_id query_id, q.question query, q.chunk_id, q.doc_id, q.answer_exact, c.text from proper_manual_qacite q join {Z._C} c on q.chunk_id=c.chunk_id where q.question is not null)"
_S = f"(select *, row_number() over (partition by query_id, chunk_id order by share desc, pos) r from (select query_id, chunk_id, pos, s, case when len(w)>0 then len(list_intersect(w,list_distinct({Q.tok('lower(s)')})))::double/len(w) else 0.0 end share from (select query_id, chunk_id, w, pos, {Q.trim('s0')} s from (select query_id, chunk_id, list_distinct({Q.tok('lower(query)')}) w, unnest(regexp_split_to_array(text,'[.!?]+')) s0, generate_subscripts(regexp_split_to_array(text,'[.!?]+'),1) pos from {_P} where length(text)>300)) where length(s)>=20) where share>0)"
_PORT = f"(select p.*, case when length(text)<=300 then text when b is null then text[1:297]||'...' when length(b)>400 then b[1:397]||'...' else b end portion from {_P} p left join (select query_id, chunk_id, string_agg(s,'. ' order by r)||'.' b from {_S} where r<=3 group by 1,2) using (query_id, chunk_id))"
_LANG = Z._LANG


def _cross(c, to):
    parts = []
    for _, ne, en, _w in T.CONCEPTS:
        source, new, other = (en, ne[:2], ne) if to == "ne" else (ne, en[:2], en)
        have = Q.any_in(c if to == "ne" else f"lower({c})", other)
        for w in source:
            for n in new:
                parts.append(f"case when contains({f'lower({c})' if to == 'ne' else c},'{w}') and not {have} and replace({c},'{w}','{n}')<>{c} then replace({c},'{w}','{n}') end")
    return "list_filter([" + ",".join(parts) + "],lambda v: v is not null)"


def _distinct_in_order(x):
    return f"list_filter({x}, lambda v, i: list_position({x}, v)=i)"



QUERIES = {
    "x6_relevant_portion": (x6_relevant_portion, f"select query_id, md5(portion) h from {_PORT}"),
    "x26_multi_source": (x26_multi_source, f"select doc_id query_id, md5(string_agg(case when r=1 then 'According to '||doc_id||':'||chr(10) else doc_id||' also states:'||chr(10) end||portion,chr(10)||chr(10) order by r)||chr(10)||chr(10)||'Sources:'||chr(10)||string_agg(r||'. '||doc_id,chr(10) order by r)) h, round(least(avg(length(portion)/10.0::double)/25.0::double,1.0::double),6) confidence from (select *, row_number() over (partition by doc_id order by query_id) r from {_PORT}) where r<=4 group by 1"),
    "x27_bilingual": (x27_bilingual, "select source_authority, md5(concat_ws(chr(10)||chr(10),'[EN] '||min(case when language='en' then answer end),'[NE] '||min(case when language='ne' then answer end))) h from eval_items group by 1"),
    "x16_spans": (x16_spans, None),
    "x16_fuzzy": (x16_fuzzy, None),
    "x17_boxes": (x17_boxes, "select qa_id, (i-1)::bigint pos, x0 from (select qa_id, unnest(range(1,len(char_spans)+1)) i, bbox_list[1][1] x0 from proper_manual_qacite where len(bbox_list)>0 and len(char_spans)>0)"),
    "x18_x29_qa_pairs": (x18_x29_qa_pairs, None),
    "x8_content_titles": (x8_content_titles, f"select doc_id, coalesce(l[1], initcap(regexp_replace(source,'[_-]+',' ','g'))) title from (select doc_id, source, list_filter(list_transform(string_split(text,chr(10)),lambda v: {Q.trim('v')}),lambda v: length(v) between 15 and 80 and regexp_matches(v,'\\p{{L}}{{4}}') and not regexp_matches(lower(v),'page|www\\.|http|@')) l from documents where text is not null)".replace("initcap(regexp_replace(source,'[_-]+',' ','g'))", "array_to_string(list_transform(string_split(regexp_replace(source,'[_-]+',' ','g'),' '),lambda v: upper(v[1:1])||lower(v[2:])),' ')")),
    "l17_cross_terms": (l17_cross_terms, f"select doc_id, array_to_string({_distinct_in_order('a')},' | ') ne, array_to_string({_distinct_in_order('b')},' | ') en from (select doc_id, {_cross('title', 'ne')} a, {_cross('title', 'en')} b from documents where title is not null) where len(a)>0 or len(b)>0"),
    "l26_target_report": (l26_target_report, f"select item_id::bigint item_id, case when length({Q.trim('question')})=0 then 'en' when c>=0.8 and l in ('ne','en') then l when c>=0.6 and sd>0.3 then 'ne' when c>=0.6 and sl>0.7 and e>0 then 'en' when sd>sl then 'ne' when sl>sd then 'en' when e>0 then 'en' when l in ('ne','en') then l else 'en' end target, l detected, round(c,6) confidence, round(sd,6) devanagari, round(sl,6) latin, e::bigint english_words from (select *, {_X._qlang('question')} l, {_X._qconf('question')} c, {Q.dev('question')}::double/length(question) sd, {Q.latin('question')}::double/length(question) sl, {_X._english('question')} e from eval_items where question is not null)"),
    "m2_tfidf": (m2_tfidf, "select doc_id, term, tf, round(s,6) score, r as rank from (select *, row_number() over (partition by doc_id order by round(s,6) desc, term) r from (select x.doc_id, x.term, x.tf, x.tf*(ln((1.0::double+n)/(1.0::double+df))+1.0::double) s from (select doc_id, term, count(*) tf from (select doc_id, unnest(regexp_extract_all(lower(text),'[\\p{L}\\p{N}_]{3,}')) term from documents where text is not null) group by 1,2) x join (select term, count(distinct doc_id) df from (select doc_id, unnest(regexp_extract_all(lower(text),'[\\p{L}\\p{N}_]{3,}')) term from documents where text is not null) group by 1) y on x.term=y.term, (select count(*) n from documents where text is not null))) where r<=5"),
    "m3_signature_index": (m3_signature_index, None),
    "m4_neutral_scores": (m4_neutral_scores, f"select 0.5::double rerank_score, count(*) n from {_P}"),
    "k24_creation": (k24_creation, f"select case when has_image and coverage<0.1 then 'ocr_scanned' when coalesce(f,0)>10 and coverage>0.3 then 'mixed' else 'born_digital' end as method, count(*) n from {_I._TYPED} p left join (select page_id, count(distinct font) f from {_I._OBJECTS} group by 1) o using (page_id) join (select page_id, bool_or(coalesce(source_page_is_ocr,false)) has_image from {_I._LATEST} group by 1) i using (page_id) group by 1"),
    "k30_rotation": (k30_rotation, f"select case when regexp_matches(lower(font),'italic|oblique') then 15.0 else 0.0 end::double rotation, 1.0::double alpha, count(*) n, count(distinct font) fonts from {_I._OBJECTS} group by 1"),
    "k10_lexical_simple": (Z._lexical("simple"), Z._top("+".join([Z._w("contains(t,q)", "25.0"), f"coalesce({Z._phr(5, 5.0, 2.0)},0.0::double)", f"{Z._JAC}*15.0::double", f"{Z._COV}*10.0::double", Z._w("regexp_matches(text,'\\([0-9०-९]+\\)')", "4.0"), Z._w("regexp_matches(t,'(article|section) [0-9०-९]+')", "3.0")]), Z._BOTH, 2.0)),
    "f5_authority": (f5_authority, "select distinct chunk_id, doc_id from chunks where source_authority='authoritative'"),
    "f8_enhanced_authority": (f8_enhanced_authority, "select distinct chunk_id from chunks where (not coalesce(is_distractor,false) or regexp_matches(doc_id,'^(act|notice|guideline|report)')) and coalesce(language,'unknown') in ('ne','unknown') and length(text)>=30"),
    "f9_substantial_tables": (f9_substantial_tables, "select distinct block_id, json_extract(text,'$.rows')::bigint as \"rows\", json_extract(text,'$.cols')::bigint as cols from corpus_blocks where block_type='table' and json_valid(text) and json_extract(text,'$.rows')::bigint>=2 and json_extract(text,'$.cols')::bigint>=2"),
    "j1_j2_page_types": (j1_j2_page_types, f"select coalesce(page_type,'unknown') page_type, count(*) n from (select distinct block_id, page_id, doc_id from corpus_blocks) b left join (select page_id, page_type from {_I._TYPED} where n_blocks>1) p using (page_id) group by 1"),
    "j14_results_with_metadata": (j14_results_with_metadata, "select split, count(*) n, count(ocr_confidence) known from proper_manual_qacite group by 1"),
    "u3_candidate_concat": (u3_candidate_concat, f"select query_id, chunk_id, row_number() over (partition by query_id order by is_authoritative desc, rank) place from ({Z.QUERIES['w3_split'][1]})"),
    "r2_snapshot": (r2_snapshot, "select authority, count(*) n, '1' as version from manifest group by 1"),
    "x23_transliterated": (x23_transliterated, None),
}
