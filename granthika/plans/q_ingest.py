"""Queries: sources, sinks, filters, chunking, manifest, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import layout, manifest, ops
from ..sources import tables as S
from . import sql as Q

t = S.table
B = "corpus_blocks"
L = lambda *c: [F.col(x).cast("long").alias(x) for x in c]


def s1_parquet_scan(s, d):
    return t(s, d, "documents").filter("n_chars > 500").select("doc_id", "lang", F.col("n_chars").cast("long").alias("n_chars"))


def s2_partitioned_sink(s, d):
    m = t(s, d, B).select("doc_id", "block_type", F.length("text").alias("n"))
    return S.write_partitioned(m, S.shared_path(s, "blocks"), "block_type").groupBy("block_type").agg(F.count("*").alias("n"), F.sum("n").alias("chars"))


def s3_multi_file_union(s, d):
    p, b = S.shared_path(s, "part"), t(s, d, B)
    b.filter("source_page_is_ocr").select("block_id", "conf_mean").write.parquet(f"{p}/a")
    b.filter("not source_page_is_ocr").select("block_id", "tokens").write.parquet(f"{p}/b")
    u = S.union_files(s, f"{p}/a", f"{p}/b")
    return u.agg(F.count("*").alias("n"), F.count("conf_mean").alias("with_conf"), F.sum("tokens").cast("long").alias("tokens"))


def s4_json_lines(s, d):
    q = t(s, d, "proper_manual_qacite").select("qa_id", "question", "answer_exact", "char_spans", "split")
    return S.json_lines(q, S.shared_path(s, "json")).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.size("char_spans")).cast("long").alias("spans"), F.sum(F.length("answer_exact")).alias("chars"))


def s7_csv_round(s, d):
    g = t(s, d, "metric_gates").select("metric", "baseline", "threshold")
    return S.csv_round(g, S.shared_path(s, "csv"))


def s13_score_cache(s, d):
    q = t(s, d, "proper_manual_qacite").select("qa_id", "chunk_id", F.md5(F.concat_ws("|", "question", "chunk_id")).alias("cache_key"), "quality_score")
    cache = q.filter("quality_score >= 0.6").select("cache_key", F.col("quality_score").alias("score")).distinct()
    return S.with_cached_scores(q.drop("quality_score"), cache).select("qa_id", "score")


def f1_f2_chunk_filter(s, d):
    return C.nonempty(t(s, d, B)).filter(F.length(T.trimmed(F.col("text"))) >= 3).groupBy("block_type").agg(F.count("*").alias("n"))


def f6_page_filters(s, d):
    digits = T.count_of(F.col("text"), "[0-9०-९]") / F.length("text")
    return t(s, d, B).filter((F.length("text") >= 100) & (digits <= 0.3) & ~F.contains("doc_id", F.lit("Unconfirmed"))).groupBy("doc_id").agg(F.count("*").alias("n"))


def f10_keyword_or(s, d):
    return t(s, d, "documents").filter(F.lower("text").rlike("irrigation|सिंचाइ")).select("doc_id")


def f11_substring_counts(s, d):
    return t(s, d, B).filter(F.contains("doc_id", F.lit("notice"))).groupBy("doc_id").agg(F.count("*").alias("n"))


def f12_derived_columns(s, d):
    c = t(s, d, "documents")
    return c.select("doc_id", F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("_page_001")).alias("page_id"), F.size(T.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("tokens"))


def f17_ocr_lines(s, d):
    b = t(s, d, B).filter("ocr_engine = 'tesseract' and block_type = 'text'").select("block_id", "text").distinct()
    return C.ocr_lines(b)


def f19_page_dispatch(s, d):
    return C.dispatched(t(s, d, B)).groupBy("page_type", "way").agg(F.count("*").alias("n"))


def f18_span_hull(s, d):
    b = t(s, d, B)
    return C.spans_of_blocks(ops.latest(b, "block_id", "ingested_at"))


def w15_windows(s, d):
    w = C.windows(t(s, d, "documents").filter("text is not null"), "text", 100, 20)
    return w.select("doc_id", F.col("window_no").cast("long").alias("window_no"), "token_count", F.md5("window_text").alias("h"))


def x24_upload_windows(s, d):
    return C.upload_windows(t(s, d, "documents").filter("text is not null").select("doc_id", "text"), "text", 100, 80).select("doc_id", F.col("start").cast("long").alias("start"), F.md5("window_text").alias("h"))


def w16_chunk_numbers(s, d):
    b = C.nonempty(t(s, d, B)).select("doc_id", "page_id", "block_id", "tokens").distinct().withColumn("n", F.when(F.coalesce("tokens", F.lit(0)) > 100, 2).otherwise(1))
    return C.numbered(b, "doc_id", "page_id", "block_id", "n").select("block_id", F.col("first_chunk").cast("long").alias("first_chunk"))


def x2_table_text(s, d):
    return t(s, d, B).filter("block_type = 'table'").select("block_id", F.md5(C.table_text(F.col("text"))).alias("h")).distinct()


def k1_k3_quality(s, d):
    c = t(s, d, "chunks").drop("embedding", "bbox").distinct()
    return C.with_quality(c).select("chunk_id", F.round("block_q", 6).alias("block_q"), F.round("chunk_q", 6).alias("chunk_q"), "tier")


def x7_file_titles(s, d):
    return t(s, d, "manifest").select("file", manifest.title_of(F.col("file")).alias("title")).distinct()


def x10_years(s, d):
    return t(s, d, "documents").select("doc_id", manifest.year_of(F.col("text")).alias("year")).filter("year is not null")


def names(s, d):
    """Names to classify: files, their domains and titles."""
    m = t(s, d, "manifest").select("doc_id", F.explode(F.array("file", "source_domain_guess", "title_guess", F.concat_ws("_", "source_domain_guess", F.lit("wiki"), "file"))).alias("name"))
    return m.filter("name is not null").distinct()


def x9_classified(s, d):
    a, w, c = manifest.classified(F.col("name"))
    return names(s, d).select("doc_id", "name", a.alias("authority"), w.alias("is_wiki"), c.alias("confidence"))


def a4_pattern_hits(s, d):
    return manifest.pattern_hits(names(s, d).select("name").distinct(), "name")


def l23_file_language(s, d):
    return t(s, d, "manifest").filter("title_guess is not null").select("doc_id", T.filename_language(F.col("title_guess")).alias("language")).distinct()


def x11_hashes(s, d):
    return t(s, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


def s5_block_meta(s, d):
    return S.block_meta(t(s, d, B)).distinct()


def a3_confusion(s, d):
    return manifest.authority_statistics(t(s, d, "manifest"))


def a9_signatures(s, d):
    o = layout.span_objects(ops.latest(t(s, d, B), "block_id", "ingested_at"))
    return layout.signature_frequency(o).filter("n > 1").select("doc_id", F.md5("sig").alias("sig"), F.col("n").cast("long").alias("n"), F.round("frequency", 6).alias("frequency"))


def k25_drop_reasons(s, d):
    o = layout.drop_reasons(layout.span_objects(ops.latest(t(s, d, B), "block_id", "ingested_at")))
    return o.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def k23_page_types(s, d):
    p = layout.page_type(layout.page_metrics(ops.latest(t(s, d, B), "block_id", "ingested_at")))
    return p.select("page_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("n_words").cast("long").alias("n_words"), F.col("n_blocks").cast("long").alias("n_blocks"), F.round("coverage", 6).alias("coverage"), "page_type")


def a8_page_type_summary(s, d):
    p = layout.page_type(layout.page_metrics(ops.latest(t(s, d, B), "block_id", "ingested_at")))
    return p.groupBy("page_type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def w11_first_chunk(s, d):
    c = t(s, d, "chunks").select("doc_id", "chunk_id", "text").distinct()
    return layout.first_qualifying(c, "doc_id", "chunk_id").select("doc_id", "chunk_id")


def u1_u2_union(s, d):
    a = t(s, d, "chunks").select("chunk_id", "doc_id", "token_count").distinct()
    b = t(s, d, "documents").select(F.concat(F.lit("up_"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("doc_id"))
    return S.append_missing(a, b).agg(F.count("*").alias("n"), F.count("token_count").alias("with_tokens"), F.countDistinct("doc_id").alias("docs"))


_LATEST = "(select * from (select *, row_number() over (partition by block_id order by ingested_at desc nulls last) r from corpus_blocks) where r=1)"
_OBJECTS = f"""(select doc_id, page_id, block_id, f.font as font, f.size as size, s.text as text, s.bbox as bbox from (
 select *, json_extract_string(font_stats,'$[0].font') ff, from_json(font_stats,'[{{"font":"VARCHAR","size":"DOUBLE"}}]')[1] f, unnest(char_span) s from {_LATEST}))"""
_SIGS = f"(select *, concat_ws('|',trim(text),font,format('{{:,.1f}}',size),format('{{:,.2f}}',bbox[1]/595.0::double)||','||format('{{:,.2f}}',bbox[2]/842.0::double)) sig from {_OBJECTS})"
_FREQ = f"(select s.doc_id, sig, count(*) n, count(*)::double/any_value(p) frequency from {_SIGS} s join (select doc_id, count(distinct page_id) p from {_OBJECTS} group by 1) q on s.doc_id=q.doc_id group by s.doc_id, sig)"
_PAGES = f"""(select doc_id, page_id, sum(length(x)) n_chars, sum(len({Q.tok('x')})) n_words, count(*) n_blocks,
 sum(case when len(bbox)>=4 then (bbox[3]-bbox[1])*(bbox[4]-bbox[2]) else 0.0 end) area from
 (select *, case when block_type in ('text','table') then coalesce(text,'') else '' end x from {_LATEST}) group by all)"""
_TYPED = f"""(select *, area/(595.0::double*842.0) coverage, case when (case when n_chars/(595.0::double*842.0)>=0.001 then 1 else 0 end)+(case when n_chars>=50 then 1 else 0 end)
 +(case when area/(595.0::double*842.0)>=0.01 then 1 else 0 end)+1>=2 then 'text' else 'image' end page_type from {_PAGES})"""
_Q = "greatest(0.0::double,least(1.0::double,(case when coalesce(source_page_is_ocr,false) and conf_mean is not null then 0.5::double+0.5::double*(conf_mean/100.0::double) else 1.0::double end)*(case when source_authority='authoritative' then 1.2::double else 1.0::double end)*(case when coalesce(is_distractor,false) then 0.7::double else 1.0::double end)*(case when coalesce(language,'') in ('ne','en') then 1.1::double else 1.0::double end)*(case when coalesce(has_watermark,false) then 0.9::double else 1.0::double end)))"

_NAMES = "(select distinct doc_id, name from (select doc_id, unnest([file, source_domain_guess, title_guess, concat_ws('_',source_domain_guess,'wiki',file)]) name from manifest) where name is not null)"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(file,'^.*/',''),'\.[^.]*$',''),'[_-]+',' ','g'),'[ \t\n\x0B\f\r]+',' ','g'))"
_TITLE = r"(case when pl='' then file when regexp_full_match(pl,'[a-zA-Z0-9 \-_.()]+') then array_to_string(list_transform(string_split(pl,' '), lambda x, i: case when i>1 and lower(x) in (" + ",".join(f"'{w}'" for w in manifest.SMALL) + ") then lower(x) else upper(x[1:1])||lower(x[2:]) end),' ') else pl end)"

QUERIES = {
    "s1_parquet_scan": (s1_parquet_scan, "select doc_id, lang, n_chars::bigint n_chars from documents where n_chars > 500"),
    "s2_partitioned_sink": (s2_partitioned_sink, "select block_type, count(*) n, sum(length(text))::bigint chars from corpus_blocks group by 1"),
    "s3_multi_file_union": (s3_multi_file_union, "select count(*) n, count(case when source_page_is_ocr then conf_mean end) with_conf, sum(case when not source_page_is_ocr then tokens end)::bigint tokens from corpus_blocks where source_page_is_ocr is not null"),
    "s4_json_lines": (s4_json_lines, "select split, count(*) n, sum(len(char_spans))::bigint spans, sum(length(answer_exact))::bigint chars from proper_manual_qacite group by 1"),
    "s7_csv_round": (s7_csv_round, "select metric, baseline, threshold from metric_gates"),
    "s13_score_cache": (s13_score_cache, "select qa_id, case when quality_score >= 0.6 then quality_score else 0.5::double end score from proper_manual_qacite"),
    "s5_block_meta": (s5_block_meta, """select distinct block_id, json_extract_string(pdf_meta,'$.title') title, json_extract(pdf_meta,'$.page_count')::bigint page_count, json_extract_string(font_stats,'$[0].font') font, json_extract(font_stats,'$[0].size')::double size from corpus_blocks"""),
    "f1_f2_chunk_filter": (f1_f2_chunk_filter, f"select block_type, count(*) n from corpus_blocks where block_type<>'empty' and length({Q.trim('text')})>=3 group by 1"),
    "f6_page_filters": (f6_page_filters, f"select doc_id, count(*) n from corpus_blocks where length(text)>=100 and {Q.cnt('text','[0-9०-९]')}::double/length(text)<=0.3 and not contains(doc_id,'Unconfirmed') group by 1"),
    "f10_keyword_or": (f10_keyword_or, "select doc_id from documents where regexp_matches(lower(text),'irrigation|सिंचाइ')"),
    "f11_substring_counts": (f11_substring_counts, "select doc_id, count(*) n from corpus_blocks where contains(doc_id,'notice') group by 1"),
    "f12_derived_columns": (f12_derived_columns, f"select doc_id, 'doc'||lpad(doc_id::varchar,6,'0')||'_page_001' page_id, len({Q.tok(chr(99)+'oalesce(text,'+chr(39)*2+')')})::bigint tokens from documents"),
    "f17_ocr_lines": (f17_ocr_lines, f"select block_id, block_id||'_ocr_'||lpad((i-1)::varchar,3,'0') line_id, trim(x) line from (select block_id, unnest(string_split(text,chr(10))) x, generate_subscripts(string_split(text,chr(10)),1) i from (select distinct block_id, text from corpus_blocks where ocr_engine='tesseract' and block_type='text')) where length({Q.trim('x')})>0"),
    "f18_span_hull": (f18_span_hull, f"select block_id, count(*) n_spans, min(s.bbox[1]) x0, min(s.bbox[2]) y0, max(s.bbox[3]) x1, max(s.bbox[4]) y1, sum(length(s.text))::bigint n_chars from (select block_id, unnest(char_span) s from {_LATEST}) group by 1"),
    "f19_page_dispatch": (f19_page_dispatch, "select page_type, way, count(*) n from (select case when coalesce(source_page_is_ocr,false) then 'image' else 'text' end page_type, case when coalesce(source_page_is_ocr,false) then case when ocr_engine is not null then 'ocr_blocks' else 'empty' end when block_type='table' then 'table' else 'text_blocks' end way from corpus_blocks) group by all"),
    "w15_windows": (w15_windows, f"""select doc_id, i::bigint window_no, least(100,n-i*80)::bigint token_count, md5(case when n<=100 then text else array_to_string(w[(i*80+1):(i*80+100)],' ') end) h from
      (select *, unnest(range(0,(case when n<=100 then 1 else 1+ceil((n-100)/80.0) end)::bigint)) i from (select doc_id, text, {Q.tok('text')} w, len({Q.tok('text')}) n from documents where text is not null))"""),
    "x24_upload_windows": (x24_upload_windows, f"select doc_id, i::bigint as start, md5(array_to_string(w[(i+1):(i+100)],' ')) h from (select *, unnest(range(0,len(w),80)) i from (select doc_id, {Q.tok('text')} w from documents where text is not null))"),
    "w16_chunk_numbers": (w16_chunk_numbers, f"""select block_id, coalesce(sum(n) over (partition by doc_id order by page_id, block_id rows between unbounded preceding and 1 preceding),0)::bigint first_chunk from
      (select distinct doc_id, page_id, block_id, tokens, case when coalesce(tokens,0)>100 then 2 else 1 end n from corpus_blocks where block_type<>'empty' and length({Q.trim('text')})>0)"""),
    "x2_table_text": (x2_table_text, """select distinct block_id, md5(case when text is null then '[TABLE]' when j is null or len(j)=0 then '[TABLE]'||chr(10)||text[1:2000] when length(f)>2000 then f[1:2000]||'...[TRUNCATED]' else f end) h from (select *, '[TABLE: '||len(j)||' rows × '||len(j[1])||' cols]'||chr(10)||array_to_string(list_transform(j,lambda r: array_to_string(r,chr(9))),chr(10)) f from (select block_id, text, case when json_valid(text) then from_json(json_extract(text,'$.data'),'[["VARCHAR"]]') end j from corpus_blocks where block_type='table'))"""),
    "k1_k3_quality": (k1_k3_quality, f"""select distinct chunk_id, round(b,6) block_q, round(q,6) chunk_q, case when coalesce(language_confidence,0)>=0.8 and q>=0.9 and not coalesce(is_reconstructed,false) then 'high' when coalesce(language_confidence,0)>=0.5 and q>=0.6 then 'medium' when coalesce(is_reconstructed,false) and coalesce(reconstruction_score,0)>=0.3 then 'recovery' else 'low' end tier
      from (select *, greatest(0.0::double,least(1.2::double,b*(0.9::double+0.2::double*coalesce(language_confidence,0.5::double)))) q from (select *, {_Q} b from chunks))"""),
    "x7_file_titles": (x7_file_titles, f"select distinct file, {_TITLE} title from (select file, {_PLAIN} pl from manifest)"),
    "x10_years": (x10_years, r"select doc_id, y::bigint as year from (select doc_id, list_max(list_transform(regexp_extract_all(regexp_replace(text,'[^\p{L}\p{N}_]','  ','g'),'(?:^| )(19[5-9][0-9]|20[0-5][0-9])(?: |$)',1),lambda v: v::bigint)) y from documents) where y is not null"),
    "x9_classified": (x9_classified, f"select doc_id, name, case when not w and a then 'authoritative' else 'non_authoritative' end authority, w is_wiki, case when w then 'high' when a then 'medium' else 'low' end confidence from (select doc_id, name, (" + " or ".join(f"regexp_matches(lower(name),'{p}')" for p in manifest.WIKI) + f") and not regexp_matches(lower(name),'{manifest.NOT_WIKI}') w, regexp_matches(lower(name),'{manifest.AUTHORITY}') a from {_NAMES})"),
    "a4_pattern_hits": (a4_pattern_hits, "select " + ", ".join(f"count(*) filter ({c}) {n}" for n, c in (("explicit", "a"), ("wiki", "b"), ("token", "c"), ("guarded", "g"), ("positive", "(a or b or c)"), ("is_wiki", "(a or b or c) and not g"), ("token_only", "c and not a and not b"))) + f" from (select regexp_matches(lower(name),'{manifest.WIKI[0]}') a, regexp_matches(lower(name),'{manifest.WIKI[1]}') b, regexp_matches(lower(name),'{manifest.WIKI[2]}') c, regexp_matches(lower(name),'{manifest.NOT_WIKI}') g from (select distinct name from {_NAMES}))"),
    "l23_file_language": (l23_file_language, f"select distinct doc_id, case when {Q.dev('title_guess')}+{Q.latin('title_guess')}=0 then 'en' when {Q.dev('title_guess')}::double/({Q.dev('title_guess')}+{Q.latin('title_guess')})>=0.25 then 'ne' else 'en' end as language from manifest where title_guess is not null"),
    "x11_hashes": (x11_hashes, "select doc_id, sha256(text) sha, md5(text) md5 from documents where text is not null"),
    "a3_confusion": (a3_confusion, "select count(*) filter (a and not d) auth_plain, count(*) filter (a and d) auth_distractor, count(*) filter (not a and not d) other_plain, count(*) filter (not a and d) other_distractor from (select authority='authoritative' a, coalesce(is_distractor,false) d from manifest)"),
    "a9_signatures": (a9_signatures, f"select doc_id, md5(sig) sig, n, round(frequency,6) frequency from {_FREQ} where n>1"),
    "k25_drop_reasons": (k25_drop_reasons, f"""select reason, count(*) n from (select unnest(list_filter([case when (bbox[3]-bbox[1])*(bbox[4]-bbox[2])/(595.0::double*842.0)>0.25 then 'large_area' end, case when frequency>=0.3 then 'frequent' end, case when regexp_matches(lower(font),'italic|oblique') then 'rotation' end, case when {' or '.join(f"regexp_matches(text,'{m}')" for m in layout.MARKS)} then 'text_pattern' end, case when size>24 and contains(lower(font),'bold') then 'large_bold_font' end, case when regexp_matches(lower(font),'script|display|decorative') then 'decorative_font' end, case when size<6 then 'micro_text' end, case when x>0.3 and x<0.7 and y>0.3 and y<0.7 and size>24 then 'centred_large' end, case when (y<0.1 or y>0.9) and frequency>=0.15 then 'edge_frequent' end],lambda v: v is not null)) reason from (select o.*, f.frequency, (bbox[1]+bbox[3])/2/595.0::double x, (bbox[2]+bbox[4])/2/842.0::double y from {_SIGS} o join {_FREQ} f on o.doc_id=f.doc_id and o.sig=f.sig)) group by 1"""),
    "k23_page_types": (k23_page_types, f"select page_id, n_chars::bigint n_chars, n_words::bigint n_words, n_blocks::bigint n_blocks, round(coverage,6) coverage, page_type from {_TYPED}"),
    "a8_page_type_summary": (a8_page_type_summary, f"select page_type, count(*) n, sum(n_chars)::bigint chars from {_TYPED} group by 1"),
    "w11_first_chunk": (w11_first_chunk, "select doc_id, min(chunk_id) chunk_id from chunks where length(text)>100 group by 1"),
    "u1_u2_union": (u1_u2_union, "select count(*) n, count(token_count) with_tokens, count(distinct doc_id) docs from (select distinct chunk_id, doc_id, token_count from chunks union all by name select 'up_'||doc_id chunk_id, source doc_id from documents)"),
}
