"""Queries: language by script, noise, queries' features, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import qacite as A
from ..sources.tables import table as t
from . import sql as Q



def docs(s, d):
    return t(s, d, "documents").filter("text is not null").select("doc_id", "text")


def items(s, d):
    """Questions of both kinds: with citations and held out."""
    a = t(s, d, "proper_manual_qacite").select(F.concat(F.lit("q"), F.col("qa_id").cast("string")).alias("query_id"), "question")
    b = t(s, d, "eval_items").select(F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("query_id"), "question")
    return a.unionByName(b).filter("question is not null")


def l1_l2_block_language(s, d):
    return docs(s, d).select("doc_id", F.round(T.devanagari_ratio(F.col("text")), 6).alias("ratio"), T.block_language(F.col("text")).alias("lang3"), T.simple_language(F.col("text")).alias("simple"))


def l3_query_language(s, d):
    lang, conf = T.query_language(F.col("question"))
    return items(s, d).select("query_id", lang.alias("lang"), F.round(conf, 6).alias("confidence"))


def l5_chunk_language(s, d):
    c = t(s, d, "chunks").select("chunk_id", "text").distinct()
    return T.with_chunk_language(c, "text").select("chunk_id", "lang", F.round("lang_conf", 6).alias("confidence"))


def l6_l7_noise(s, d):
    x = docs(s, d).withColumn("w", T.tokens(F.col("text")))
    return x.select("doc_id", T.is_garbage(F.col("text"), F.col("w")).alias("garbage"), F.round(T.coherence(F.col("text"), F.col("w")), 6).alias("coherence"))


def l8_reconstruct(s, d):
    new, score = T.reconstruct(F.col("text"))
    return t(s, d, "corpus_blocks").filter("length(text) > 0").select("block_id", "text").distinct().select("block_id", F.md5(new).alias("h"), F.round(score, 6).alias("score"))


def l9_target_language(s, d):
    return items(s, d).select("query_id", T.target_language(F.col("question")).alias("target"))


def l10_script_shares(s, d):
    a, b, c = T.script_shares(F.col("text"))
    return docs(s, d).select("doc_id", F.round(a, 6).alias("devanagari"), F.round(b, 6).alias("latin"), F.round(c, 6).alias("other"))


def l11_english_patterns(s, d):
    return docs(s, d).select("doc_id", T.english_patterns(F.col("text")).cast("long").alias("n"))


def l12_domain(s, d):
    return docs(s, d).select("doc_id", T.domain(F.col("text")).alias("domain"))


def l14_concepts(s, d):
    return docs(s, d).select("doc_id", T.concept_count(F.col("text")).cast("long").alias("n"), F.round(T.concept_weight(F.col("text")), 6).alias("weight"))


def l16_expansions(s, d):
    return items(s, d).select("query_id", F.array_join(T.expansions(F.col("question"), "ne"), " || ").alias("ne"), F.array_join(T.expansions(F.col("question"), "en"), " || ").alias("en"))


def l18_synonym(s, d):
    c = t(s, d, "documents").filter("title is not null").select("doc_id", "title")
    return c.select("doc_id", T.synonym_expansion(F.col("title")).alias("expanded"))


def l19_tabular(s, d):
    return items(s, d).select("query_id", T.is_tabular(F.col("question")).alias("tabular"))


def l20_fallback_threshold(s, d):
    """Strategy and threshold of a query by domain, concepts and strategy."""
    lang, _ = T.query_language(F.col("question"))
    strategy = F.when(T.concept_count(F.col("question")) > 0, "semantic_expansion").when(lang == "mixed", "mixed_language").otherwise("monolingual")
    dom = T.domain(F.col("question"))
    adj = F.when(dom == "constitution", -0.1).when(dom == "health", -0.05).when(dom == "emergency", -0.15).when(dom == "covid", -0.1).otherwise(0.0)
    sem = F.when(T.concept_count(F.col("question")) > 0, (T.concept_weight(F.col("question")) - 0.5) * 0.2).otherwise(0.0)
    st = F.when(strategy == "semantic_expansion", -0.05).when(strategy == "mixed_language", -0.1).otherwise(0.0)
    return items(s, d).select("query_id", strategy.alias("strategy"), F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.8), 0.5 + adj - sem + st)), 6).alias("threshold"))


def l24_composed(s, d):
    """Texts in composed form, and whether they are Devanagari."""
    from ..operators.udfs import composed

    return docs(s, d).select("doc_id", F.md5(composed()(F.col("text"))).alias("h"), (T.devanagari_ratio(F.col("text")) > 0.3).alias("is_devanagari"))


def l21_web_language(s, d):
    return docs(s, d).select("doc_id", T.web_language(F.col("text")).alias("lang2"))


def x1_tokens(s, d):
    return docs(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))


def x3_x4_clean(s, d):
    return t(s, d, "corpus_blocks").filter("length(text) > 0").select("block_id", "text").distinct().select("block_id", F.md5(A.clean_ocr(F.col("text"))).alias("ocr"), F.md5(A.clean_display(F.col("text"))).alias("display"))


def x19_extracted(s, d):
    return t(s, d, "eval_items").select(F.col("item_id").cast("long").alias("item_id"), A.extracted(F.col("passage")).alias("answer"))


def w13_key_terms(s, d):
    return A.key_terms(t(s, d, "eval_items"), "item_id", "passage", "language").select(F.col("item_id").cast("long").alias("item_id"), "term", "n", "score", F.col("rank").cast("long").alias("rank"))


def f3_k20_qa_sources(s, d):
    b = A.qa_sources(t(s, d, "corpus_blocks")).select("block_id", "text", "conf_mean").distinct()
    return b.select("block_id", F.round(A.text_quality(F.col("text"), F.col("conf_mean")), 6).alias("quality"))


def j15_answer_overlap(s, d):
    p = t(s, d, "proper_manual_qacite").filter("answer_exact is not null").select("qa_id", "chunk_id", "answer_exact")
    c = t(s, d, "chunks").select("chunk_id", "text").distinct()
    return p.join(c, "chunk_id").select("qa_id", F.round(A.overlap_share(F.col("answer_exact"), F.col("text")), 6).alias("share"))


def w17_splits(s, d):
    return A.split_sets(t(s, d, "proper_manual_qacite"), "qa_id")


def k22_content_domain(s, d):
    return docs(s, d).select("doc_id", A.qa_domain(F.col("text")).alias("domain"))


def k21_valid_answers(s, d):
    p = t(s, d, "proper_manual_qacite").select("qa_id", "chunk_id", "answer_exact")
    c = t(s, d, "chunks").select("chunk_id", "text").distinct()
    return p.join(c, "chunk_id").select("qa_id", A.valid_answer(F.col("answer_exact"), F.col("text")).alias("valid"))


D = "(select doc_id, text from documents where text is not null)"
I = "(select 'q'||qa_id query_id, question from proper_manual_qacite where question is not null union all select 'e'||item_id, question from eval_items where question is not null)"
R = Q.ratio


def _lang3(c):
    return f"case when length({Q.trim(c)})=0 or {Q.letters(c)}=0 then 'mixed' when {R(c)}>0.6 then 'ne' when {R(c)}<0.1 then 'en' else 'mixed' end"


def _qlang(c):
    return f"case when length({Q.trim(c)})=0 then 'mixed' when {R(c)}>0.7 then 'ne' when {R(c)}<0.05 then 'en' else 'mixed' end"


def _qconf(c):
    return f"case when length({Q.trim(c)})=0 then 0.0::double when {R(c)}>0.7 then least(1.0::double,0.7::double+0.3::double*{R(c)}) when {R(c)}<0.05 then 0.7::double+0.3::double*(1.0::double-{R(c)}) else 0.5::double end"


def _words(c, words):
    """Matches of whole words; separators are doubled so that neighbours don't share one."""
    return Q.cnt(f"regexp_replace(lower({c}),'[^\\p{{L}}\\p{{N}}_]','  ','g')", f"(?:^| )(?:{words})(?: |$)")




def _english(c):
    return "(" + _words(c, "the|and|or|of|in|to|for|with|by|from|up|about|into|through|during") + "+" + _words(c, "health|ministry|government|constitution|emergency|operations|center") + ")"


def _domain(c):
    n = {k: Q.cnt(f"lower({c})", f"(?:{p})") for k, p in T.DOMAINS}
    most = "greatest(" + ",".join(n.values()) + ")"
    return f"case when {most}=0 then 'general' " + " ".join(f"when {v}={most} then '{k}'" for k, v in n.items()) + " end"


def _touch(c):
    return [("(" + Q.any_in(c, ne) + " or " + Q.any_in(f"lower({c})", en) + ")", w) for _, ne, en, w in T.CONCEPTS]


def _n(c):
    return "(" + "+".join(f"{a}::int" for a, _ in _touch(c)) + ")"


def _w(c):
    return f"(case when {_n(c)}>0 then (" + "+".join(f"case when {a} then {w}::double else 0.0::double end" for a, w in _touch(c)) + f")/{_n(c)} else 0.0::double end)"


def _expand(c, k):
    when = " ".join(f"when '{name}' then [" + ",".join(f"replace('{x}','{{}}',{c})" for x in pairs[k]) + "]" for name, pairs in T.TEMPLATES.items())
    return f"array_to_string(list_concat([{c}],case {_domain(c)} {when} else [] end),' || ')"


_REBUILT = r"""(select block_id, text, case when text<>'' and kept<>'' and kept<>text then kept else text end new, kept,
 (a<>text)::int+(b<>a)::int+(c<>b)::int+(e<>c)::int+(f<>e)::int+(g<>f)::int+(h<>g)::int+(i<>h)::int+(kept<>i)::int steps from
 (select *, array_to_string(list_filter(string_split(i,' '),lambda x: length(x)>1 or regexp_full_match(x,'[\p{Nd}aAiIoO]')),' ') kept from
 (select *, regexp_replace(h,'[ \t\n\x0B\f\r]+',' ','g') i from (select *, replace(g,'१','1') h from (select *, replace(f,'०','0') g from (select *, replace(e,'cl','d') f from (select *, replace(c,'vv','w') e from (select *, replace(b,'rn','m') c from
 (select *, regexp_replace(regexp_replace(a,'(^|[^\p{L}\p{N}_])1($|[^\p{L}\p{N}_])','\1I\2','g'),'(^|[^\p{L}\p{N}_])1($|[^\p{L}\p{N}_])','\1I\2','g') b from
 (select *, regexp_replace(regexp_replace(text,'(^|[^\p{L}\p{N}_])0($|[^\p{L}\p{N}_])','\1O\2','g'),'(^|[^\p{L}\p{N}_])0($|[^\p{L}\p{N}_])','\1O\2','g') a from (select distinct block_id, text from corpus_blocks where length(text)>0)))))))))))"""

_REBUILT_CHUNKS = _REBUILT.replace("(select distinct block_id, text from corpus_blocks where length(text)>0)", f"(select distinct chunk_id, {Q.trim('text')} as text from chunks)").replace("(select block_id, text,", "(select chunk_id, text,")

_WS = "regexp_replace({c},'[ \\t\\n\\x0B\\f\\r]+',' ','g')"


def _lone(c, one):
    """Lone characters out, twice, as neighbours share a separator."""
    r = f"'(^|[^\\p{{L}}\\p{{N}}_])[{one}]($|[^\\p{{L}}\\p{{N}}_])','\\1\\2','g'"
    return f"regexp_replace(regexp_replace({c},{r}),{r})"


def _AL(c):
    return f"(length(regexp_replace({c},'[^\\p{{L}}\\x{{0900}}-\\x{{097F}}]','','g'))::double/greatest(length({c}),1))"


def _NO(c):
    return f"(length(regexp_replace({c},'[^\\p{{Nd}}!@#$%^&*()_+\\-={{}}\\[\\]|\\\\:;\"<>,.?/]','','g'))::double/greatest(length({c}),1))"


def _WH(w):
    return f"(len(list_filter({w},lambda v: length(v)>=3 and (regexp_full_match(v,'\\p{{L}}+') or {Q.dev('v')}>0)))::double/greatest(len({w}),1))"


_STRAT = f"case when {_n('question')}>0 then 'semantic_expansion' when ({_qlang('question')})='mixed' then 'mixed_language' else 'monolingual' end"

QUERIES = {
    "l1_l2_block_language": (l1_l2_block_language, f"select doc_id, round({R('text')},6) ratio, {_lang3('text')} lang3, case when {Q.dev('text')}>{Q.latin('text')} then 'ne' when {Q.latin('text')}>0 then 'en' else 'unknown' end simple from {D}"),
    "l3_query_language": (l3_query_language, f"select query_id, {_qlang('question')} lang, round({_qconf('question')},6) confidence from {I}"),
    "l5_chunk_language": (l5_chunk_language, f"""select chunk_id, lang, round(conf,6) confidence from (select chunk_id, case when t='' then 'mixed' when r>0.7 then 'ne' when r<0.05 then 'en' else 'mixed' end lang, case when t='' then 0.0::double when r>0.7 then least(1.0::double,0.6::double+0.4::double*r+0.2::double*c+0.1::double*gain) when r<0.05 then least(1.0::double,0.6::double+0.4::double*(1.0::double-r)+0.2::double*c+0.1::double*gain) when still and gain<0.2 then 0.1::double else 0.5::double*c+0.1::double*gain end conf
      from (select *, {R('xx')} r, {Q.coherence('xx')} c from (select *, case when g and gain>0.3 then kept else t end xx, case when g and gain>0.3 then {Q.garbage('kept')} else g end still from
      (select chunk_id, text t, g, kept, case when not g or kept is null or kept='' or kept=text then 0.0::double else least(1.0::double,steps*0.3::double+length(kept)::double/greatest(length(text),1)*0.7::double) end gain from (select *, {Q.garbage('text')} g from {_REBUILT_CHUNKS})))))"""),
    "l6_l7_noise": (l6_l7_noise, f"select doc_id, {Q.garbage('text')} garbage, round({Q.coherence('text')},6) coherence from {D}"),
    "l8_reconstruct": (l8_reconstruct, f"select block_id, md5(new) h, round(case when new=text then 0.0::double else least(1.0::double,steps*0.3::double+length(kept)::double/length(text)*0.7::double) end,6) score from {_REBUILT}"),
    "l9_target_language": (l9_target_language, f"select query_id, case when length({Q.trim('question')})=0 then 'en' when c>=0.8 and l in ('ne','en') then l when c>=0.6 and sd>0.3 then 'ne' when c>=0.6 and sl>0.7 and e>0 then 'en' when sd>sl then 'ne' when sl>sd then 'en' when e>0 then 'en' when l in ('ne','en') then l else 'en' end target from (select *, {_qlang('question')} l, {_qconf('question')} c, {Q.dev('question')}::double/length(question) sd, {Q.latin('question')}::double/length(question) sl, {_english('question')} e from {I})"),
    "l10_script_shares": (l10_script_shares, f"select doc_id, round(case when n>0 then a::double/n else 0.0 end,6) devanagari, round(case when n>0 then b::double/n else 0.0 end,6) latin, round(case when n>0 then (n-a-b)::double/n else 0.0 end,6) other from (select doc_id, length(text) n, {Q.dev('text')} a, {Q.latin('text')} b from {D})"),
    "l11_english_patterns": (l11_english_patterns, f"select doc_id, {_english('text')}::bigint n from {D}"),
    "l12_domain": (l12_domain, f"select doc_id, {_domain('text')} as domain from {D}"),
    "l14_concepts": (l14_concepts, f"select doc_id, {_n('text')}::bigint n, round({_w('text')},6) weight from {D}"),
    "l16_expansions": (l16_expansions, f"select query_id, {_expand('question', 0)} ne, {_expand('question', 1)} en from {I}"),
    "l18_synonym": (l18_synonym, "select doc_id, case when w is not null then replace(lower(title),w,case w " + " ".join(f"when '{a}' then '{b}'" for a, b in T.SYNONYMS.items()) + f" end) end expanded from (select doc_id, title, list_filter({Q.tok('lower(title)')},lambda v: v in (" + ",".join(f"'{a}'" for a in T.SYNONYMS) + "))[1] w from documents where title is not null)"),
    "l19_tabular": (l19_tabular, f"select query_id, {Q.cnt('question', '[0-9०-९]')}::double/greatest(length(question),1)>0.08 or " + Q.any_in("lower(question)", (*T.TABLE_WORDS, "how many")) + f" tabular from {I}"),
    "l24_composed": (l24_composed, f"select doc_id, md5(nfc_normalize(text)) h, {R('text')}>0.3 is_devanagari from {D}"),
    "l20_fallback_threshold": (l20_fallback_threshold, f"""select query_id, st strategy, round(greatest(0.1::double,least(0.8::double,0.5::double+(case dom when 'constitution' then -0.1 when 'health' then -0.05 when 'emergency' then -0.15 when 'covid' then -0.1 else 0.0 end)::double-(case when n>0 then (w-0.5::double)*0.2::double else 0.0::double end)+(case st when 'semantic_expansion' then -0.05 when 'mixed_language' then -0.1 else 0.0 end)::double)),6) threshold
      from (select *, {_STRAT} st, {_domain('question')} dom, {_n('question')} n, {_w('question')} w from {I})"""),
    "l21_web_language": (l21_web_language, f"select doc_id, case when {Q.letters('text')}=0 then 'en' when ({Q.dev('text')}+2*(" + "+".join(f"contains(lower(text),'{p}')::int" for p in T.ROMANISED) + f"))::double/{Q.letters('text')}>0.3 then 'ne' else 'en' end lang2 from {D}"),
    "x1_tokens": (x1_tokens, f"select doc_id, len({Q.tok('text')})::bigint n from {D}"),
    "x3_x4_clean": (x3_x4_clean, f"select block_id, md5(case when length(o)>5 and length(regexp_replace(o,'[^\\p{{L}}\\x{{0900}}-\\x{{097F}}]','','g'))::double/length(o)>0.3 then o else '' end) ocr, md5({Q.trim(_WS.format(c=chr(114) + 'egexp_replace(regexp_replace(text,' + chr(39) + '[' + chr(92) + 'x{0}-' + chr(92) + 'x{8}' + chr(92) + 'x{b}' + chr(92) + 'x{c}' + chr(92) + 'x{e}-' + chr(92) + 'x{1f}]' + chr(39) + ',' + chr(39) * 2 + ',' + chr(39) + 'g' + chr(39) + '),' + chr(39) + chr(92) + '[TABLE[^' + chr(92) + ']]*' + chr(92) + ']' + chr(39) + ',' + chr(39) * 2 + ',' + chr(39) + 'g' + chr(39) + ')'))}) display from (select *, {Q.trim(_WS.format(c=_lone(_lone('text', '0-9'), 'a-zA-Z')))} o from (select distinct block_id, text from corpus_blocks where length(text)>0))"),
    "x19_extracted": (x19_extracted, f"select item_id::bigint item_id, case when length(p[1])<50 and p[2] is not null then p[1]||'. '||p[2] else p[1] end answer from (select item_id, list_filter(list_transform(regexp_split_to_array(passage,'[.!?।॥]+'),lambda v: {Q.trim('v')}),lambda v: v<>'') p from eval_items)"),
    "w13_key_terms": (w13_key_terms, "select item_id::bigint item_id, term, n, score, r as rank from (select *, row_number() over (partition by item_id order by score desc, term) r from (select item_id, term, count(*) n, (any_value(length(term))*count(*))::bigint score from (select item_id, language, unnest(regexp_extract_all(lower(passage),'[\\p{L}\\p{M}\\p{N}_]{3,}')) term from eval_items) where not regexp_matches(term,'^\\p{Nd}+$') and not (" + " or ".join(f"coalesce(language,'')='{n}' and term in (" + ",".join(f"'{w}'" for w in ws) + ")" for n, ws in A.STOP.items()) + ") group by item_id, term)) where r<=5"),
    "f3_k20_qa_sources": (f3_k20_qa_sources, f"""select block_id, round(case when n>=20 and len(w)>=5 and al>=0.7 and no<=0.3 and whole>=0.8 and conf_mean>=60 then least(1.0::double,(case when conf_mean>=70 then 0.3 else 0.1 end)::double+(case when n>=100 then 0.3 when n>=50 then 0.2 else 0.0 end)::double+al*0.2::double+whole*0.2::double) else 0.0::double end,6) quality from
      (select *, {_AL('text')} al, {_NO('text')} no, {_WH('w')} whole from (select distinct block_id, text, conf_mean, length(text) n, {Q.tok('text')} w from corpus_blocks where source_authority='authoritative' and language in ('ne','en') and length(text)>=50 and conf_mean>=45))"""),
    "k21_valid_answers": (k21_valid_answers, f"""select qa_id, coalesce(length({Q.trim('a')})>=10 and len(w)>=3 and {_AL('a')}>=0.8 and {_NO('a')}<=0.2 and {_WH('w')}>=0.9 and (len(x)=0 or len(list_intersect(x,y))::double/greatest(len(x),1)>=0.6),false) valid from
      (select qa_id, answer_exact a, {Q.tok('answer_exact')} w, list_distinct(regexp_extract_all(lower(answer_exact),'[\\p{{L}}\\p{{N}}_]+')) x, list_distinct(regexp_extract_all(lower(text),'[\\p{{L}}\\p{{N}}_]+')) y from proper_manual_qacite join (select distinct chunk_id, text from chunks) using (chunk_id))"""),
    "j15_answer_overlap": (j15_answer_overlap, f"select qa_id, round(case when len(a)>0 then len(list_intersect(a,b))::double/len(a) else 0.0::double end,6) share from (select qa_id, list_distinct({Q.tok('lower(answer_exact)')}) a, list_distinct({Q.tok('lower(text)')}) b from proper_manual_qacite q join (select distinct chunk_id, text from chunks) c using (chunk_id) where answer_exact is not null)"),
    "w17_splits": (w17_splits, "select qa_id, case when r<=floor(n*0.7::double) then 'train' when r<=floor(n*0.7::double)+floor(n*0.15::double) then 'dev' else 'test' end part from (select qa_id, row_number() over (order by md5('42'||qa_id), qa_id) r, count(*) over () n from proper_manual_qacite)"),
    "k22_content_domain": (k22_content_domain, f"select doc_id, case when h>l and h>0 then 'health' when l>0 then 'legal' else 'generic' end as domain from (select doc_id, " + "+".join(f"contains(lower(text),'{w}')::int" for w in A.HEALTH) + " h, " + "+".join(f"contains(lower(text),'{w}')::int" for w in A.LEGAL) + f" l from {D})"),
}
