"""Queries: changed documents, shards, gates, titles, request metrics, joins of tables with keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifest, ops
from ..sources.tables import shared_path
from ..sources.tables import table as t
from . import q_ingest as _I
from . import q_measure as _M


def current(s, d):
    """Present metrics: those measured on the stated questions."""
    return _M.measured(s, d)


def j8_changed(s, d):
    m = ops.latest(t(s, d, "manifest"), "doc_id", "retrieved_at", "file")
    return ops.changed(m, t(s, d, "lineage")).select("doc_id", "change")


def j9_checksums(s, d):
    m = t(s, d, "manifest").select(F.col("doc_id").alias("key"), F.col("sha256").alias("sum")).distinct()
    st = t(s, d, "lineage").select(F.col("doc_id").alias("key"), F.col("sha256").alias("stored"))
    return ops.checksum_changes(m, st).select("key")


def j10_shards(s, d):
    m = ops.latest(t(s, d, "manifest"), "doc_id", "retrieved_at", "file")
    return ops.affected_shards(ops.changed(m, t(s, d, "lineage")), t(s, d, "lineage"))


def j11_k27_regressions(s, d):
    r = ops.regressions(t(s, d, "metric_gates"), current(s, d))
    return r.select("metric", F.round("ratio", 6).alias("ratio"), "severity", "rollback", "approval")


def k28_simple_regressions(s, d):
    return ops.simple_regressions(t(s, d, "metric_gates"), current(s, d)).select("metric")


def j12_metric_changes(s, d):
    c = ops.metric_changes(t(s, d, "metric_gates"), current(s, d))
    return c.select("metric", F.round("absolute", 6).alias("absolute"), F.round("relative", 6).alias("relative"))


def k29_safety_report(s, d):
    return ops.safety_report(ops.regressions(t(s, d, "metric_gates"), current(s, d)))


def s16_changelog(s, d):
    """The changes of a run appended to a table of their own and read back."""
    m = ops.latest(t(s, d, "manifest"), "doc_id", "retrieved_at", "file")
    path = shared_path(s, "changelog")
    ops.changelog(ops.changed(m, t(s, d, "lineage")), "run-1").write.mode("append").partitionBy("run").parquet(path)
    return s.read.schema("doc_id string, entry string, run string").parquet(path).select("doc_id", "entry")


def s15_metrics_table(s, d):
    """Measured metrics appended to a table by run and read back."""
    path = shared_path(s, "metrics")
    current(s, d).withColumn("run", F.lit("run-1")).write.mode("append").partitionBy("run").parquet(path)
    return s.read.schema("metric string, current double, run string").parquet(path).select("metric", F.round("current", 6).alias("current"))


def r4_upserted(s, d):
    u = ops.upserted(t(s, d, "manifest"), t(s, d, "lineage"))
    return u.select("doc_id", F.date_format("added_at", "yyyy-MM-dd HH:mm:ss").alias("added_at"), "sha256", "status")


def r6_document_shards(s, d):
    """Shards of each document, and whether its lineage is that of the present file."""
    m = ops.latest(t(s, d, "manifest"), "doc_id", "retrieved_at", "file").select("doc_id", F.col("sha256").alias("now"))
    l = ops.latest(t(s, d, "lineage"), "doc_id", "last_processed", "sha256")
    return l.join(m, "doc_id", "left").select("doc_id", F.array_join(F.sort_array("shard_ids"), ",").alias("shards"), F.coalesce(F.col("sha256") == F.col("now"), F.lit(False)).alias("current"))


def s5_json_documents(s, d):
    """One JSON document a file's record, nested, written as texts and read back by its structure."""
    m = t(s, d, "manifest")
    doc = m.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "file", "sha256"))).alias("retrievals"))
    path = shared_path(s, "documents")
    doc.select(F.to_json(F.struct("doc_id", "retrievals")).alias("value")).write.text(path)
    back = s.read.schema("doc_id string, retrievals array<struct<at: string, file: string, sha256: string>>").json(path)
    return back.select("doc_id", F.size("retrievals").cast("long").alias("n"), F.get("retrievals", F.size("retrievals") - 1)["at"].alias("last_at"))


def r4_latest_lineage(s, d):
    return ops.latest(t(s, d, "lineage"), "doc_id", "last_processed", "sha256").select("doc_id", "status", F.size("shard_ids").cast("long").alias("shards"))


def a30_lineage_statistics(s, d):
    return t(s, d, "lineage").groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("shard_ids")).cast("long").alias("shards"))


def r6_shard_lookup(s, d):
    """Documents of each shard."""
    return t(s, d, "lineage").select("doc_id", F.explode("shard_ids").alias("shard_id")).groupBy("shard_id").agg(F.countDistinct("doc_id").alias("docs"))


def w18_backups(s, d):
    """The manifest's retrievals of a file as backups of it."""
    b = t(s, d, "manifest").select(F.col("authority").alias("owner"), F.concat_ws("|", "doc_id", F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("backup_id"), F.col("retrieved_at").alias("at")).distinct()
    return ops.kept_backups(b, 3, 30).select("owner", "backup_id", "is_kept", "is_restore_point")


def j13_titles(s, d):
    """Title of a chunk's document, derived from the file name where there is none."""
    m = ops.latest(t(s, d, "manifest"), "doc_id", "retrieved_at", "file").select("doc_id", "title_guess", "file")
    c = t(s, d, "chunks").select("doc_id").distinct()
    return c.join(m, "doc_id", "left").select("doc_id", F.coalesce("title_guess", manifest.title_of(F.col("file"))).alias("title"))


def r5_replaced(s, d):
    """The latest version of each block only."""
    return ops.latest(t(s, d, "corpus_blocks"), "block_id", "ingested_at", "page_id").groupBy("doc_id").agg(F.count("*").alias("blocks"))


def a27_request_metrics(s, d):
    """Requests by hour and type with mean latency, from the request log."""
    e = t(s, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("string").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def j16_terms(s, d):
    """Questions that hold a term of the dictionary of concepts, by term."""
    from ..functions.text import CONCEPTS

    terms = s.createDataFrame([(c, w) for c, ne, en, _ in CONCEPTS for w in (*ne, *en)], "concept string, term string")
    q = t(s, d, "documents").filter("text is not null").select("doc_id", F.lower("text").alias("low"))
    hit = q.join(F.broadcast(terms), F.contains("low", "term"))
    return hit.groupBy("concept", "term").agg(F.count("*").alias("n"))


def u8_membership(s, d):
    """U8: chunks that no question cites."""
    q = t(s, d, "proper_manual_qacite").select("chunk_id")
    return t(s, d, "chunks").select("chunk_id").distinct().join(q, "chunk_id", "left_anti")


def x28_hard_negatives(s, d):
    """Hard negatives of each item in order of score, the first three."""
    from pyspark.sql import Window

    n = t(s, d, "proper_manual_qacite").select("qa_id", F.explode("hard_negatives").alias("h")).select("qa_id", F.col("h.chunk_id").alias("chunk_id"), F.col("h.score").alias("score"))
    w = Window.partitionBy("qa_id").orderBy(F.desc("score"), "chunk_id")
    return n.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("qa_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


_CUR = f"(select * from metric_gates join {_M.MEASURED} using (metric))"
_LM = "(select * from (select *, row_number() over (partition by doc_id order by retrieved_at desc nulls last, file) r from manifest) where r=1)"
_CH = f"(select m.doc_id, case when l.sha256 is null then 'new' else 'modified' end change from {_LM} m left join lineage l on m.doc_id=l.doc_id where l.sha256 is null or l.sha256<>m.sha256)"
_RG = f"(select *, case when ratio>0.10 then 'severe' when ratio>2*threshold then 'moderate' else 'minor' end severity from (select *, (baseline-cur)/baseline ratio from {_CUR} where baseline>0) where ratio>threshold)"


def _terms():
    from ..functions.text import CONCEPTS

    return ",".join(f"('{c}','{w}')" for c, ne, en, _ in CONCEPTS for w in (*ne, *en))


QUERIES = {
    "j8_changed": (j8_changed, f"select doc_id, change from {_CH}"),
    "j9_checksums": (j9_checksums, "select key from (select distinct doc_id as key, sha256 from manifest) m left join lineage l on m.key=l.doc_id where m.sha256 is distinct from l.sha256"),
    "j10_shards": (j10_shards, f"select distinct unnest(shard_ids) shard_id from lineage where doc_id in (select doc_id from {_CH})"),
    "j11_k27_regressions": (j11_k27_regressions, f"select metric, round(ratio,6) ratio, severity, is_critical and severity in ('moderate','severe') as rollback, ratio>0.10 approval from {_RG}"),
    "k28_simple_regressions": (k28_simple_regressions, f"select metric from {_CUR} where is_critical and cur<baseline*0.95::double"),
    "j12_metric_changes": (j12_metric_changes, f"select metric, round(cur-coalesce(baseline,0.0),6) absolute, round((cur-coalesce(baseline,0.0))/greatest(coalesce(baseline,1.0::double),0.001::double)*100,6) relative from {_CUR}"),
    "k29_safety_report": (k29_safety_report, f"select total, critical, severe, rb as rollback, ap approval, concat_ws(chr(10), case when total=0 then '{ops.NO_REGRESSION}' end, case when critical>0 then '🚨 '||critical||'{ops.CRITICAL_ADVICE}' end, case when severe>0 then '⚠️ '||severe||'{ops.SEVERE_ADVICE}' end, " + ", ".join(f"case when list_contains(ms,'{m}') then '{x}' end" for m, x in ops.METRIC_ADVICE.items()) + f", case when rb then '{ops.ROLLBACK_ADVICE}' when ap then '{ops.APPROVAL_ADVICE}' end) recommendations from (select count(*) total, count(*) filter (is_critical) critical, count(*) filter (severity='severe') severe, coalesce(bool_or(is_critical and severity in ('moderate','severe')),false) rb, coalesce(bool_or(ratio>0.10),false) ap, coalesce(list(metric) filter (severity<>'minor'),[]) ms from {_RG})"),
    "s16_changelog": (s16_changelog, f"select doc_id, change||': '||doc_id||' ('||substring(sha256,1,12)||')' entry from (select m.doc_id, m.sha256, case when l.sha256 is null then 'new' else 'modified' end change from {_LM} m left join lineage l on m.doc_id=l.doc_id where l.sha256 is null or l.sha256<>m.sha256)"),
    "s15_metrics_table": (s15_metrics_table, f"select metric, round(cur,6) as current from {_M.MEASURED}"),
    "r4_upserted": (r4_upserted, "select doc_id, strftime(a,'%Y-%m-%d %H:%M:%S') added_at, coalesce(m.sha256,l.sha256) sha256, case when m.sha256 is null or coalesce(m.sha256=l.sha256,false) then status else 'pending' end status from (select doc_id, min(retrieved_at) a, arg_max(sha256, {'a':retrieved_at,'b':sha256}) sha256 from manifest group by 1) m full join (select * from (select *, row_number() over (partition by doc_id order by last_processed desc nulls last, sha256) r from lineage) where r=1) l using (doc_id)"),
    "r6_document_shards": (r6_document_shards, f"select l.doc_id, array_to_string(list_sort(shard_ids),',') shards, coalesce(l.sha256=m.sha256,false) as current from (select * from (select *, row_number() over (partition by doc_id order by last_processed desc nulls last, sha256) r from lineage) where r=1) l left join {_LM} m on m.doc_id=l.doc_id"),
    "s5_json_documents": (s5_json_documents, "select doc_id, count(*) n, max(strftime(retrieved_at,'%Y-%m-%d %H:%M:%S')) last_at from manifest group by 1"),
    "r4_latest_lineage": (r4_latest_lineage, "select doc_id, status, len(shard_ids)::bigint shards from (select *, row_number() over (partition by doc_id order by last_processed desc nulls last, sha256) r from lineage) where r=1"),
    "a30_lineage_statistics": (a30_lineage_statistics, "select status, count(*) n, sum(len(shard_ids))::bigint shards from lineage group by 1"),
    "r6_shard_lookup": (r6_shard_lookup, "select shard_id, count(distinct doc_id) docs from (select doc_id, unnest(shard_ids) shard_id from lineage) group by 1"),
    "w18_backups": (w18_backups, "select owner, backup_id, n<=3 and a>=last-interval 30 days is_kept, n=least(2,c) is_restore_point from (select *, row_number() over (partition by owner order by a desc, backup_id) n, count(*) over (partition by owner) c, max(a) over (partition by owner) as last from (select distinct authority as owner, doc_id||'|'||strftime(retrieved_at,'%Y-%m-%d %H:%M:%S.%f') backup_id, retrieved_at a from manifest))"),
    "j13_titles": (j13_titles, f"select doc_id, coalesce(title_guess, {_I._TITLE}) title from (select c.doc_id, title_guess, file, {_I._PLAIN} pl from (select distinct doc_id from chunks) c left join {_LM} m using (doc_id))"),
    "r5_replaced": (r5_replaced, "select doc_id, count(distinct block_id) blocks from corpus_blocks group by 1"),
    "a27_request_metrics": (a27_request_metrics, "select strftime(date_trunc('hour',ts),'%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) n, round(avg(value),6) mean_value from events group by all"),
    "j16_terms": (j16_terms, f"select concept, term, count(*) n from documents, (values {_terms()}) v(concept,term) where text is not null and contains(lower(text),term) group by all"),
    "u8_membership": (u8_membership, "select distinct chunk_id from chunks where chunk_id not in (select chunk_id from proper_manual_qacite where chunk_id is not null)"),
    "x28_hard_negatives": (x28_hard_negatives, "select qa_id, chunk_id, r as rank from (select qa_id, h.chunk_id chunk_id, row_number() over (partition by qa_id order by h.score desc, h.chunk_id) r from (select qa_id, unnest(hard_negatives) h from proper_manual_qacite)) where r<=3"),
}


def r3_stream_windows(s, d):
    """The request log as a stream, all of it, in hourly windows."""
    from ..sources.tables import shared_path
    from ..streaming.requests import request_windows

    schema = t(s, d, "events").schema
    src = shared_path(s, "events")
    t(s, d, "events").write.parquet(src)
    out = shared_path(s, "windows")
    windows = request_windows(s.readStream.schema(schema).parquet(src), late="400 days")
    q = windows.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", shared_path(s, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(out).select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def m1_embeddings(s, d):
    from ..operators.udfs import hashed_embedding

    return t(s, d, "documents").select("doc_id", hashed_embedding(16)(F.coalesce("text", F.lit(""))).alias("embedding"))


def l13_segments(s, d):
    from ..operators.udfs import query_segments

    return t(s, d, "proper_manual_qacite").select("qa_id", F.explode(query_segments()("question")).alias("x")).select("qa_id", "x.text", "x.language", "x.start", "x.end", "x.confidence")


def x22_translation(s, d):
    from ..operators.udfs import translate

    return t(s, d, "eval_items").select("item_id", translate({"ward": "वडा", "office": "कार्यालय", "water": "पानी"})("passage").alias("translated"))


QUERIES |= {
    "r3_stream_windows": (r3_stream_windows, "select strftime(date_trunc('hour',ts),'%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n, round(avg(value),6) mean_value from events group by all"),
    "m1_embeddings": (m1_embeddings, None),
    "l13_segments": (l13_segments, None),
    "x22_translation": (x22_translation, None),
}
