"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import (
    chat,
    common,
    decontaminate,
    filter_audit,
    host_rules,
    html_blocks,
    interpolation,
    language,
    mixing,
    simhash,
    token_counts,
    tokens,
    toxicity,
    whitening,
)
from tidegauge.sources import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark).path("tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.offsets(tokens.read_tokens(spark, path))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.fit(pages), keep=["page_id", "url"])


def op4_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # A tenth of the texts learned from is held out for the mixture weights.
    held_back = F.crc32(F.concat(F.lit("weights "), F.col("doc_id").cast("string")).cast("binary")) % 10 == 0
    scored = interpolation.score(docs, common.outside_fold(1), held_back)
    # The learned texts are those of the other folds, so the fold follows from the id.
    return scored.select(
        "doc_id", common.in_fold(1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(common.outside_fold(0)))
    judged = language.predict(docs, model, keep=["doc_id"])
    return judged.select("doc_id", common.in_fold(0).alias("held_out"), "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shards")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    field = toxicity.fit(docs, labels.where(common.outside_fold(0)))
    scored = toxicity.score(docs, field, keep=["doc_id"])
    return scored.select("doc_id", common.in_fold(0).alias("held_out"), "score", "predicted", "spans")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    ).drop("spans")


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(_table(spark, sf_dir, "documents"), F.col("source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 9).alias("host_rate"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shortcut = token_counts.prove(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), shortcut, keep=["doc_id"])


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors), keep=["vec_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_token_ids, op2_chat, op3_html, op4_interpolation, op5_language,
        op6_mixing, op7_toxicity, op8_simhash, op9_decontamination, op10_host_rules,
        op11_filter_audit, op12_token_counts, op13_whitening,
    )
    return {query.__name__: query for query in listed}


_HOST_RULES_SQL = r"""
    with given as (select doc_id, source, coalesce(text, '') as t from documents),
    worded as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
                      [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines from given),
    placed as (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from worded where len(ws) >= 5),
    repeated as (select doc_id, i from (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as gram from placed)
                 qualify count(*) over (partition by doc_id, gram) > 1),
    covered as (select doc_id, least(5, coalesce(lead(i) over (partition by doc_id order by i) - i, 5)) as n from repeated),
    measured as (
        select w.doc_id, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
               len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
               (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
               coalesce((select sum(n) from covered c where c.doc_id = w.doc_id), 0)::bigint as n_repeat_words
        from worded w),
    judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from measured),
    hosts as (select source, count(*)::double as n, count(*) filter (where base_failed)::double as k from judged group by source),
    prior as (select sum(k) / sum(n) as mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2
                     - sum(k) / sum(n) * (1 - sum(k) / sum(n)) * count(*) / sum(n) as spread from hosts),
    rates as (select source, case when spread <= 0 then mean
                     else (k + mean * greatest(0, mean * (1 - mean) / spread - 1)) / (n + greatest(0, mean * (1 - mean) / spread - 1))
                     end as rate from hosts, prior)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and rate <= 0.5 as kept, round(rate, 9) as host_rate
    from judged j join rates r on j.source is not distinct from r.source
"""

_DECONTAMINATION_SQL = r"""
    with item_words as (
        select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
    wanted as (select distinct item_id, least(13, len(ws)) as width, array_to_string(ws[i:i + 12], ' ') as gram
               from (select item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) as i from item_words where len(ws) > 0)),
    doc_words as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
    placed as (select doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) as i
               from doc_words, (select distinct width from wanted) where len(ws) >= width),
    found as (select doc_id, i, p.width, item_id
              from (select doc_id, i, width, array_to_string(ws[i:i + width - 1], ' ') as gram from placed) p
              join wanted using (gram, width)),
    hits as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + width)) as place from found) group by doc_id),
    items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
              from (select distinct doc_id, item_id::varchar as item from found where item_id is not null) group by doc_id)
    select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
           sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
    from doc_words left join hits using (doc_id) left join items using (doc_id)
"""


_FILTER_AUDIT_SQL = r"""
    with judged as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
    given as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
    worded as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as smallest from given),
    failing as (
        select doc_id, part, (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int
               + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::int
               + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > smallest, false)::int as pattern
        from worded),
    counted as (select part, pattern, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
                from failing left join judged using (doc_id) group by part, pattern),
    letters(l, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    orders as (select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
               from letters a, letters b, letters c, letters d, letters e where bit_count(a.b | b.b | c.b | d.b | e.b) = 5),
    steps as (select filter_order, step::int as step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
              from (select *, unnest(range(1, 6)) as step from orders)),
    found as (
        select part, filter_order, step, own,
               coalesce(sum(n) filter (where pattern & (before | own) = 0), 0)::bigint as kept,
               coalesce(sum(n) filter (where pattern & before = 0 and pattern & own > 0), 0)::bigint as removed,
               coalesce(sum(n) filter (where pattern & before > 0 and pattern & own > 0), 0)::bigint as redundant,
               coalesce(sum(n) filter (where pattern = own), 0)::bigint as unique_fails,
               coalesce(sum(good) filter (where pattern & before = 0 and pattern & own > 0), 0)::bigint as good_lost,
               coalesce(sum(toxic) filter (where pattern & before = 0 and pattern & own > 0), 0)::bigint as toxic_lost
        from counted, steps group by all)
    select * exclude (own), sum(removed) over (partition by part, own)::bigint as shapley from found
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that need neither a trained model nor a tokenizer nor a hash function of their own."""
    return {
        "op9_decontamination": _DECONTAMINATION_SQL,
        "op10_host_rules": _HOST_RULES_SQL,
        "op11_filter_audit": _FILTER_AUDIT_SQL,
    }
