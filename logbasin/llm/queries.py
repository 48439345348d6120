"""The registered queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logbasin.llm import (
    ann,
    collocations,
    decontaminate,
    exact_topk,
    importance,
    line_dedup,
    minhash,
    mixing,
    pieces,
    quality,
    secret_scan,
    sharding,
    tool_calls,
)
from logbasin.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds prose, so every assistant turn is read as a call and the user turn behind it as its result."""
    calls, results = tool_calls.from_conversations(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link(calls, results, tool_calls.tools(spark))
    return linked.select(
        "conv_id", "place", "turn", "call_id", "name", "level", "status", F.array_join("errors", ",").alias("errors"), "json",
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding, without its text: trained on the labelled findings of documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, ~quality.is_held_out(F.col("doc_id")))
    return found.select(
        "doc_id", F.sha2(F.col("candidate").cast("binary"), 256).alias("finding_sha256"), F.char_length("candidate").alias("length"),
        "occurrences", "score", "secret",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids of every whole text, decoded again: how many, their checksum and whether the text came back."""
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ids = F.crc32(F.to_binary(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 4, "0")), ""), F.lit("hex")))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), ids.alias("ids_crc32"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless")
    )


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_copies(table(spark, sf_dir, "documents"))
    each = plan.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_neighbours, op3_tool_calls, op4_secrets, op5_quality, op6_sharding, op7_minhash, op8_pieces, op9_exact_topk,
        op10_mixing, op11_collocations, op12_importance, op13_decontamination,
    )
}

WORDS_SQL = r"""list_filter(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""
FEATURES_SQL = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"

ORACLES = {
    "op1_line_dedup": r"""
        with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        line as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from split),
        keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line),
        frequent as (select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key
            having count(distinct doc_id) >= 5),
        marked as (select k.*, f.key is not null and k.doc_id <> f.keeper as gone from keyed k left join frequent f using (key))
        select doc_id, count(*) as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from marked group by doc_id""",
    "op7_minhash": r"""
        with recursive word as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
        shingle as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from word),
        size as (select doc_id, count(*) as n from shingle group by 1),
        pair as (select a.doc_id as a, b.doc_id as b, count(*) as common from shingle a join shingle b using (s)
            where a.doc_id <> b.doc_id group by 1, 2),
        link as (select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b
            where 100 * common >= 80 * (x.n + y.n - common)),
        reach as (select a as doc_id, b as other from link union select r.doc_id, l.b from reach r join link l on r.other = l.a),
        least_id as (select doc_id, least(doc_id, min(other)) as component_id from reach group by doc_id)
        select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id,
            doc_id = coalesce(component_id, doc_id) as kept
        from documents left join size using (doc_id) left join least_id using (doc_id)""",
    "op9_exact_topk": """
        with v as (select vec_id, [floor(1024 * e::double) for e in embedding] as x from embeddings
            where embedding is not null and len(embedding) > 0
            and len([e for e in embedding if e is null or not isfinite(e)]) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 10""",
    "op11_collocations": r"""
        with piece as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
        word as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') as w from piece),
        placed as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as g
            from word, range(1, 5) t(k)),
        gram as (select lang, k, g, string_split(g, ' ') as w, count(*)::bigint as f from placed group by lang, k, g),
        spoken as (select lang, sum(f)::bigint as n from gram where k = 1 group by lang),
        candidate as (select * from gram where k >= 2 and f >= 30),
        cut as (select c.lang, c.g, c.f as a, t.j, array_to_string(w[1:j], ' ') as first, array_to_string(w[j + 1:], ' ') as rest
            from candidate c, range(1, 4) t(j) where j < k),
        judged as (select cut.lang, cut.g, cut.a, j, x.f as l, y.f as r, ((2000000::hugeint * cut.a) // (x.f + y.f))::bigint as score
            from cut join gram x on x.lang = cut.lang and x.g = cut.first join gram y on y.lang = cut.lang and y.g = cut.rest),
        lowest as (select * from judged qualify row_number() over (partition by lang, g order by score, j) = 1),
        inner_part as (select c.lang, array_to_string(w[s:s + m - 1], ' ') as g, max(f) as f
            from candidate c, range(2, 4) t(m), range(1, 4) u(s) where m < k and s + m - 1 <= k group by all),
        kept as (select o.* from lowest o left join inner_part i on i.lang = o.lang and i.g = o.g
            where i.f is null or 100::hugeint * i.f < 80::hugeint * o.a),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, g) as rank from kept)
        select lang, rank, g as phrase, a, l, r, n, score from ranked join spoken using (lang) where rank <= 2000""",
    "op12_importance": rf"""
        with words as (select doc_id, {WORDS_SQL} as w from documents),
        test as (select {WORDS_SQL} as w from benchmark),
        doc_feature as (select doc_id, f, count(*) as n from (select doc_id, {FEATURES_SQL} as f from words) group by all),
        test_feature as (select f, count(*) as n from (select {FEATURES_SQL} as f from test) group by all),
        feature as (select f, hex(encode(f)) as h from (select f from doc_feature union select f from test_feature)),
        crc_table as (select list(list_reduce(list_prepend(b, range(8)),
            lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t from range(256) r(b)),
        bucketed as (select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2),
            lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
            from feature, crc_table),
        s as (select bucket, sum(n) as s from doc_feature join bucketed using (f) group by bucket),
        t as (select bucket, sum(n) as t from test_feature join bucketed using (f) group by bucket),
        total as (select coalesce((select sum(s) from s), 0)::double as all_s, coalesce((select sum(t) from t), 0)::double as all_t),
        gain as (select b.bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * (all_s + 10000) / ((coalesce(s, 0)::double + 1) * (all_t + 10000))))::bigint as gain
            from range(10000) b(bucket) left join s using (bucket) left join t using (bucket), total),
        summed as (select doc_id, sum(n * gain)::bigint as gains, sum(n)::bigint as n from doc_feature join bucketed using (f) join gain using (bucket) group by doc_id),
        weighed as (select doc_id, len(w) as n_words, coalesce(n, 0) as n_features,
            coalesce((gains - ((gains % n) + n) % n) // n, 0)::bigint as weight, ('0x' || sha256('7:' || doc_id)[:8])::bigint as h
            from words left join summed using (doc_id)),
        scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from weighed),
        drawn as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_words >= 20),
        share as (select 25 * count(*) // 100 as k from drawn)
        select doc_id, n_features, weight, score, case when rank <= k then rank end as rank from scored left join drawn using (doc_id), share""",
    "op13_decontamination": rf"""
        with words as (select doc_id, {WORDS_SQL} as w from documents),
        item as (select item_id, {WORDS_SQL} as w from benchmark),
        item_window as (select distinct item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as x
            from (select *, least(len(w), 10) as m from item where len(w) > 0)),
        doc_window as (select doc_id, m, unnest(range(0, len(w) - m + 1)) as place,
            unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as x
            from words, (select distinct m from item_window)),
        hit as (select distinct doc_id, m, place, x from doc_window semi join item_window using (m, x)),
        covered as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(place, place + m)) as i from hit) group by doc_id),
        held as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
            from (select distinct doc_id, item_id::varchar as id from hit join item_window using (m, x)) group by doc_id)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 as contaminated
        from words left join covered using (doc_id) left join held using (doc_id)""",
}
