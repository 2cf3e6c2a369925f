"""One query for each operator over the tables of a directory, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byterepeats, media, minhash, mixing, packing, secrets, tokencount, topk, toxicity, wordrepeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after personal data in them are replaced by a mark."""
    return tokencount.edited_counts(table(spark, sf_dir, "documents"))


def op4_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byterepeats.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Target shares of the languages' tokens.
LANGUAGE_WEIGHTS = {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13}


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the documents that the labelled table covers."""
    return docs.select("doc_id", docs["lang"].alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, language_labels(docs, table(spark, sf_dir, "labels")), LANGUAGE_WEIGHTS)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, values = secrets.train_forest(secrets.labelled_findings(spark)), secrets.train_values(secrets.assigned_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), keys, values_forest=values)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op10_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordrepeats.remove_repeated_words(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_packing, op3_token_counts, op4_byte_repeats, op5_toxicity, op6_minhash, op7_mixing, op8_secrets, op9_media, op10_word_repeats)}

#: Words of each document, as the operators take them.
WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op1_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score
            from v q join v c on q.vec_id <> c.vec_id
            where q.vec_id % 20 = 0
        ), r as (
            select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
            from s
        )
        select query_id, rank, vec_id, score from r where rank <= 20
    """,
    "op4_byte_repeats": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        p as (select doc_id, unnest(list_transform(range(0, len(h) // 2), lambda i: {'i': i, 's': substr(h, 2 * i + 1, 100)})) as p from d),
        w as (select doc_id, p.i as i, substr(p.s, 1, 2) as b, case when len(p.s) = 100 then md5(p.s) end as k from p),
        low as (select k, min(doc_id) as low from w where k is not null group by k),
        f as (select w.doc_id, w.i, w.b, low.low < w.doc_id as hit from w left join low using (k)),
        c as (select doc_id, i, b, coalesce(max(case when hit then i end) over (partition by doc_id order by i rows between 49 preceding and current row), -1) >= 0 as gone from f),
        g as (select doc_id, i, b, gone, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from c),
        s as (
            select doc_id, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans,
                   string_agg(b, '' order by i) filter (not gone) as kept
            from g group by doc_id
        )
        select d.doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
        from d left join s using (doc_id)
    """,
    "op6_minhash": f"""
        with recursive d as (
            select doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
        ), sh as (
            select distinct doc_id, s from (
                select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                           when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d)
        ), n as (select doc_id, count(*) as n from sh group by doc_id),
        both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
        links as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        reach as (select doc_id as id, doc_id as r from documents union select l.b, q.r from reach q join links l on l.a = q.id),
        comp as (select id, min(r) as component_id from reach group by id)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, component_id = d.doc_id as kept
        from d left join n using (doc_id) join comp on comp.id = d.doc_id
    """,
    "op10_word_repeats": f"""
        with d as (select doc_id, {WORDS.format(text="coalesce(text, '')")} as w from documents),
        p as (select doc_id, unnest(range(1, len(w) + 1)) as i, w from d),
        k as (select doc_id, i, w[i] as word, case when i + 49 <= len(w) then md5(array_to_string(w[i:i + 49], ' ')) end as k from p),
        low as (select k, min(doc_id) as low from k where k is not null group by k),
        f as (select k.doc_id, k.i, k.word, low.low < k.doc_id as hit from k left join low using (k)),
        c as (select doc_id, i, word, coalesce(max(case when hit then i end) over (partition by doc_id order by i rows between 49 preceding and current row), 0) > 0 as gone from f),
        s as (select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from c group by doc_id)
        select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from d left join s using (doc_id)
    """,
}
