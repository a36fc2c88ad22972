"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.llm import ann, collocations, fim, hmm, jaccard, langid, packing, pieces, pii, simhash, token_counts, topk, warc
from recordweave.llm.common import new_folder, read, tokenizer_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.concat_and_cut(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), length=1024)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), distance=4, width=4)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{pii.KINDS[kind]}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *map(count, range(4)), F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest_codes(topk.codes_of(read(spark, sf_dir, "embeddings")), k=10, every=100)


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, decodes them again and compares."""
    path = tokenizer_path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    back = pieces.decode(pieces.encode(docs, path, carry=("text_crc32",)), path)
    return back.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "text_crc32", (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_warc(read(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(read(spark, sf_dir, "documents"), width=5, least=(4, 5)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), top=2000, least=100)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(read(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_language_id, op3_simhash, op4_pii, op5_ann, op6_hamming_topk, op7_hmm, op8_token_counts, op9_sentencepiece, op10_warc, op11_jaccard_join, op12_collocations, op13_fill_in_middle, pipeline)
}

ORACLE_SQL = {
    "op6_hamming_topk": """
        with v as (select distinct vec_id, embedding from embeddings
                   where vec_id is not null and embedding is not null
                     and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
                     and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        d as (select q.vec_id as query_id, c.vec_id,
                     min(list_sum(list_transform(range(1, 65), lambda i: case when (q.embedding[i] > 0) <> (c.embedding[i] > 0) then 1 else 0 end)))::int as distance
              from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id group by all)
        select query_id, (row_number() over (partition by query_id order by distance, vec_id))::int as rank, vec_id, distance
        from d qualify row_number() over (partition by query_id order by distance, vec_id) <= 10""",
    "op11_jaccard_join": r"""
        with recursive t as (select row_number() over () as row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select row, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end as s from t),
        nodes as (select s, min(row) as node, len(s) as n from s where len(s) > 0 group by s),
        one as (select node, n, unnest(s) as x from nodes),
        shared as (select a.node as a, b.node as b, a.n as an, b.n as bn, count(*) as c from one a join one b on a.x = b.x and a.node < b.node and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) group by all),
        links as (select a, b from shared where 100 * c >= 80 * (an + bn - c)),
        ways as (select a, b from links union all select b, a from links),
        reach as (select node as a, node as b from nodes union select r.a, l.b from reach r join ways l on l.a = r.b),
        least_id as (select r.a as node, min(s.doc_id) as component_id from reach r join nodes n on n.node = r.b join s on s.s = n.s group by r.a)
        select s.doc_id, len(s.s)::bigint as n_shingles, case when len(s.s) = 0 then s.doc_id else l.component_id end as component_id
        from s left join nodes n on n.s = s.s left join least_id l on l.node = n.node""",
    "op12_collocations": r"""
        with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
        worded as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
        totals as (select lang, sum(len(w))::hugeint as n from worded group by lang),
        grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as p from worded, range(1, 6) ks(k) where len(w) >= k),
        f as (select lang, k, p, count(*)::hugeint as a from grams group by all having count(*) >= 100),
        held as (select distinct s.lang, s.p from f s join f g on g.lang = s.lang and g.k > s.k and 100 * g.a >= 100 * s.a and contains(' ' || g.p || ' ', ' ' || s.p || ' ') where s.k > 1),
        cuts as (select c.lang, c.p, c.a, n, i, l.a as l, r.a as r, (1000 * c.a * n) // (l.a * r.a) as score
                 from f c join totals using (lang), range(1, 5) ks(i), f l, f r
                 where c.k > i and l.lang = c.lang and r.lang = c.lang and l.p = array_to_string(string_split(c.p, ' ')[1:i], ' ') and r.p = array_to_string(string_split(c.p, ' ')[i + 1:], ' ')),
        worst as (select * from cuts qualify row_number() over (partition by lang, p order by score, i) = 1),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, p) as rank from worst anti join held using (lang, p))
        select lang, rank, p as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000""",
    "op13_fill_in_middle": r"""
        with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as d,
                          regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w from documents),
        h as (select *, len(w)::bigint as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from t),
        f as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
                             when h4 % 100 < 80 then 'spm' else 'psm' end as form,
                     least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from h),
        p as (select *, coalesce(array_to_string(w[1:a], ''), '') as pre, coalesce(array_to_string(w[a + 1:b], ''), '') as mid, coalesce(array_to_string(w[b + 1:n], ''), '') as suf from f)
        select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
               sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
               sha256(text) as restored_sha256 from p""",
}
