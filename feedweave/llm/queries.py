"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import fold
from feedweave.llm.decontam import contaminated
from feedweave.llm.exact import exact_dedup
from feedweave.llm.langid import identify, train
from feedweave.llm.lines import line_duplicates
from feedweave.llm.lm import score
from feedweave.llm.mixing import plan, realise
from feedweave.llm.phrases import collocations
from feedweave.llm.quality import quality
from feedweave.llm.resample import resample
from feedweave.llm.sharding import interleave
from feedweave.llm.simhash import simhash
from feedweave.llm.suffix import remove_repeats
from feedweave.llm.warc import archive_path, read_archive, write_archive


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_logbilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 1).alias("held_out"))
    return score(docs, docs.where("not held_out"), keep=["doc_id", "held_out"])


def op2_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    return identify(docs, train(docs.where("not held_out")), keep=["doc_id", "held_out"])


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources = plan(read(spark, sf_dir, "documents"))
    return realise(rows, sources)


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interleave(read(spark, sf_dir, "documents"), 24, payload=["doc_id"])
    return found.select("doc_id", (F.col("_bytes") + 8).alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_hash").alias("class_id"), "n_lines", "n_exact", "n_near", "n_links", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive_path(spark)
    write_archive(read(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_logbilinear_lm": op1_logbilinear_lm,
    "op2_naive_bayes_langid": op2_naive_bayes_langid,
    "op3_latent_decontamination": op3_latent_decontamination,
    "op4_temperature_mix": op4_temperature_mix,
    "op5_simhash_trie": op5_simhash_trie,
    "op6_quality_rules": op6_quality_rules,
    "op7_interleaved_shards": op7_interleaved_shards,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_line_edit_join": op9_line_edit_join,
    "op10_warc_segments": op10_warc_segments,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_collocations": op12_collocations,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_temperature_mix": r"""
        with recursive t as (
            select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 as bigint) as n_tokens from documents),
        s as (select source, cast(sum(n_tokens) as bigint) as tokens from t group by source),
        p as (select source, tokens, tokens / cast((select sum(tokens) from s) as double) as share from s),
        bisect(step, lo, hi) as (
            select 0, 0.0::double, 1.0::double
            union all
            select step + 1, case when ok then mid else lo end, case when ok then hi else mid end from (
                select b.step, b.lo, b.hi, (b.lo + b.hi) / 2 as mid,
                       (select ln(sum(pow(share, (b.lo + b.hi) / 2))) - (b.lo + b.hi) / 2 * sum(pow(share, (b.lo + b.hi) / 2) * ln(share)) / sum(pow(share, (b.lo + b.hi) / 2)) from p)
                           >= 0.9 * (select ln(count(*)) from p) as ok
                from bisect b where b.step < 40)),
        a as (select case when (select ln(sum(share)) - sum(share * ln(share)) / sum(share) from p) >= 0.9 * (select ln(count(*)) from p) then 1.0
                          else (select round(lo, 6) from bisect where step = 40) end as alpha),
        w as (select source, tokens, cast(floor(pow(share, alpha) / (select sum(pow(share, alpha)) from p, a) * (select sum(tokens) from s)) as bigint) as budget from p, a),
        plan as (select source, budget // tokens as full_blocks, budget % tokens as rest from w),
        rows as (select t.*, full_blocks, rest, unnest(range(0, full_blocks + 1)) as block from t join plan using (source)),
        placed as (select *, cast('0x' || substr(md5('11:' || block || ':' || doc_id), 1, 15) as bigint) as place from rows),
        summed as (select *, sum(n_tokens) over (partition by source, block order by place range between unbounded preceding and current row) - n_tokens as before from placed)
        select doc_id, source, n_tokens, block, place from summed where block < full_blocks or before < rest""",
    "op7_interleaved_shards": r"""
        with tbl as (select list_transform(range(256), lambda i: list_reduce(list_prepend(cast(i as bigint), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))) as t),
        d as (select doc_id, source, coalesce(text, '') as body, cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as key from documents),
        c as (select doc_id, source, key, cast(strlen(body) + 8 as bigint) as size,
                     xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: cast('0x' || h as bigint))),
                                     lambda x, b: xor(x >> 8, t[xor(x & 255, b) + 1])), 4294967295) as text_crc32 from d, tbl),
        r as (select *, row_number() over (partition by source order by key, doc_id nulls first, text_crc32) - 1 as k, count(*) over (partition by source) as n from c),
        g as (select *, row_number() over (order by (2 * k + 1) / (2 * n), source nulls first, key, doc_id nulls first, text_crc32) - 1 as pos, count(*) over () as total from r),
        e as (select *, total // 24 as q, total % 24 as m from g)
        select doc_id, size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law,
               cast(case when pos < m * (q + 1) then pos // (q + 1) else m + (pos - m * (q + 1)) // greatest(q, 1) end as int) as shard,
               cast(case when pos < m * (q + 1) then pos % (q + 1) else (pos - m * (q + 1)) % greatest(q, 1) end as bigint) as slot,
               cast(null as int) as grown_shard
        from e""",
    "op10_warc_segments": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        q as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha1(body) as payload_digest,
                     max(page_id) over (partition by body) as last from p)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes < 1000 or last is null or page_id = last then 'response' else 'revisit' end as record_type,
               case when payload_bytes < 1000 or last is null or page_id = last then null else last end as refers_to
        from q""",
    "op11_importance_resampling": r"""
        with tbl as (select list_transform(range(256), lambda i: list_reduce(list_prepend(cast(i as bigint), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))) as t),
        d as (select doc_id, false as aim, text from documents union all select null, true, text from benchmark),
        w as (select doc_id, aim, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from d),
        g as (select doc_id, aim, w, unnest(range(1, len(w) + 1)) as i from w),
        f as (select doc_id, aim, w[i] as f from g union all select doc_id, aim, w[i] || ' ' || w[i + 1] from g where i < len(w)
              union all select doc_id, aim, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from g where i + 1 < len(w)),
        u as (select f, sum(case when aim then 0 else 1 end) as s, sum(case when aim then 1 else 0 end) as t from f group by f),
        c as (select f, s, u.t, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: cast('0x' || h as bigint))),
                        lambda x, b: xor(x >> 8, tbl.t[xor(x & 255, b) + 1])), 4294967295) % 10000 as bucket from u, tbl),
        b as (select bucket, sum(s) as s, sum(t) as t from c group by bucket),
        k as (select bucket, cast(floor(1000 * ln((t + 1)::double * ((select sum(s) from b) + 10000) / ((s + 1)::double * ((select sum(t) from b) + 10000)))) as bigint) as gain from b),
        v as (select doc_id, count(*) as n_features, sum(gain) as weight from f join c using (f) join k using (bucket) where not aim group by doc_id),
        x as (select w.doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, cast('0x' || substr(sha256('42:' || w.doc_id), 1, 8) as bigint) as h from w left join v on w.doc_id = v.doc_id where not aim),
        y as (select *, weight + cast(floor(-1000.0 * ln(-ln((h + 0.5) / 4294967296.0))) as bigint) as score from x),
        z as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as r, count(*) over (partition by n_words >= 20) as n from y)
        select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score, case when n_words >= 20 and r <= 5 * n // 100 then r end as rank from z""",
    "op12_collocations": r"""
        with p as (select coalesce(lang, 'und') as lang, row_number() over () as piece, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as body from documents),
        q as (select lang, row_number() over () as piece, regexp_extract_all(body, '[^\x20\x09]+') as w from p),
        t as (select lang, piece, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from q),
        n as (select lang, count(*) as n from t group by lang),
        s as (select lang, piece, pos, word, lead(word, 1) over (partition by piece order by pos) as w2, lead(word, 2) over (partition by piece order by pos) as w3, lead(word, 3) over (partition by piece order by pos) as w4 from t),
        g as (select lang, [word] as ids from s
              union all select lang, [word, w2] from s where w2 is not null
              union all select lang, [word, w2, w3] from s where w3 is not null
              union all select lang, [word, w2, w3, w4] from s where w4 is not null),
        f as (select lang, ids, count(*) as n from g group by lang, ids having count(*) >= 30),
        c as (select lang, ids, n as a, unnest(range(1, len(ids))) as k from f where len(ids) > 1),
        x as (select c.lang, c.ids, a, k, l.n as l, r.n as r, cast(2000000 * cast(a as hugeint) // (cast(l.n as hugeint) + r.n) as bigint) as score
              from c join f l on l.lang = c.lang and l.ids = c.ids[1:k] join f r on r.lang = c.lang and r.ids = c.ids[k + 1:]),
        b as (select lang, ids, a, l, r, score from x qualify row_number() over (partition by lang, ids order by score, k) = 1),
        i as (select lang, ids, a, unnest(range(1, len(ids))) as i from b where len(ids) > 2),
        j as (select *, unnest(range(i + 1, len(ids) + 1)) as j from i),
        h as (select lang, ids[i:j] as ids, a as most from j where j - i + 1 < len(ids)),
        m as (select lang, ids, max(most) as most from h group by lang, ids),
        k as (select b.* from b left join m using (lang, ids) where most is null or 100 * most < 80 * a),
        o as (select lang, array_to_string(ids, ' ') as phrase, a, l, r, score from k),
        z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
        select lang, rank, phrase, a, l, r, n, score from z join n using (lang) where rank <= 2000""",
    "op13_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as body from documents),
        g as (select doc_id, body, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size from d)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(body) as text_sha256 from g""",
}
