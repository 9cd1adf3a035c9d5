"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counts, ctph, hosts, langid, mixing, omh, packing, pages, resampling, spelling, substring, warc, zclass


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return substring.dedup(docs, columns=("doc_id",)).drop("kept")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.neighbours(_read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_read(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"))


def _remainder(m: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % m


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(_remainder(4) != 2))
    return langid.identify(docs, profiles, others={"doc_id": "doc_id", "held_out": F.coalesce(_remainder(4) == 2, F.lit(False))})


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_read(spark, sf_dir, "pages"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hosts.judged(_read(spark, sf_dir, "documents"), others={"doc_id": "doc_id"})
    return judged.select("doc_id", *[x.split()[0] for x in hosts.STATISTICS.split(", ")], "base_failed", "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = zclass.fit(docs, labels.where(_remainder(5) != 0))
    scored = zclass.scored(docs, model, others={"doc_id": "doc_id", "held_out": F.coalesce(_remainder(5) == 0, F.lit(False))})
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", mixing.words("text").alias("tokens"))
    docs = mixing.topics(docs, _read(spark, sf_dir, "embeddings"))
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("mix_label")}
    out = mixing.mixed(docs, margins, F.col("tokens"), "doc_id")
    return out.select("doc_id", "tokens", F.col("mix_topic").alias("topic"), F.round("mix_probability", 9).alias("probability"), F.col("mix_kept").alias("kept"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classes(_read(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resampled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = (op1_substring_dedup, op2_fingerprints, op3_html_extraction, op4_packing, op5_language_id, op6_warc, op7_host_rules, op8_quality_classifier, op9_mixing, op10_order_minhash, op11_importance_resampling, op12_token_counts, op13_spelling_variants)
    return {f.__name__: f for f in every} | {"pipeline": pipeline}


_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

OP1_SQL = rf"""with w as (select doc_id, {_WORDS} as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
f as (select g, min(doc_id) as d from win group by 1),
gone as (select distinct doc_id, i + k as p from win join f using (g), range(13) t(k) where d < doc_id),
pos as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as word from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n from pos anti join gone using (doc_id, p) group by 1)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from w left join kept using (doc_id)"""

OP7_SQL = rf"""with w as (select doc_id, source, coalesce(text, '') as text, {_WORDS} as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
again as (select doc_id, g from win group by 1, 2 having count(*) > 1),
rep as (select doc_id, count(distinct i + k) as n from win join again using (doc_id, g), range(5) t(k) group by 1),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from w),
dup as (select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
s as (select doc_id, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from w left join dup using (doc_id) left join rep using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s),
h as (select source, count(*) as n, count(*) filter (where base_failed) as fails from b group by 1),
m as (select sum(fails) / sum(n) as mean, var_pop(fails / n) as var, avg(1.0 / n) as noise, sum(n) as total from h),
q as (select mean, least(case when var - mean * (1 - mean) * noise > 0 then greatest(mean * (1 - mean) / (var - mean * (1 - mean) * noise) - 1, 1.0) else total end, total) as weight from m),
bad as (select source from h, q where (fails + case when mean > 0 and mean < 1 then mean * weight else 0.5 end) / (n + case when mean > 0 and mean < 1 then weight else 1.0 end) > {hosts.MOST_FAILED})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not exists (select 1 from bad where bad.source is not distinct from b.source) as kept from b"""


def _op9_sql() -> str:
    margins = ("source", "lang", "topic")
    parts = [
        rf"d as (select doc_id, coalesce(source, '{mixing.NONE}') as source, coalesce(lang, '{mixing.NONE}') as lang, coalesce(cast(label as varchar), '{mixing.NONE}') as topic, len({_WORDS}) as tokens from documents left join (select vec_id, min(label) as label from embeddings group by 1) on vec_id = doc_id)",
        "c0 as (select source, lang, topic, sum(tokens) as tokens, cast(sum(tokens) as double) as weight from d group by 1, 2, 3)",
        "whole as (select sum(tokens) as total from d)",
    ]
    for m in margins:
        parts.append(f"goal_{m} as (select {m}, pow(t, {mixing.TEMPER}) / sum(pow(t, {mixing.TEMPER})) over () as share from (select {m}, cast(sum(tokens) as double) as t from d group by 1 having sum(tokens) > 0))")
    for i in range(3 * mixing.ROUNDS):
        m = margins[i % 3]
        parts.append(f"c{i + 1} as (select c{i}.source, c{i}.lang, c{i}.topic, tokens, weight * coalesce(share * total / nullif(sum(weight) over (partition by c{i}.{m}), 0), 0) as weight from c{i} left join goal_{m} using ({m}), whole)")
    last = f"c{3 * mixing.ROUNDS}"
    parts.append(f"r as (select source, lang, topic, weight / nullif(tokens, 0) as rate from {last})")
    parts.append("t as (select max(rate) as scale from r)")
    parts.append("p as (select doc_id, tokens, topic, least(1.0, coalesce(rate / scale, 1.0)) as probability from d join r using (source, lang, topic), t)")
    return "with " + ",\n".join(parts) + f"\nselect doc_id, tokens, topic, round(probability, 9) as probability, cast('0x' || substr(md5('0:' || doc_id), 1, 13) as ubigint) / {mixing._STEPS}.0 < probability as kept from p"


#: CRC-32 by its table, over the bytes of ``{0}``.
_CRC_TABLE = "select list(t order by i) as crcs from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as t from range(256) r(i))"
_BYTES = "list_transform(range(1, length(hex(encode({0}))) + 1, 2), lambda i: cast('0x' || substr(hex(encode({0})), i, 2) as bigint))"
_CRC = "xor(list_reduce(list_prepend(4294967295, " + _BYTES + "), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"
_SMALL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op11_sql() -> str:
    words = "coalesce(regexp_extract_all(" + _SMALL.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    both = "unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))"
    return rf"""with crc as ({_CRC_TABLE}),
d as (select doc_id, {words} as ws from documents),
f as (select doc_id, {both} as g from d),
y as (select {both} as g from (select {words} as ws from benchmark)),
b as (select g, {_CRC.format("g")} % {resampling.BUCKETS} as bucket from (select g from f union select g from y), crc),
s as (select bucket, cast(count(*) as double) as s from f join b using (g) group by 1),
t as (select bucket, cast(count(*) as double) as t from y join b using (g) group by 1),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((select count(*) from f) + {resampling.BUCKETS}.0::double) / ((s + 1) * ((select count(*) from y) + {resampling.BUCKETS}.0::double)))) as gain from s left join t using (bucket)),
w as (select doc_id, count(*) as n_features, floor(sum(gain) / count(*)) as weight from f join b using (g) join gain using (bucket) group by 1),
r as (select doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
  cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{resampling.SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score from d left join w using (doc_id)),
o as (select doc_id, row_number() over (order by score desc, doc_id) as place, {resampling.PERCENT} * count(*) over () // 100 as draw from r where n_words >= {resampling.LEAST_WORDS})
select doc_id, n_features, weight, score, case when place <= draw then place end as rank from r left join o using (doc_id)"""


def _op13_sql() -> str:
    return rf"""with recursive crc as ({_CRC_TABLE}),
runs as (select doc_id, run, count(*) as k from (select doc_id, unnest(regexp_extract_all({_SMALL.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents) group by 1, 2),
h as (select run, k, {_CRC.format("(coalesce(cast(doc_id as varchar), '') || ':' || run)")} as h from runs, crc),
w as (select case when h % {spelling.DROP} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k from h),
words as (select word, cast(sum(k) as bigint) as n from w where length(word) >= {spelling.LETTERS} group by 1 having sum(k) >= {spelling.LEAST}),
less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from words, range(1, length(word) + 1) r(i)),
near as (select a.word, b.word as other, b.n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, max(n) as top from near group by 1),
form as (select word, min(other) as form, any_value(near.n) as form_n from near join best using (word) join words using (word) where near.n = top and top >= {spelling.TIMES} * words.n group by 1),
up as (select word, form as root, 1 as step from form union all select up.word, form.form, step + 1 from up join form on form.word = up.root),
ends as (select word, arg_max(root, step) as root from up group by 1)
select word, n, coalesce(n_near, 0) as n_near, form, form_n, coalesce(root, word) as root from words left join best using (word) left join form using (word) left join ends using (word)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op7_host_rules": OP7_SQL, "op9_mixing": _op9_sql(), "op11_importance_resampling": _op11_sql(), "op13_spelling_variants": _op13_sql()}
