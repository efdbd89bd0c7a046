"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import work_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), work_path(spark, "token-rollup"), {"byte_bpe_50k": tokenizer_file(), "words": None}).totals()


def token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup by words alone, which SQL can count."""
    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), work_path(spark, "token-rollup"), {"words": None}).totals()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import digest, line_dedup

    return digest(line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), again=32))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(_read(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every url, and the verdicts that are a rule's."""
    from pyspark.sql import functions as F

    from .url_filter import judge_urls

    judged = judge_urls(_read(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"))


def depleted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules under limits that small hosts reach, where the lines that a host repeats decide."""
    from .quality_rules import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"), min_docs=5, max_share=0.1, min_left=0.8)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_texts", "class_size")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), tokenizer_file())


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming_join import minhash_groups

    return minhash_groups(_read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import digest, periodic_runs, with_repeats

    return digest(periodic_runs(with_repeats(_read(spark, sf_dir, "documents"))))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .whitening import whitened

    # null where the exact sum is beyond a long
    return whitened(_read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def embedding_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact scatter n·XᵀX − SSᵀ of the embeddings, entry by entry."""
    from .whitening import scatter

    found = scatter(_read(spark, sf_dir, "embeddings"))
    d = range(len(found.sums))
    # a row for each pair of dimensions, whatever the number of vectors
    return spark.createDataFrame([(i, j, found.n, int(found.matrix[i, j])) for i in d for j in d], "i int, j int, n long, scatter long")


def embedding_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each embedding is from the mean, exactly: one row per vector of the whitening."""
    from .whitening import whitened

    return whitened(_read(spark, sf_dir, "embeddings"), components=1).selectExpr("vec_id", "n", "try_cast(deviation as bigint) as deviation")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_substring_dedup, op3_line_dedup, op4_exact_dedup, op5_quality_classifier, op6_url_filter, op7_quality_rules, op8_ngram_join, op9_mixing, op10_packing, op11_minhash_dedup, op12_periodic_runs, op13_embedding_whitening, embedding_scatter, embedding_deviation, pipeline, token_counts_words, url_rules, depleted_documents)}

#: Fixed value: words of a text.
WORD = r"'[^\x20\x09-\x0D]+'"

OP2 = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) as w from documents),
r as (select row_number() over () as r, doc_id, w from d),
x as (select r, i, array_to_string(list_slice(w, i, i + 34), ' ') as t from (select r, w, unnest(range(1, len(w) - 33)) as i from r)),
s as (select r, i from x where t in (select t from x group by t having count(*) > 1)),
c as (select distinct r, i + j as p from s, range(0, 35) as o(j)),
k as (select r, list(p) as ps from c group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
 sha256(array_to_string(list_filter(w, lambda v, i: not list_contains(coalesce(ps, []), i)), ' ')) as kept_sha256
from r left join k using (r)
"""

OP3 = r"""
with l as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from l),
k as (select r, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
o as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
j as (select k.*, coalesce(doc_id > owner, false) as gone from k left join o using (key)),
a as (select r, doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as kept from j group by r, doc_id)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from a
"""

OP4 = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
 doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d
"""

OP7 = rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {WORD}) as w from documents),
ws as (select r, i, array_to_string(list_slice(w, i, i + 7), ' ') as g from (select r, w, unnest(range(1, len(w) - 6)) as i from d)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as n from ws) where n > 1),
cov as (select r, count(distinct i + j) as n from rep, range(0, 8) as o(j) group by r),
ln as (select r, source, unnest(string_split(t, chr(10))) as line from d),
full_lines as (select r, source, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key,
 len(regexp_extract_all(line, {WORD})) as n from ln where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct line) as n from full_lines group by r),
hosts as (select source, count(*) as docs from d group by source),
often as (select f.source, f.key from (select source, key, count(distinct r) as n from full_lines group by source, key) f
 join hosts h on f.source is not distinct from h.source where f.n > 20 and f.n > h.docs * cast(0.1 as double)),
lost as (select f.r, sum(f.n) as n from full_lines f join often o on f.key = o.key and f.source is not distinct from o.source group by f.r),
m as (select d.r, doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
 cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines,
 cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, cast(coalesce(lost.n, 0) as bigint) as n_removed
 from d left join cov on cov.r = d.r left join dup on dup.r = d.r left join lost on lost.r = d.r),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed,
 not base_failed and (n_words - n_removed) >= n_words * cast(0.3 as double) as kept from b
"""

OP9 = rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), {WORD})) as bigint) as size,
  cast('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as draw from documents),
s as (select source, cast(sum(size) as bigint) as n, [3, 1, 2][1 + (row_number() over (order by source is null, source) - 1) % 3] as w from d group by source),
o as (select *, cast(sum(2 * n) over (order by 2.0 * n / w, source rows unbounded preceding) as double) - 2 * n as caps,
  cast(sum(w) over (order by 2.0 * n / w desc, source desc rows unbounded preceding) as double) as ws, 1.5 * sum(n) over () as total from s),
f as (select *, 2.0 * n < (total - caps) * w / ws as clamped from o),
l as (select coalesce(sum(2 * n) filter (clamped), 0) as c, cast(sum(w) filter (not clamped) as double) as ws from f),
t as (select source, n, case when clamped then 2.0 * n else (total - c) * w / l.ws end as target from f, l),
x as (select d.*, n, target, case when n = 0 then 0 else floor(target / n) end as whole,
  sum(size) over (partition by d.source order by draw, doc_id rows unbounded preceding) - size as below
  from d join t on d.source is not distinct from t.source)
select doc_id, size, n as source_size, cast(target as double) as target,
 cast(size * (whole + case when target - whole * n > 0 and 2 * below + size <= 2 * (target - whole * n) then 1 else 0 end) as bigint) as taken from x
"""

#: The limits of ``depleted_documents``.
DEPLETED = OP7.replace("f.n > 20", "f.n > 5").replace("cast(0.3 as double)", "cast(0.8 as double)")

TOKEN_WORDS = rf"""
select source, lang, 'words' as version, count(*) as docs, cast(sum(len(regexp_extract_all(coalesce(text, ''), {WORD}))) as bigint) as tokens,
 cast(sum(length(coalesce(text, ''))) as bigint) as chars from documents group by source, lang
"""

URL_RULES = r"""
with p as (select row_number() over () as r, page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
k(verdict, h, s) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f as (select r, arg_max(h || s, length(h || s)) as rule, arg_max(verdict, length(h || s)) as verdict from p join k on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by r)
select page_id, host, path, rule, verdict from p left join f using (r)
"""

OP8 = rf"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) as w from documents),
t as (select r, doc_id, w, array_to_string(w, ' ') as body, min(r) over (partition by array_to_string(w, ' ')) as rep, count(*) over (partition by array_to_string(w, ' ')) as copies from d),
u as (select r, w, copies from t where r = rep and len(w) > 0),
s as (select distinct r, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(list_slice(w, i, i + 4), ' ') end as g from (select r, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from u)),
n as (select r, count(*) as n from s group by r),
b as (select x.r as a, y.r as b, count(*) as m from s x join s y on x.g = y.g and x.r < y.r group by x.r, y.r),
l as (select b.a, b.b from b join n na on na.r = b.a join n nb on nb.r = b.b where 5 * b.m >= 4 * (na.n + nb.n - b.m)),
e as (select a, b from l union all select b, a from l),
c(r, x) as (select a, b from e union select c.r, e.b from c join e on e.a = c.x),
top as (select r, least(r, min(x)) as top from c group by r),
links as (select e.a as r, sum(u.copies) as n, count(*) as texts from e join u on u.r = e.b group by e.a),
a as (select t.*, coalesce(top.top, t.rep) as class, coalesce(links.n, 0) as n, coalesce(links.texts, 0) as texts from t left join top on top.r = t.rep left join links on links.r = t.rep)
select doc_id, min(doc_id) over (partition by class) as class_id, cast(case when len(w) = 0 then 0 else n + copies - 1 end as bigint) as n_links,
 cast(texts as bigint) as n_texts, count(*) over (partition by class) as class_size from a
"""

OP11 = rf"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) as w from documents),
s as (select distinct r, g from (select r, unnest(case when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from d)),
n as (select r, count(*) as n, string_agg(g, chr(10) order by g) as body from s group by r),
t as (select r, n, min(r) over (partition by body) as rep from n),
u as (select s.r, s.g, t.n from s join t on s.r = t.rep and t.r = t.rep),
b as (select x.r as a, y.r as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as m from u x join u y on x.g = y.g and x.r < y.r and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by x.r, y.r),
l as (select a, b from b where 100 * m >= 80 * (na + nb - m)),
e as (select a, b from l union all select b, a from l),
c(r, x) as (select a, b from e union select c.r, e.b from c join e on e.a = c.x),
top as (select r, least(r, min(x)) as top from c group by r),
a as (select d.r, doc_id, coalesce(t.n, 0) as n, coalesce(top.top, t.rep, d.r) as class from d left join t using (r) left join top on top.r = t.rep)
select doc_id, n as n_shingles, min(doc_id) over (partition by class) as component_id, coalesce(doc_id = min(doc_id) over (partition by class), doc_id is null and min(doc_id) over (partition by class) is null) as kept from a
"""

#: Entries of the usable embeddings as whole numbers.
ENTRIES = r"""
with v as (select row_number() over () as r, vec_id, embedding from embeddings where embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
e as (select r, vec_id, generate_subscripts(embedding, 1) as i, cast(floor(1024 * cast(unnest(embedding) as double)) as bigint) + 100000 as x from v),
s as (select i, count(*) as n, sum(x) as s from e group by i)
"""

EMBEDDING_SCATTER = rf"""{ENTRIES}
select cast(a.i - 1 as int) as i, cast(b.i - 1 as int) as j, s.n, cast(s.n * sum(cast(a.x as hugeint) * b.x) - cast(s.s as hugeint) * t.s as bigint) as scatter
from e a join e b on a.r = b.r join s on s.i = a.i join s t on t.i = b.i group by a.i, b.i, s.n, s.s, t.s
"""

EMBEDDING_DEVIATION = rf"""{ENTRIES}
select vec_id, n, cast(sum((n * x - s) * (n * x - s)) as bigint) as deviation from e join s using (i) group by r, vec_id, n
"""

ORACLES = {"op11_minhash_dedup": OP11, "embedding_scatter": EMBEDDING_SCATTER, "embedding_deviation": EMBEDDING_DEVIATION, "op8_ngram_join": OP8, "token_counts_words": TOKEN_WORDS, "url_rules": URL_RULES, "depleted_documents": DEPLETED, "op2_substring_dedup": OP2, "op3_line_dedup": OP3, "op4_exact_dedup": OP4, "op7_quality_rules": OP7, "op9_mixing": OP9}
