"""Queries on text features, strata, ids, dates and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import strata
from ..operators.taxonomy import CATEGORIES, SUBCODES
from ..runtime import spread
from .bindings import bind, cte
from .registry import query

# white space as the JVM's Unicode classes have it, for an engine whose classes are ASCII
WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def bare(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def words(c: str) -> str:
    return f"(case when {bare(c)} = '' then cast([] as varchar[]) else regexp_split_to_array({bare(c)}, '{WS}+') end)"


def n_words(c: str) -> str:
    return f"cast(coalesce(len({words(c)}), 0) as bigint)"


ALPHA = "case when length(content) > 0 then cast(length(regexp_replace(content, '[^\\p{L}]', '', 'g')) as double) / length(content) when content is not null then 0.0 end"
_W = words("lower(content)")
UNIQUE = f"case when len({_W}) > 0 then cast(len(list_distinct({_W})) as double) / len({_W}) when content is not null then 0.0 end"
SENTENCES = "cast(len(regexp_split_to_array(content, '[.!?;]+')) as bigint)"
_SHAPES = [p.replace(r"\s", WS).replace(r"\d", r"\p{Nd}") for p in text.STRUCTURAL]
_SHAPES = [p.replace(f"[\\[\\(].*[\\]\\)]{WS}*$", f"[\\[\\(].*[\\]\\)]{WS}*$") for p in _SHAPES]
STRUCTURAL = "(" + " or ".join(f"regexp_matches(lower({bare('content')}), '{p}')" for p in _SHAPES) + ")"
DENSITY = "round((" + " + ".join(f"cast(contains(lower(coalesce(content, '')), '{k.replace(chr(39), chr(39) * 2)}') as int)" for k in text.LEXICON) + f") / cast(greatest({n_words('content')}, 1) as double), 6)"
QUALITY = f"coalesce(not {STRUCTURAL} and ({ALPHA}) >= 0.55 and ({UNIQUE}) >= 0.30 and {n_words('content')} between 20 and 340 and {SENTENCES} >= 2, false)"
BUCKET = "case when coalesce(y, 0) < 2010 then 'other_year' when y <= 2014 then '2010-2014' when y <= 2019 then '2015-2019' when y <= 2022 then '2020-2022' when y <= 2026 then '2023-2026' else 'other_year' end"
EPOCH = "case when coalesce(y, 0) = 0 then 'unknown' when y <= 2014 then '2010-2014' when y <= 2019 then '2015-2019' when y <= 2022 then '2020-2022' else '2023-2026' end"
YEAR = "coalesce(year(date_envoi), 0)"
# doc_group: rare and blank types are other_doc
STRATA = f"""with base as (select row_id, {n_words('content')} as n_words, {DENSITY} as density, {YEAR} as y, coalesce(type_document, 'unknown') as doc_type
        from corpus where {QUALITY}),
    shares as (select doc_type, count(*) / cast(sum(count(*)) over () as double) as share from base group by doc_type),
    cuts as (select quantile_cont(cast(density as double), 0.25) as a, quantile_cont(cast(density as double), 0.5) as b, quantile_cont(cast(density as double), 0.75) as c from base),
    axes as (select row_id, n_words, density, {BUCKET} as bucket,
            case when {bare('base.doc_type')} = '' or share < 0.005 then 'other_doc' else {bare('base.doc_type')} end as doc_group,
            case when density <= a then 'q0_low' when density <= b then 'q1_med_low' when density <= c then 'q2_med_high' else 'q3_high' end as quartile
        from base join shares on base.doc_type = shares.doc_type cross join cuts),
    strata as (select *, concat(bucket, '__', substring(regexp_replace(doc_group, '[^a-zA-Z0-9_]', '_', 'g'), 1, 30), '__', quartile) as stratum from axes)"""


@query("text_features", f"select row_id, {n_words('content')} as n_words, round({ALPHA}, 6) as alpha_ratio, round({UNIQUE}, 6) as unique_ratio, {SENTENCES} as n_sentences, {STRUCTURAL} as structural from corpus")
def text_features(spark, d):
    m = spread(bind(spark, d, "corpus").select("row_id", "content")).select("row_id", text.measures(F.col("content")).alias("m")).select("row_id", "m.*")
    return m.withColumns({c: F.round(c, 6) for c in ("alpha_ratio", "unique_ratio")})


@query("mechanical_filter", f"select row_id, content from corpus where {QUALITY}")
def mechanical_filter(spark, d):
    return spread(bind(spark, d, "corpus").select("row_id", "content")).where(text.passes_quality(F.col("content")))


@query("keyword_density", f"select row_id, {DENSITY} as density from corpus")
def keyword_density(spark, d):
    return spread(bind(spark, d, "corpus").select("row_id", "content")).select("row_id", text.density(F.col("content")).alias("density"))


@query("density_quartile", STRATA + " select row_id, density, quartile from axes")
def density_quartile(spark, d):
    return strata.axes(bind(spark, d, "corpus")).select("row_id", "density", "quartile")


@query("stratum_counts", STRATA + " select stratum, count(*) as n from strata group by stratum")
def stratum_counts(spark, d):
    return strata.axes(bind(spark, d, "corpus")).groupBy("stratum").agg(F.count("*").alias("n"))


@query("stratum_table", STRATA + " select bucket, doc_group, quartile, count(*) as n, round(cast(sum(cast(round(density * 1000000) as bigint)) as double) / count(*) / 1000000, 6) as mean_density, round(avg(n_words), 6) as mean_words from strata group by bucket, doc_group, quartile")
def stratum_table(spark, d):
    return strata.stratum_table(strata.axes(bind(spark, d, "corpus")))


@query("quartile_medians", STRATA + " select quartile, round(median(density), 6) as median_density, count(*) as n from axes group by quartile")
def quartile_medians(spark, d):
    return strata.axes(bind(spark, d, "corpus")).groupBy("quartile").agg(F.round(F.median("density"), 6).alias("median_density"), F.count("*").alias("n"))


@query("rare_groups", """with t as (select coalesce(type_document, 'unknown') as doc_type from corpus)
    select doc_type, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share, count(*) / cast(sum(count(*)) over () as double) < 0.005 as rare from t group by doc_type""")
def rare_groups(spark, d):
    return strata.type_shares(bind(spark, d, "corpus")).withColumn("share", F.round("share", 6))


@query("content_hash_ids", "select row_id, left(sha256(content), 32) as content_id, md5(document_id) as document_hash from corpus where content is not null")
def content_hash_ids(spark, d):
    c = bind(spark, d, "corpus").where("content is not null")
    return c.select("row_id", text.content_id(F.col("content")).alias("content_id"), F.md5("document_id").alias("document_hash"))


@query("prefix_signature", f"select row_id, substring({bare('content')}, 1, 80) as sig80, substring({bare('content')}, 1, 100) as sig100 from corpus")
def prefix_signature(spark, d):
    c = F.col("content")
    return bind(spark, d, "corpus").select("row_id", text.signature(c, 80).alias("sig80"), text.signature(c, 100).alias("sig100"))


@query("year_bucket", f"select row_id, cast({YEAR} as bigint) as y, {BUCKET.replace('y,', YEAR + ',').replace('y <=', YEAR + ' <=')} as bucket from corpus")
def year_bucket(spark, d):
    y = dates.year_of(F.col("date_envoi"))
    return bind(spark, d, "corpus").select("row_id", y.alias("y"), dates.year_bucket(y).alias("bucket"))


@query("epoch_open", f"select row_id, case when row_id % 50 = 0 then 1995 when row_id % 51 = 0 then 2031 else {YEAR} end as y, {EPOCH} as epoch from (select *, case when row_id % 50 = 0 then 1995 when row_id % 51 = 0 then 2031 else {YEAR} end as y from corpus) c".replace(f"case when row_id % 50 = 0 then 1995 when row_id % 51 = 0 then 2031 else {YEAR} end as y, {EPOCH}", f"cast(y as bigint) as y, {EPOCH}", 1))
def epoch_open(spark, d):
    y = F.when(F.col("row_id") % 50 == 0, 1995).when(F.col("row_id") % 51 == 0, 2031).otherwise(dates.year_of(F.col("date_envoi"))).cast("long")
    return bind(spark, d, "corpus").select("row_id", y.alias("y"), dates.open_epoch(y).alias("epoch"))


_T = "trim(published)"
LENIENT = f"""case when regexp_matches({_T}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_strptime(substring({_T}, 1, 10), '%Y-%m-%d')
    when regexp_matches({_T}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') then try_strptime(substring({_T}, 1, 10), '%d/%m/%Y')
    when regexp_matches({_T}, '^[0-9]{{8}}$') then try_strptime({_T}, '%Y%m%d') end"""


@query("lenient_date", cte("metadata") + f" select row_id, cast(cast({LENIENT} as date) as varchar) as day from metadata")
def lenient_date(spark, d):
    return bind(spark, d, "metadata").select("row_id", dates.lenient_date(F.col("published")).cast("string").alias("day"))


@query("paragraph_rebuild", f"""with l as (select row_id, unnest(regexp_split_to_array(content, chr(10))) as raw, generate_subscripts(regexp_split_to_array(content, chr(10)), 1) as i from corpus where content is not null),
    t as (select row_id, i, {bare('raw')} as x, len(regexp_split_to_array({bare('raw')}, '{WS}+')) as n from l),
    k as (select *, x = '' as blank, x <> '' and n <= 8 and regexp_matches(x, '^[A-ZÉÈÊÀÙÎÔÂÛÏË\\p{{Nd}}\\s\\-–—/&]{{4,}}$') as head,
        x <> '' and n <= 15 and regexp_matches(x, '[.!?;:»]\\s*$') as ends from t),
    b as (select *, coalesce(sum(case when blank or head or ends then 1 else 0 end) over (partition by row_id order by i rows between unbounded preceding and 1 preceding), 0)
        + coalesce(sum(case when head then 1 else 0 end) over (partition by row_id order by i rows between unbounded preceding and current row), 0) as g from k),
    blocks as (select row_id, g, string_agg(x, ' ' order by i) as block, min(i) as first_line from b where not blank group by row_id, g)
    select row_id, cast(row_number() over (partition by row_id order by first_line) - 1 as bigint) as block_no, block from blocks""")
def paragraph_rebuild(spark, d):
    c = spread(bind(spark, d, "corpus").where("content is not null").select("row_id", "content"))
    out = c.select("row_id", F.posexplode(text.rebuild_blocks(F.col("content"))).alias("block_no", "block"))
    return out.withColumn("block_no", F.col("block_no").cast("long"))


@query("paragraph_split", f"""with b as (select doc_id, unnest(regexp_split_to_array(text, '\\n{{2,}}')) as raw from documents where text is not null),
    t as (select doc_id, regexp_replace({bare('raw')}, ' {{2,}}', ' ', 'g') as p from b)
    select doc_id, p as paragraph, {n_words('p')} as n_words from t where {n_words('p')} between 15 and 350""")
def paragraph_split(spark, d):
    p = bind(spark, d, "documents").where("text is not null").select("doc_id", F.explode(text.split_blocks(F.col("text"))).alias("paragraph"))
    return p.withColumn("n_words", text.word_count(F.col("paragraph"))).where("n_words between 15 and 350")


_PARTS = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query("sentence_pack", f"""with recursive s as (select doc_id, {_PARTS} as parts from documents where text is not null),
    p as (select doc_id, i, parts[i] as x, {n_words('parts[i]')} as n from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from s) e),
    f as (select doc_id, i, x as cur, n as total, cast(null as varchar) as done from p where i = 1
        union all
        select f.doc_id, p.i, case when f.total + p.n <= 60 then f.cur || ' ' || p.x else p.x end, case when f.total + p.n <= 60 then f.total + p.n else p.n end,
            case when f.total + p.n <= 60 then null else f.cur end
        from f join p on p.doc_id = f.doc_id and p.i = f.i + 1),
    c as (select doc_id, done as chunk from f where done is not null union all select doc_id, cur from (select *, row_number() over (partition by doc_id order by i desc) as r from f) z where r = 1)
    select doc_id, {bare('chunk')} as chunk from c where {n_words('chunk')} >= 15""")
def sentence_pack(spark, d):
    t = spread(bind(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    return t.select("doc_id", F.explode(text.pack_sentences(F.col("text"), 60, 15)).alias("chunk"))


@query("corpus_paragraphs")
def corpus_paragraphs(spark, d):
    t = spread(bind(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    p = t.select("doc_id", F.explode(text.paragraphs(F.col("text"), True)).alias("content"))
    return p.select(text.content_id(F.col("content")).alias("paragraph_id"), F.md5(F.col("doc_id").cast("string")).alias("document_id"), "content")


def _html_sql(c: str) -> str:
    for tag in text.BOILERPLATE_TAGS:
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    c = f"regexp_replace({c}, '(?i)</?({'|'.join(text.BLOCK_TAGS)})\\b[^>]*>', chr(10), 'g')"
    c = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return bare(f"regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')")


@query("html_to_text", cte("pages") + f" select doc_id, {_html_sql('html')} as body from pages")
def html_to_text(spark, d):
    return bind(spark, d, "pages").select("doc_id", text.html_text(F.col("html")).alias("body"))


@query("page_text", cte("pages") + f", t as (select doc_id, {_html_sql('html')} as body from pages) select doc_id, case when length(body) > 100 then body end as body, case when length(body) > 100 then null else 'html_empty' end as error from t")
def page_text(spark, d):
    """Text of pages, and an error for those with next to none."""
    t = spread(bind(spark, d, "pages").select("doc_id", "html")).select("doc_id", text.page_text(F.col("html")).alias("body"))
    return t.withColumn("error", F.when(F.col("body").isNull(), "html_empty"))


_P = f"{bare('x')}"


def _packed_sql(source: str, most: int, least: int) -> str:
    """Common table expressions that end in ``packed`` (k, i, no, chunk): blocks of ``source`` (k, i,
    block) of at least ``least`` words, those of more than ``most`` in chunks of whole sentences."""
    parts = _PARTS.replace("text", "block")
    return f"""z as (select k, i, block, {n_words('block')} as n from {source}), ps as (select k, i, {parts} as parts from z where n > {most}),
        pp as (select k, i, j, parts[j] as x, {n_words('parts[j]')} as n from (select k, i, parts, unnest(range(1, len(parts) + 1)) as j from ps) e),
        fold as (select k, i, j, x as cur, n as total, cast(null as varchar) as done from pp where j = 1
            union all select f.k, f.i, p.j, case when f.total + p.n <= {most} then f.cur || ' ' || p.x else p.x end, case when f.total + p.n <= {most} then f.total + p.n else p.n end, case when f.total + p.n <= {most} then null else f.cur end
            from fold f join pp p on p.k = f.k and p.i = f.i and p.j = f.j + 1),
        chunks as (select k, i, j, {bare('done')} as chunk from fold where done is not null union all select k, i, j + 1, {bare('cur')} from (select *, row_number() over (partition by k, i order by j desc) as r from fold) y where r = 1),
        packed as (select k, i, 0 as no, block as chunk from z where n between {least} and {most} union all select k, i, j, chunk from chunks where {n_words('chunk')} >= {least})"""


def _blocks_sql(source: str, key: str, column: str) -> str:
    """``blocks`` (k, i, block): between blank lines, or lines where there is no such block."""
    tidy = lambda by: f"list_filter(list_transform(regexp_split_to_array({column}, '{by}'), lambda x: {_P}), lambda x: x <> '')"
    return f"""bs as (select {key} as k, {tidy(chr(92) + 'n{2,}')} as t, {tidy(chr(92) + 'n')} as l from {source} where {column} is not null),
        bb as (select k, case when len(t) > 0 then t else l end as b from bs), blocks as (select k, i, regexp_replace(b[i], ' {{2,}}', ' ', 'g') as block from (select k, b, unnest(range(1, len(b) + 1)) as i from bb) y)"""


INGESTED = f"with recursive {_blocks_sql('documents', 'doc_id', 'text')}, {_packed_sql('blocks', 350, 15)} select k as doc_id, cast(row_number() over (partition by k order by i, no) - 1 as int) as paragraph_no, left(sha256(chunk), 32) as paragraph_id, chunk as content from packed"


@query("corpus_build", f"with recursive {cte('pages').removeprefix('with ')}, texts as (select doc_id, body from (select doc_id, {_html_sql('html')} as body from pages) t where length(body) > 100), {_blocks_sql('texts', 'doc_id', 'body')}, {_packed_sql('blocks', 350, 15)} select left(sha256(chunk), 32) as paragraph_id, md5(cast(k as varchar)) as document_id, chunk as content from packed")
def corpus_build(spark, d):
    """From pages to the paragraphs of a corpus: text, blocks, packing, ids."""
    t = spread(bind(spark, d, "pages").select("doc_id", "html")).select("doc_id", text.page_text(F.col("html")).alias("body"))
    p = t.where("body is not null").select("doc_id", F.explode(text.paragraphs(F.col("body"))).alias("content"))
    return p.select(text.content_id(F.col("content")).alias("paragraph_id"), F.md5(F.col("doc_id").cast("string")).alias("document_id"), "content")


@query("prompt_render", f"""select row_id, concat('<s>[INST] ', 'Classe le paragraphe.', chr(10), chr(10), 'Société : ', coalesce(emetteur, 'Inconnue'), ' | Année : ',
    case when {YEAR} > 0 then cast({YEAR} as varchar) else '2010-2026' end, chr(10), 'Extrait : «', substring(coalesce(content, ''), 1, 600), '»', ' [/INST]') as prompt from corpus""")
def prompt_render(spark, d):
    p = text.prompt(F.col("emetteur"), dates.year_of(F.col("date_envoi")), F.col("content"))
    return bind(spark, d, "corpus").select("row_id", text.chat(F.lit("Classe le paragraphe."), p).alias("prompt"))


@query("taxonomy_block", " union all ".join(f"select '{c}' as code, '{c} ({p}) : {lab.replace(chr(39), chr(39) * 2)} [{', '.join(SUBCODES[c])}]' as line" for c, p, lab in CATEGORIES))
def taxonomy_block(spark, d):
    from ..operators.taxonomy import categories, subcodes

    line = F.concat("code", F.lit(" ("), "pillar", F.lit(") : "), "label_fr", F.lit(" ["), F.array_join(subcodes(F.col("code")), ", "), F.lit("]"))
    return categories(spark).select("code", line.alias("line"))


@query("error_key", f"with e as (select row_id, case row_id % 3 when 0 then concat('score invalide : ', cast(row_id as varchar)) when 1 then 'champ doit être null' else ' message simple ' end as m from corpus) select row_id, {bare('''string_split(string_split(m, ' :')[1], ' doit')[1]''')} as error_key from e")
def error_key(spark, d):
    m = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("score invalide : "), F.col("row_id").cast("string"))).when(F.col("row_id") % 3 == 1, "champ doit être null").otherwise(" message simple ")
    return bind(spark, d, "corpus").select("row_id", text.error_key(m).alias("error_key"))
