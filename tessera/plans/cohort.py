"""Labels, persons, quality and grouped reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import entity, nets
from tessera.operators import groups
from tessera.session import load

from .registry import DEMO_NETS, query, sql_first, sql_net

CATEGORY_SQL = sql_first("text", DEMO_NETS, nets.UNLABELED)
ORDER = [*DEMO_NETS, "never", nets.UNLABELED]
PERSONS = f"""
WITH s AS (SELECT doc_id, source, n_chars, {CATEGORY_SQL} AS category,
  CASE WHEN doc_id % 5 <> 0 THEN source || '::' || CAST(doc_id % 50 AS VARCHAR) ELSE '__unresolved__::' || CAST(doc_id AS VARCHAR) END AS person,
  doc_id % 5 <> 0 AS resolved FROM documents)
"""


def samples(spark, d):
    """Documents as samples with a category, a person key (partly a fallback) and a measure."""
    hay = F.lower("text")
    ok = F.col("doc_id") % 5 != 0
    key = F.when(ok, F.concat_ws("::", "source", (F.col("doc_id") % 50).cast("string"))).otherwise(F.concat(F.lit("__unresolved__::"), F.col("doc_id").cast("string")))
    return load(spark, d, "documents").select("doc_id", "source", "n_chars", nets.first_match(hay, DEMO_NETS).alias("category"), key.alias("person"), ok.alias("resolved"))


def _spread_sql(c: str, p: str) -> str:
    return f"round(avg({c}),6) AS {p}_mean, round(quantile_cont({c},0.5),6) AS {p}_median, round(quantile_cont({c},0.25),6) AS {p}_q1, round(quantile_cont({c},0.75),6) AS {p}_q3, CAST(min({c}) AS BIGINT) AS {p}_min, CAST(max({c}) AS BIGINT) AS {p}_max, count({c}) AS {p}_n"


def breakdown_sql(persons: str, order: list[str]) -> str:
    return (
        persons
        + f"""
, b AS (SELECT category, person, source, n_chars, resolved FROM s UNION ALL SELECT 'TOTAL', person, source, n_chars, resolved FROM s)
, p AS (SELECT category, person, count(*) AS n, count_if(resolved) AS nr FROM b GROUP BY ALL)
, pp AS (SELECT category, count(*) AS n_patients, sum(n) AS n_samples, {_spread_sql("n", "spp")}, sum(nr) AS nsr, count_if(nr > 0) AS npr FROM p GROUP BY category)
, m AS (SELECT category, count(DISTINCT source) AS n_series, {_spread_sql("n_chars", "measure")} FROM b GROUP BY category)
, c AS (SELECT unnest(['{"','".join([*order, "TOTAL"])}']) AS category)
SELECT c.category, CAST(coalesce(n_patients,0) AS BIGINT) AS n_patients, CAST(coalesce(n_samples,0) AS BIGINT) AS n_samples,
  CASE WHEN c.category <> 'TOTAL' THEN CAST(coalesce(n_series,0) AS BIGINT) END AS n_series,
  spp_mean, spp_median, spp_q1, spp_q3, spp_min, spp_max, CAST(coalesce(spp_n,0) AS BIGINT) AS spp_n,
  measure_mean, measure_median, measure_q1, measure_q3, measure_min, measure_max, CAST(coalesce(measure_n,0) AS BIGINT) AS measure_n,
  CAST(coalesce(nsr,0) AS BIGINT) AS n_samples_resolved, CAST(coalesce(npr,0) AS BIGINT) AS n_patients_resolved,
  coalesce(round(nsr * 100.0::DOUBLE / n_samples, 4), 0.0) AS resolution_pct
FROM c LEFT JOIN pp USING (category) LEFT JOIN m USING (category)
"""
    )


@query(breakdown_sql(PERSONS, ORDER))
def breakdown(spark, d):
    out = groups.breakdown(samples(spark, d), "category", "person", "source", "n_chars", "resolved", [*ORDER, groups.TOTAL])
    return groups.in_priority_order(out, "category", [*ORDER, groups.TOTAL])


@query(f"SELECT doc_id, {', '.join(f'{sql_net('text', w)} AS is_{n}' for n, w in DEMO_NETS.items())}, {CATEGORY_SQL} AS category, CAST({' + '.join(f'CAST({sql_net('text', w)} AS INT)' for w in DEMO_NETS.values())} AS INT) AS n_matched FROM documents")
def multi_match(spark, d):
    """All nets that hit, found once; the single flags and the first label follow from the list."""
    docs = load(spark, d, "documents").select("doc_id", nets.all_matches(nets.haystack(F.col("text")), DEMO_NETS).alias("every"))
    return docs.select("doc_id", *[F.array_contains("every", n).alias(f"is_{n}") for n in DEMO_NETS], F.coalesce(F.get("every", F.lit(0)), F.lit(nets.UNLABELED)).alias("category"), F.size("every").alias("n_matched"))


WEAK = ("src1", "de", "theor")


@query(f"SELECT CAST({sql_net('text', WEAK)} OR {sql_net('source', WEAK)} OR {sql_net('lang', WEAK)} AS INT) AS label, count(*) AS n, count_if({sql_net('text', WEAK)}) AS n_text, count_if({sql_net('source', WEAK)}) AS n_source, count_if({sql_net('lang', WEAK)}) AS n_lang FROM documents GROUP BY 1")
def weak_label_fields(spark, d):
    fields = ("text", "source", "lang")
    x = load(spark, d, "documents").select(*[nets.hits(F.col(f), WEAK).alias(f) for f in fields])
    label = (F.col("text") | F.col("source") | F.col("lang")).cast("int")
    return x.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(f"n_{f}") for f in fields])


@query(
    f"""
WITH x AS (SELECT doc_id, lower(text) AS h, {sql_net('text', DEMO_NETS['alpha'])} AS dis, {sql_net('text', DEMO_NETS['beta'])} AS tis FROM documents)
SELECT doc_id, dis AS is_disease, tis AS is_tissue, CASE WHEN NOT dis THEN '{nets.TISSUE_ONLY}' WHEN {sql_net('h', ('ndst',))} THEN 'one' WHEN {sql_net('h', ('ered',))} THEN 'two' ELSE '{nets.UNRESOLVED}' END AS subtype,
 CASE WHEN doc_id % 3 <> 0 THEN 'one' WHEN dis THEN '{nets.UNRESOLVED}' ELSE '{nets.TISSUE_ONLY}' END AS canonical FROM x WHERE dis OR tis
"""
)
def subtype_assign(spark, d):
    hay = nets.haystack(F.col("text"))
    x = load(spark, d, "documents").withColumn("is_disease", nets.hits(hay, DEMO_NETS["alpha"])).withColumn("is_tissue", nets.hits(hay, DEMO_NETS["beta"])).where("is_disease or is_tissue")
    old = F.when(F.col("doc_id") % 3 == 0, nets.LEGACY).otherwise("one")
    return x.select("doc_id", "is_disease", "is_tissue", nets.subtype(hay, F.col("is_disease"), {"one": ("ndst",), "two": ("ered",)}).alias("subtype"), nets.canonical_subtype(old, F.col("is_disease")).alias("canonical"))


TERMS = ("heon", "ción", "schun", "src1", "fr")


@query(" UNION ALL ".join(f"SELECT '{t}' AS term, count_if(contains(lower(text), '{t}')) AS n_text, count_if(contains(lower(source), '{t}')) AS n_source, count_if(contains(lower(lang), '{t}')) AS n_lang, count_if(contains(lower(text), '{t}') OR contains(lower(source), '{t}') OR contains(lower(lang), '{t}')) AS n_any FROM documents" for t in TERMS))
def term_hits(spark, d):
    """One pass: a count per term and field, then turned to rows."""
    fields = ("text", "source", "lang")
    hit = lambda f, t: F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(t))
    cells = []
    for t in TERMS:
        any_ = hit("text", t) | hit("source", t) | hit("lang", t)
        cells.append(F.struct(F.lit(t).alias("term"), *[F.count_if(hit(f, t)).alias(f"n_{f}") for f in fields], F.count_if(any_).alias("n_any")))
    return load(spark, d, "documents").agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")


PATIENT_SQL = """
WITH c AS (SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN 'tissue: ' || event_type WHEN event_id % 7 = 0 THEN 'x: 1, donor: Unknown, patient: 7' ELSE 'tissue: ' || event_type || ', Subject ID:  AB ' || CAST(user_id % 7 AS VARCHAR) || ' ; age: 4' END AS ch FROM events)
, v AS (SELECT *, lower(trim(regexp_extract(ch, '(?i)(?:^|[,;\\n])\\s*(?:""" + "|".join(entity.KEYS) + """)\\s*[:=]\\s*([^,;\\n]+)', 1))) AS raw FROM c)
, p AS (SELECT *, CASE WHEN raw <> '' AND raw NOT IN ('na','n/a','none','unknown','-','?','not available') THEN raw END AS pid FROM v)
, k AS (SELECT event_id, pid, CASE WHEN pid IS NOT NULL THEN event_type || '::' || pid ELSE '__unresolved__::' || CASE WHEN event_id % 2 = 0 THEN 'GSM' || CAST(event_id AS VARCHAR) ELSE 'sample_' || CAST(event_id AS VARCHAR) END END AS person, pid IS NOT NULL AS resolved FROM p)
"""


def persons(spark, d):
    e = load(spark, d, "events")
    ch = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("tissue: "), "event_type")).when(F.col("event_id") % 7 == 0, "x: 1, donor: Unknown, patient: 7").otherwise(F.concat(F.lit("tissue: "), "event_type", F.lit(", Subject ID:  AB "), (F.col("user_id") % 7).cast("string"), F.lit(" ; age: 4")))
    gsm = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("GSM"), F.col("event_id").cast("string"))).otherwise("")
    x = e.withColumn("pid", entity.patient_id(ch))
    return x.select("event_id", "pid", entity.patient_key(F.col("event_type"), F.col("pid"), gsm, F.col("event_id")).alias("person"), F.col("pid").isNotNull().alias("resolved"))


@query(PATIENT_SQL + "SELECT event_id, pid, person, resolved FROM k")
def patient_key(spark, d):
    return persons(spark, d)


@query(PATIENT_SQL + "SELECT count(*) AS n_samples, count_if(resolved) AS n_with_key, round(count_if(resolved) * 100.0::DOUBLE / count(*), 4) AS coverage_pct, count(DISTINCT CASE WHEN resolved THEN person END) AS n_resolved, count(DISTINCT CASE WHEN NOT resolved THEN person END) AS n_fallback FROM k")
def coverage(spark, d):
    return entity.coverage(persons(spark, d), "person", "resolved")


@query("WITH a AS (SELECT DISTINCT doc_id FROM documents), m AS (SELECT count(*) AS k FROM a WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT (SELECT count(*) FROM a) AS n_keys, k AS n_missing, round(CAST(k AS DOUBLE) / (SELECT count(*) FROM a), 6) AS missing_share, CAST(k AS DOUBLE) / (SELECT count(*) FROM a) <= 0.001 AS ok FROM m")
def release_guard(spark, d):
    return groups.release_guard(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id")


@query(
    PERSONS
    + "SELECT (SELECT count(*) FROM s WHERE category = 'alpha') AS n_net, (SELECT count(*) FROM s) AS n_all, (SELECT count(DISTINCT person) FROM s) AS n_people, (SELECT count(*) FROM s WHERE category = 'alpha') = (SELECT count(*) FROM documents WHERE "
    + sql_net("text", DEMO_NETS["alpha"])
    + ") AS net_equal, (SELECT sum(n) FROM (SELECT count(*) AS n FROM s GROUP BY category)) = (SELECT count(*) FROM s) AS rows_add_up, (SELECT sum(n) FROM (SELECT count(DISTINCT person) AS n FROM s GROUP BY category)) = (SELECT count(DISTINCT person) FROM s) AS people_add_up"
)
def cross_check(spark, d):
    """Equalities between independently made tables, in one row."""
    s = samples(spark, d)
    per = s.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("person").alias("p"))
    sums = per.agg(F.sum("n").alias("sn"), F.sum("p").alias("sp"), F.coalesce(F.sum(F.when(F.col("category") == "alpha", F.col("n"))), F.lit(0)).alias("n_net"))
    whole = s.agg(F.count(F.lit(1)).alias("n_all"), F.count_distinct("person").alias("n_people"))
    own = load(spark, d, "documents").agg(F.count_if(nets.hits(F.col("text"), DEMO_NETS["alpha"])).alias("own"))
    one = sums.crossJoin(whole).crossJoin(own)  # one row each
    return one.select("n_net", "n_all", "n_people", (F.col("n_net") == F.col("own")).alias("net_equal"), (F.col("sn") == F.col("n_all")).alias("rows_add_up"), (F.col("sp") == F.col("n_people")).alias("people_add_up"))


@query("SELECT l_orderkey AS sample, CAST(sum(l_quantity) AS BIGINT) AS library_size, count(DISTINCT CASE WHEN l_quantity > 0 THEN l_partkey END) AS genes_detected FROM lineitem GROUP BY 1")
def sample_qc(spark, d):
    li = load(spark, d, "lineitem")
    cells = li.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("c"))
    return cells.groupBy(F.col("l_orderkey").alias("sample")).agg(F.sum("c").cast("long").alias("library_size"), F.count_if(F.expr("c > 0")).alias("genes_detected"))


@query(
    """
WITH q AS (SELECT user_id AS sample, sum(value) AS library_size, count_if(value > 5) AS genes_detected FROM events GROUP BY 1)
, x AS (SELECT *, log10(greatest(library_size, 1.0)) AS l FROM q)
, m AS (SELECT median(l) AS ml, median(CAST(genes_detected AS DOUBLE)) AS md FROM x)
, v AS (SELECT median(abs(l - ml)) AS al, median(abs(CAST(genes_detected AS DOUBLE) - md)) AS ad FROM x, m)
SELECT sample, round(library_size, 6) AS library_size, genes_detected, l < ml - 3 * 1.4826::DOUBLE * (CASE WHEN al = 0 THEN 1e-9 ELSE al END) AS outlier_lo, l > ml + 3 * 1.4826::DOUBLE * (CASE WHEN al = 0 THEN 1e-9 ELSE al END) AS outlier_hi,
 CAST(genes_detected AS DOUBLE) < md - 3 * 1.4826::DOUBLE * (CASE WHEN ad = 0 THEN 1e-9 ELSE ad END) AS outlier_low_detection FROM x, m, v
"""
)
def mad_outliers(spark, d):
    q = load(spark, d, "events").groupBy(F.col("user_id").alias("sample")).agg(F.sum("value").alias("library_size"), F.count_if(F.expr("value > 5")).alias("genes_detected"))
    return groups.mad_flags(q, "library_size", "genes_detected").withColumn("library_size", F.round("library_size", 6))


@query("SELECT l_partkey AS gene, round(CAST(count(DISTINCT CASE WHEN l_quantity > 0 THEN l_orderkey END) AS DOUBLE) / n, 9) AS detection_rate, round(sum(l_quantity) / n, 9) AS mean_count FROM lineitem, (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) GROUP BY l_partkey, n")
def gene_summary(spark, d):
    li = load(spark, d, "lineitem")
    n = li.agg(F.count_distinct("l_orderkey").alias("n"))
    cells = li.groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("c"))
    g = cells.groupBy(F.col("l_partkey").alias("gene")).agg(F.count_if(F.expr("c > 0")).alias("k"), F.sum("c").alias("s")).crossJoin(F.broadcast(n))  # one row
    return g.select("gene", F.round(F.col("k").cast("double") / F.col("n"), 9).alias("detection_rate"), F.round(F.col("s") / F.col("n"), 9).alias("mean_count"))


COHORT = "SELECT 'lang' AS grouping, lang AS level, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'size', CASE WHEN n_chars >= 2000 THEN 'long' ELSE 'short' END, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'category', " + CATEGORY_SQL + ", count(*) FROM documents GROUP BY 2"


@query(COHORT)
def cohort(spark, d):
    docs = load(spark, d, "documents")
    return groups.composition(docs, {"lang": F.col("lang"), "source": F.col("source"), "size": F.when(F.col("n_chars") >= 2000, "long").otherwise("short"), "category": nets.first_match(F.lower("text"), DEMO_NETS)})


@query("WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 80), 79) AS INT) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1")
def histogram(spark, d):
    return groups.histogram(load(spark, d, "lineitem"), "l_extendedprice", 80)


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 15")
def top15(spark, d):
    return load(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(15)


@query("SELECT count(*) AS n_total, count_if(value <= 20) AS n_kept, count_if(value > 20) AS n_excluded, round(count_if(value > 20) * 100.0::DOUBLE / count(*), 4) AS pct_excluded FROM events")
def bulk_filter(spark, d):
    v = F.col("value")
    out = load(spark, d, "events").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(v <= 20).alias("n_kept"), F.count_if(v > 20).alias("n_excluded"))
    return out.withColumn("pct_excluded", F.round(F.coalesce(F.try_divide(F.col("n_excluded") * 100.0, "n_total"), F.lit(0.0)), 4))


@query("SELECT count_if(l_quantity <= 25) AS n_le, count_if(l_quantity < 25) AS n_lt, count_if(l_quantity >= 25) AS n_ge FROM lineitem")
def bulk_predicates(spark, d):
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").agg(F.count_if(q <= 25).alias("n_le"), F.count_if(q < 25).alias("n_lt"), F.count_if(q >= 25).alias("n_ge"))


@query(f"WITH x AS (SELECT doc_id, {CATEGORY_SQL} AS c, n_chars < 5000 AS bulk FROM documents) SELECT doc_id, c IN ('alpha','beta') AND bulk AS is_positive, c NOT IN ('alpha','beta') AND bulk AS is_neg_whole, c = 'gamma' AND bulk AS is_neg_hard, bulk AS is_bulk FROM x")
def probe_pools(spark, d):
    c, bulk = nets.first_match(F.lower("text"), DEMO_NETS), F.col("n_chars") < 5000
    x = load(spark, d, "documents").select("doc_id", c.alias("c"), bulk.alias("is_bulk"))
    pos = F.col("c").isin("alpha", "beta")
    return x.select("doc_id", (pos & F.col("is_bulk")).alias("is_positive"), (~pos & F.col("is_bulk")).alias("is_neg_whole"), ((F.col("c") == "gamma") & F.col("is_bulk")).alias("is_neg_hard"), "is_bulk")


@query("WITH g AS (SELECT d.source, count_if(quality = 1) AS p, count_if(quality = 0) AS n FROM documents d JOIN labels USING (doc_id) GROUP BY 1) SELECT source, p AS n_pos, n AS n_neg, CAST(floor((p + n) / 5) AS BIGINT) >= 25 AS enough_rows, least(p, n) < 5 AS skipped FROM g")
def floor_checks(spark, d):
    x = load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels"), "doc_id")
    g = x.groupBy("source").agg(F.count_if(F.expr("quality = 1")).alias("n_pos"), F.count_if(F.expr("quality = 0")).alias("n_neg"))
    return g.select("source", "n_pos", "n_neg", (F.floor((F.col("n_pos") + F.col("n_neg")) / 5) >= 25).alias("enough_rows"), (F.least("n_pos", "n_neg") < 5).alias("skipped"))


@query(PERSONS + "SELECT category, count(*) AS n_samples, count(DISTINCT source) AS n_series, count(*) >= 50 AND CAST(count(*) AS DOUBLE) / count(DISTINCT source) >= 10 AS dominated, count(*) < 100 AS undersized, category || ': ' || CAST(count(*) AS VARCHAR) || ' samples' AS note FROM s GROUP BY 1")
def undersized_flags(spark, d):
    g = samples(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("source").alias("n_series"))
    return g.select("category", "n_samples", "n_series", ((F.col("n_samples") >= 50) & (F.col("n_samples") / F.col("n_series") >= 10)).alias("dominated"), (F.col("n_samples") < 100).alias("undersized"), F.format_string("%s: %d samples", "category", "n_samples").alias("note"))


@query("WITH s AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%b %d %Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders) SELECT CAST(year(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%b %d %Y'))) AS INT) AS year, count(*) AS n FROM s WHERE coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%b %d %Y')) IS NOT NULL GROUP BY 1")
def year_counts(spark, d):
    """Free-form dates in two layouts; others don't count."""
    o = load(spark, d, "orders")
    t = F.when(F.col("o_orderkey") % 9 == 0, "n/a").when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMM dd yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    when = F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd")), F.try_to_timestamp(t, F.lit("MMM dd yyyy")))
    return o.select(F.year(when).alias("year")).where("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH x AS (SELECT {sql_net('text', DEMO_NETS['alpha'])} AS a, {sql_net('text', DEMO_NETS['beta'])} AS b, {' + '.join(f'CAST({sql_net('text', w)} AS INT)' for w in DEMO_NETS.values())} AS k FROM documents) SELECT count_if(a AND NOT b) AS disease_only, count_if(b AND NOT a) AS tissue_only, count_if(a AND b) AS both_axes, count_if(k >= 2) AS comorbid FROM x WHERE a OR b")
def pool_composition(spark, d):
    x = load(spark, d, "documents").select(nets.hits(F.col("text"), DEMO_NETS["alpha"]).alias("a"), nets.hits(F.col("text"), DEMO_NETS["beta"]).alias("b"), F.size(nets.all_matches(F.col("text"), DEMO_NETS)).alias("k")).where("a or b")
    return x.agg(F.count_if(F.expr("a and not b")).alias("disease_only"), F.count_if(F.expr("b and not a")).alias("tissue_only"), F.count_if(F.expr("a and b")).alias("both_axes"), F.count_if(F.expr("k >= 2")).alias("comorbid"))


@query(PERSONS + f", c AS (SELECT unnest(['{"','".join(ORDER)}']) AS category) SELECT c.category, count(s.doc_id) AS n, count(DISTINCT CASE WHEN s.resolved THEN s.source END) AS n_series FROM c LEFT JOIN s USING (category) GROUP BY 1")
def subtype_counts(spark, d):
    """Listed labels with zero for absent ones."""
    listed = spark.createDataFrame([(c,) for c in ORDER], "category string")
    g = samples(spark, d).groupBy("category").agg(F.count("doc_id").alias("n"), F.count_distinct(F.when(F.col("resolved"), F.col("source"))).alias("n_series"))
    return listed.join(g, "category", "left").na.fill(0, ["n", "n_series"])


@query(PERSONS + "SELECT category, count(*) AS n FROM s WHERE NOT resolved AND category <> 'alpha' GROUP BY 1")
def relabel_audit(spark, d):
    """Labels that a re-routing is about to overwrite."""
    return samples(spark, d).where(~F.col("resolved") & (F.col("category") != "alpha")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in nets.DISPLAY_NAMES.items()) + ") t(slug, name)")
def display_names(spark, d):
    x = spark.createDataFrame([(k,) for k in nets.DISPLAY_NAMES], "slug string")
    return x.select("slug", nets.display_name(F.col("slug")).alias("name"))


#: Words of all built-in nets: titles of samples are made of them, so that every net and subtype occurs.
TITLE_WORDS = sorted({w for table in (nets.DISEASE_NETS, nets.SUBTYPE_NETS, {"": nets.TISSUE_NET}) for words in table.values() for w in words})
TITLES = f"""SELECT doc_id, source, n_chars, CASE WHEN doc_id % 5 = 0 THEN 'control, no. ' || doc_id ELSE 'RNA-seq of ' || w[doc_id % {len(TITLE_WORDS)} + 1] || '; ' || source || '; ' || upper(w[(doc_id * 7 + 3) % {len(TITLE_WORDS)} + 1]) END AS title
 FROM documents, (SELECT [{", ".join(f"'{w}'" for w in TITLE_WORDS)}] AS w)"""
DISEASES = [*nets.DISEASE_NETS, nets.UNLABELED]


def titles(spark, d):
    """Documents as samples whose titles name diseases and tissues."""
    w = F.array(*[F.lit(x) for x in TITLE_WORDS])
    pick = lambda at: F.element_at(w, (at % len(TITLE_WORDS) + 1).cast("int"))
    named = F.concat(F.lit("RNA-seq of "), pick(F.col("doc_id")), F.lit("; "), "source", F.lit("; "), F.upper(pick(F.col("doc_id") * 7 + 3)))
    title = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("control, no. "), F.col("doc_id").cast("string"))).otherwise(named)
    return load(spark, d, "documents").select("doc_id", "source", "n_chars", title.alias("title"))


_CARDIO, _TISSUE = sql_net("title", nets.DISEASE_NETS["cardiovascular"]), sql_net("title", nets.TISSUE_NET)


@query(
    f"""
WITH t AS ({TITLES}), m AS (SELECT doc_id, lower(title) AS title, {sql_first("title", nets.DISEASE_NETS, nets.UNLABELED)} AS category, {" || ".join(f"CASE WHEN {sql_net('title', w)} THEN ['{n}'] ELSE [] END" for n, w in nets.DISEASE_NETS.items())} AS every, {_CARDIO} AS dis, {_TISSUE} AS tis FROM t)
SELECT doc_id, category, array_to_string(every, ',') AS matched, CAST(len(every) AS INTEGER) AS n_matched, dis AS is_disease, tis AS is_tissue,
  CASE WHEN NOT (dis OR tis) THEN NULL WHEN NOT dis THEN '{nets.TISSUE_ONLY}' ELSE {sql_first("title", nets.SUBTYPE_NETS, nets.UNRESOLVED)} END AS subtype,
  CASE category {" ".join(f"WHEN '{k}' THEN '{nets.DISPLAY_NAMES[k]}'" for k in DISEASES)} END AS shown
FROM m
"""
)
def disease_labels(spark, d):
    """The built-in nets over titles: first and all categories, subtypes, tissue hits and the category's name in reports."""
    hay = nets.haystack(F.col("title"))
    x = titles(spark, d).select("doc_id", hay.alias("hay")).withColumn("every", nets.all_matches(F.col("hay"), nets.DISEASE_NETS))
    x = x.withColumn("is_disease", F.array_contains("every", "cardiovascular")).withColumn("is_tissue", nets.hits(F.col("hay"), nets.TISSUE_NET))
    category = F.coalesce(F.get("every", F.lit(0)), F.lit(nets.UNLABELED))
    subtype = F.when(F.col("is_disease") | F.col("is_tissue"), nets.subtype(F.col("hay"), F.col("is_disease")))
    return x.select("doc_id", category.alias("category"), F.array_join("every", ",").alias("matched"), F.size("every").alias("n_matched"), "is_disease", "is_tissue", subtype.alias("subtype"), nets.display_name(category).alias("shown"))


@query(breakdown_sql(PERSONS.replace(CATEGORY_SQL, sql_first("title", nets.DISEASE_NETS, nets.UNLABELED)).replace("FROM documents", f"FROM ({TITLES})"), DISEASES))
def disease_breakdown(spark, d):
    """The report by disease category over the built-in nets."""
    ok = F.col("doc_id") % 5 != 0
    key = F.when(ok, F.concat_ws("::", "source", (F.col("doc_id") % 50).cast("string"))).otherwise(F.concat(F.lit("__unresolved__::"), F.col("doc_id").cast("string")))
    x = titles(spark, d).select("source", "n_chars", nets.first_match(F.lower("title"), nets.DISEASE_NETS).alias("category"), key.alias("person"), ok.alias("resolved"))
    return groups.in_priority_order(groups.breakdown(x, "category", "person", "source", "n_chars", "resolved", [*DISEASES, groups.TOTAL]), "category", [*DISEASES, groups.TOTAL])
